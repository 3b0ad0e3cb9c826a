"""Controls of web forms: a forgiving DOM with ancestors, one row a control, then typed values and assessments as aggregates.

A page is parsed in one pass over Arrow batches; open shadow roots (template elements with a shadowroot) are part of the
page. A control's label is, in this order, that of a label element for it or around it, its aria-label, the elements that
aria-labelledby names, its placeholder, name, id. The question of a radio or check box is its fieldset's legend, else the
nearest group's name or heading. Custom choosers (comboboxes and the like) are controls whose value is the text shown.

Null and empty pages have no controls; broken markup is read as far as it goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.functions import predicates as P

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Input types that hold no answer, elements and roles of the page around a form, signs of custom choosers.
NO_ANSWER = ("hidden", "submit", "button", "reset", "image", "file")
CHROME_TAGS = frozenset("nav header footer aside".split())
CHROME_ROLES = frozenset("navigation menu menubar toolbar tablist banner complementary".split())
CHOOSER_CLASSES = ("ant-select", "react-select", "select__control", "ng-select", "mat-select", "p-dropdown")
SHOWN_CLASSES = ("selection-item", "single-value", "selected-value", "value-label")
_PLACEHOLDER = re.compile(r"(select(\s+(one|an option|a value))?|choose(\s+one)?|please select|pick one|--+|—|-)?\s*(\.{3}|…)?", re.I)
_CUT = re.compile(r"\s*(select\s*\.{2,3}|select\s+(one|an option|a value)\b|choose\s*\.{2,3}|—|…)", re.I)
SCHEMA = "pos int, kind string, name string, label string, question string, value string, chosen boolean, required boolean, chrome boolean"


def _tidy(s: str | None) -> str:
    return " ".join((s or "").split())


class Dom(HTMLParser):
    """Elements in page order, with their parents and what stands in them."""

    def __init__(self, source: str) -> None:
        super().__init__()
        self.tag, self.attrs, self.parent, self.inside = ["#root"], [{}], [-1], [[]]
        self.stack, self.ids = [0], {}
        self.feed(source)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "option" and self.tag[self.stack[-1]] == "option":
            self.stack.pop()
        node = len(self.tag)
        self.tag.append(tag)
        self.attrs.append({k: v or "" for k, v in attrs})
        self.parent.append(self.stack[-1])
        self.inside.append([])
        self.inside[self.stack[-1]].append(node)
        self.ids.setdefault(self.attrs[node].get("id"), node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.stack.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[k]] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data: str) -> None:
        self.inside[self.stack[-1]].append(data)

    def text(self, node: int) -> str:
        """What an element says, without the options of lists and scripts in it."""
        parts, todo = [], [node]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x == node or self.tag[x] not in ("select", "script", "style", "textarea"):
                todo += reversed(self.inside[x])
        return _tidy("".join(parts))

    def up(self, node: int) -> Iterator[int]:
        while (node := self.parent[node]) > 0:
            yield node

    def below(self, node: int) -> Iterator[int]:
        for x in self.inside[node]:
            if not isinstance(x, str):
                yield x
                yield from self.below(x)

    def has_class(self, node: int, parts: tuple[str, ...]) -> bool:
        return any(p in self.attrs[node].get("class", "") for p in parts)

    def named(self, node: int) -> str:
        """The text of the elements that aria-labelledby names."""
        return _tidy(" ".join(self.text(self.ids[i]) for i in self.attrs[node].get("aria-labelledby", "").split() if i in self.ids))


def _label(dom: Dom, node: int, label_for: dict[str, int]) -> str:
    a = dom.attrs[node]
    around = next((k for k in dom.up(node) if dom.tag[k] == "label"), None)
    said = [dom.text(label_for[a["id"]]) if a.get("id") in label_for else "", dom.text(around) if around else "", a.get("aria-label"), dom.named(node), a.get("placeholder"), a.get("name"), a.get("id")]
    text = next(filter(None, map(_tidy, said)), "")
    cut = _CUT.search(text)
    return text[: cut.start()].strip() if cut and cut.start() else text


def _question(dom: Dom, node: int) -> str:
    for k in dom.up(node):
        if dom.tag[k] == "fieldset" and (legend := next((x for x in dom.below(k) if dom.tag[x] == "legend"), None)):
            return dom.text(legend)
        if named := dom.named(k) or (dom.attrs[k].get("role") in ("group", "radiogroup") and _tidy(dom.attrs[k].get("aria-label"))):
            return named
        head = next((x for x in dom.inside[k] if not isinstance(x, str) and (dom.tag[x] in ("h1", "h2", "h3", "h4", "h5", "h6") or dom.has_class(x, ("question", "prompt")))), None)
        if head:
            return dom.text(head)
    return ""


def _chooser(dom: Dom, node: int) -> bool:
    a = dom.attrs[node]
    return dom.tag[node] not in ("select", "input") and (a.get("role") == "combobox" or a.get("aria-haspopup") == "listbox" or dom.has_class(node, CHOOSER_CLASSES))


def _shown(dom: Dom, node: int) -> str:
    part = next((x for x in dom.below(node) if dom.has_class(x, SHOWN_CLASSES)), node)
    text = dom.text(part)
    half = text[: len(text) // 2]
    text = half.strip() if len(text) % 2 == 0 and half * 2 == text else text
    return "" if _PLACEHOLDER.fullmatch(text) else text


def controls(source: str | None) -> list[tuple]:
    """Rows of SCHEMA, in page order. `value` of a list is that of the chosen option, if it isn't the first; of radios and
    boxes it is the caption; `chosen` says whether the control holds an answer."""
    dom, rows, within = Dom(source or ""), [], set()
    label_for: dict[str, int] = {}
    for k, tag in enumerate(dom.tag):
        if tag == "label" and dom.attrs[k].get("for"):
            label_for.setdefault(dom.attrs[k]["for"], k)
    for node in range(1, len(dom.tag)):
        tag, a = dom.tag[node], dom.attrs[node]
        chooser = _chooser(dom, node)
        if (tag not in ("input", "select", "textarea") and not chooser) or "disabled" in a:
            continue
        kind = "chooser" if chooser else a.get("type", "text").lower() if tag == "input" else tag
        above = list(dom.up(node))
        if kind in NO_ANSWER or within.intersection(above):
            continue
        label, question = _label(dom, node, label_for), ""
        if chooser:
            within.add(node)
            value = _shown(dom, node)
        elif tag == "select":
            options = [x for x in dom.below(node) if dom.tag[x] == "option"]
            at = next((i for i, x in enumerate(options) if "selected" in dom.attrs[x]), 0)
            value = dom.attrs[options[at]].get("value", dom.text(options[at])) if options and at else ""
        elif tag == "textarea":
            value = dom.text(node)
        else:
            value = a.get("value", "").strip()
        chosen = value != "" and not (kind == "tel" and re.fullmatch(r"\+\d{1,4}", "".join(value.split())))
        if kind in ("radio", "checkbox"):
            question, chosen = _question(dom, node), "checked" in a
            value = label or value
        required = "required" in a or a.get("aria-required") == "true" or re.search(r"[*✱]|\brequired\b", label, re.I) is not None
        chrome = any(dom.tag[k] in CHROME_TAGS or dom.attrs[k].get("role") in CHROME_ROLES for k in above)
        rows.append((len(rows), kind, a.get("name", ""), label, question, value, bool(chosen), required, chrome))
    return rows


def form_controls(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, *SCHEMA) of every control of every page."""
    names = [key, *(c.split()[0] for c in SCHEMA.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *r) for k, v in zip(b[key], b[html], strict=True) for r in controls(v)], columns=names)

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, {SCHEMA}")


def _group(key: str) -> list[Column]:
    """Radios and boxes of one name (else of one question) are one control, any other stands alone."""
    many = F.col("kind").isin("radio", "checkbox")
    name = F.coalesce(F.nullif(F.regexp_replace("name", r"\[\]$", ""), F.lit("")), "question")
    return [F.col(key), F.when(many, F.col("kind")).alias("many"), F.when(many, name).otherwise(F.col("pos").cast("string")).alias("control")]


def typed_values(found: DataFrame, key: str) -> DataFrame:
    """(key, pos, label, value): answers with a label or question that a person would use, outside the page's own controls; of
    answers to one question the first."""
    real = found.where(F.col("chosen") | ((F.col("kind") == "tel") & (F.col("value") != ""))).where("NOT chrome AND kind <> 'password'")
    asked = F.when(F.col("kind").isin("radio", "checkbox"), F.col("question")).otherwise(F.col("label"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x.value)
    answers = real.groupBy(*_group(key)).agg(F.min("pos").alias("pos"), F.min_by(asked, "pos").alias("label"), F.array_join(F.array_distinct(parts), ", ").alias("value"))
    usable = (F.length("label") <= 120) & ~P.junk_label(F.col("label")) & (F.lower("label") != F.lower("value")) & ~P.instruction(F.col("value"))
    first = answers.where(usable).groupBy(key, F.lower("label").alias("asked")).agg(F.min_by(F.struct("pos", "label", "value"), "pos").alias("a"))
    return first.select(key, "a.*")


def assess(found: DataFrame, key: str, optional: bool = False) -> DataFrame:
    """(key, total, filled, required, required_filled, missed) of each page; a set of radios is required, one of boxes never;
    `missed` counts required ones that are empty, with `optional` all."""
    need = F.when(F.col("kind") == "radio", True).when(F.col("kind") == "checkbox", False).otherwise(F.col("required"))
    once = found.groupBy(*_group(key)).agg(F.bool_or("chosen").alias("f"), F.bool_or(need).alias("r"))
    counts = {"total": F.lit(True), "filled": F.col("f"), "required": F.col("r"), "required_filled": F.col("r") & F.col("f"), "missed": ~F.col("f") & (F.lit(optional) | F.col("r"))}
    return once.groupBy(key).agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
