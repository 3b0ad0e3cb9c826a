"""Operator 9, main text of web pages by composite text density.

A forgiving tokenizer builds the DOM as arrays in page order. Elements that are never article text (scripts, menus,
footers, adverts, comments and the like, by tag, role or class words) are cut; one that only its class or id words would cut stays
if it holds the greater part of the text, and density decides within it. Words that name parts of articles as well
(notice, social, widget, ...), and forms, are weighed by the word: all elements of one word stay if together, with those
of rarer words, they hold the greater part; on paragraphs and headings they say nothing. If words would cut all text, none is cut by
words. Every other node gets its
link-adjusted characters per tag; a node's density sum is that of its children. The node of the largest sum gives the
threshold, the least density on its path to the body, and every node from the body down that reaches the threshold marks
the largest-sum subtree below it. The article is the least subtree that holds all marked ones, so that headings and short
paragraphs between dense ones stay. Text-level elements (b, span, ...) count as tags but are no subtrees of their own.

White space inside a block is one space, blocks are joined by line ends, character references are decoded, and nothing
within a marked subtree is dropped or capped. `<br>` is white space inside its block.

Defined results: null, empty or textless pages give an empty text; broken markup is read as far as it goes; repeated rows
repeat; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm.common import slices, table

#: Fixed element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object")
NOISE_TAGS = frozenset([*RAW, "head", "nav", "footer", "aside", "button", "select", "option", "dialog", "menu", "label", "audio", "video", "canvas"])
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
#: Words of class and id attributes of elements beside the article.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice alert sidebar sidenav comment comments disqus newsletter subscribe subscription share sharing social related recommended breadcrumb breadcrumbs menu nav navbar navigation footer popup modal overlay login signup pagination pager widget toolbar".split()
)
#: Those of them that name parts of articles as well.
WEIGHED_WORDS = frozenset("social notice alert related recommended widget promotion promo subscription subscribe banner overlay login signup share sharing toolbar form".split())
#: Elements of running text, on which such words say nothing.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Words that say a noise word after them in the same name is of the layout, not of the element.
MODIFIERS = frozenset("with has have no not without hide".split())
#: Elements whose class words say nothing about one part of a page.
WHOLE = frozenset("html body main article".split())
#: Opening these ends an open element of the same group.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(?:svg|math)(?=[\s/])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?<=/)>"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-z][^>]*>",
    re.I | re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Nodes in page order: tag, parent, noise, and the word that alone makes them noise; and text pieces (node, block, text)."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.noise, self.worded = ["#root"], [-1], [False], [""]
        self.pieces: list[tuple[int, int, str]] = []
        stack, block, at = [0], 0, 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self.pieces.append((stack[-1], block, source[at : m.start()]))
            at = m.end()
            if not (name := m["name"]):
                continue
            name = name.lower()
            if name in BLOCK:
                block += 1
            if m["end"]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        del stack[k:]
                        break
                continue
            if name == "br":
                self.pieces.append((stack[-1], block, " "))
            ends = {"p"} if name in BLOCK else set()
            ends |= ENDS.get(name, set())
            for k in range(len(stack) - 1, 0, -1):
                if (open_tag := self.tag[stack[k]]) in ends:
                    del stack[k:]
                    break
                if open_tag in BLOCK and open_tag != "p" and open_tag not in ends:
                    break
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            noise, worded = self._is_noise(name, m["attrs"], stack)
            self.noise.append(self.noise[stack[-1]] or noise)
            self.worded.append(worded)
            if name not in VOID and not m["attrs"].endswith("/"):
                stack.append(node)
        if at < len(source):
            self.pieces.append((stack[-1], block, source[at:]))
        if any(self.worded):
            self._cut_worded()

    def _cut_worded(self) -> None:
        """Noise of class and id words, where it is not the greater part of the text."""
        n = len(self.tag)
        chars = [0] * n
        for node, _, text in self.pieces:
            if not self.noise[node]:
                chars[node] += sum(map(len, html.unescape(text).split()))
        for k in range(n - 1, 0, -1):
            chars[self.parent[k]] += chars[k]
        held: dict[str, int] = {}
        inside: list[frozenset[str]] = [frozenset()] * n  # the weighed words of a node and those around it
        for k in range(1, n):
            inside[k], word = inside[self.parent[k]], self.worded[k]
            if word in WEIGHED_WORDS and word not in inside[k]:
                held[word] = held.get(word, 0) + chars[k]
                inside[k] |= {word}
        cut, taken = set(), 0
        for word in sorted(held, key=lambda w: (held[w], w)):
            taken += held[word]
            if 2 * taken <= chars[0]:
                cut.add(word)
        noise = list(self.noise)
        for k in range(1, n):
            word = self.worded[k]
            noise[k] = noise[k] or noise[self.parent[k]] or (word in cut if word in WEIGHED_WORDS else word != "" and 2 * chars[k] <= chars[0])
        if chars[0] == 0 or any(not noise[node] and text.strip() for node, _, text in self.pieces):
            self.noise = noise

    def _is_noise(self, name: str, attrs: str, stack: list[int]) -> tuple[bool, str]:
        """Whether the element is noise in any case, and the class or id word, or tag, that else says so."""
        if name in NOISE_TAGS:
            return True, ""
        if name == "header" and not any(self.tag[k] in ("article", "main") for k in stack):
            return True, ""
        worded = "form" if name == "form" else ""
        if not attrs or name in WHOLE:
            return False, worded
        for key, *values in _ATTR.findall(attrs):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id"):
                found = [w for part in value.split() if (w := _noise_word(part)) and not (name in RUNNING and w in WEIGHED_WORDS)]
                # of several words one that is not weighed decides
                worded = min([worded, *found], key=lambda w: (w == "", w in WEIGHED_WORDS))
            elif key == "role" and value.lower() == "form":
                worded = worded or "form"
            elif (
                (key == "role" and value.lower() in NOISE_ROLES)
                or (key == "hidden" and not value.lower().startswith("until"))
                or (key == "aria-hidden" and value.strip().lower() == "true")
                or (key == "style" and _NOT_SHOWN.search(value))
            ):
                return True, ""
        return False, worded


def _noise_word(name: str) -> str:
    """The first noise word of a class or id name that no modifier stands before, else ''."""
    for w in _WORDS.findall(name):
        w = w.lower()
        if w in MODIFIERS:
            return ""
        if w in NOISE_WORDS:
            return w
    return ""


def densities(page: Page, pieces: list[tuple[int, int, str]]) -> tuple[int, list[float], list[float], list[int]]:
    """The body's node (0 without text in one), the density of every node, the sum of its children's, and the block that each
    node belongs to; all empty for a page without text."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, _, text in pieces:
        chars[node] += sum(map(len, text.split()))
    for k in range(n - 1, 0, -1):
        if page.noise[k]:
            continue
        up = page.parent[k]
        if page.tag[k] == "a":
            link_chars[k], link_tags[k] = chars[k], tags[k] + 1
        chars[up] += chars[k]
        tags[up] += tags[k] + 1
        link_chars[up] += link_chars[k]
        link_tags[up] += link_tags[k]
    body = next((k for k in range(n) if page.tag[k] == "body"), 0)
    if not chars[body]:
        body = 0
    if not chars[body]:
        return 0, [], [], []
    share = link_chars[body] / chars[body]

    def density(k: int) -> float:
        c, t, lc, lt = chars[k], tags[k] or 1, link_chars[k] or 1, link_tags[k] or 1
        if not chars[k]:
            return 0.0
        base = math.log(c / max(1, c - link_chars[k]) * link_chars[k] + share * c + math.e)
        return c / t * math.log(max(c / lc * t / lt, 1.0)) / max(base, 1.0)

    dense = [0.0 if page.noise[k] else density(k) for k in range(n)]
    sums = [0.0] * n
    owner = list(range(n))  # text-level elements belong to the block around them
    for k in range(1, n):
        owner[k] = k if page.tag[k] in BLOCK else owner[page.parent[k]]
        if owner[k] == k:
            sums[owner[page.parent[k]]] += dense[k]
    return body, dense, sums, owner


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    n = len(page.tag)
    pieces = [(node, block, html.unescape(t)) for node, block, t in page.pieces if not page.noise[node]]
    body, dense, sums, _ = densities(page, pieces)
    if not dense:
        return ""
    #: The node of the largest sum in each subtree: the deepest of equals.
    best = list(range(n))
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        if not page.noise[k] and sums[best[k]] >= sums[best[up]] and sums[best[k]] > 0:
            best[up] = best[k]
    top = k = best[body]
    limit = dense[top]
    while k not in (body, 0, -1):
        k = page.parent[k]
        limit = min(limit, dense[k])
    reached, article = [False] * n, [False] * n
    for k in range(body, n):
        if page.noise[k] or not (k == body or reached[page.parent[k]]):
            continue
        reached[k] = dense[k] >= limit
        if reached[k]:
            article[best[k]] = True
    if not any(article):
        article[top] = True
    marked = [k for k in range(n) if article[k]]
    paths = []
    for k in marked:
        path = [k]
        while path[-1] > 0:
            path.append(page.parent[path[-1]])
        paths.append(path[::-1])
    shared = 0
    while all(len(p) > shared and p[shared] == paths[0][shared] for p in paths):
        shared += 1
    article[paths[0][shared - 1]] = True
    for k in range(1, n):
        article[k] = article[k] or article[page.parent[k]]
    blocks: dict[int, list[str]] = {}
    for node, block, text in pieces:
        if article[node]:
            blocks.setdefault(block, []).append(text)
    return "\n".join(filter(None, (" ".join("".join(b).split()) for b in blocks.values())))


def extract(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "html"):
            texts = [main_text(x) for x in piece.column("html").to_pylist()]
            yield pa.record_batch([piece.column("id"), piece.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    src = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), "page_id", "url", "html")
