"""Resolve all fields of many forms at once: a fixed order of routes, then what the fields of a form claim together.

A field goes the first of these ways that is open to it:

1. office: a box for the office, or a derived one, stays empty;
2. alternate: another name (maiden, preferred, ...) takes only the value stored for it;
3. second_line: a second address line takes only a stored second line;
4. prompt: a question or catch-all takes the stored answer whose key's words all stand in it;
5. qualified: an address with a qualifier takes only a stored one, if the form also asks for the plain address;
6. script: a name in a script takes the stored one, and may go on to its own key, but to no concept;
7. own: the stored value of the key that the label, or the field's name, spells;
8. education: a part of the qualification that the label names, else of the highest; without one it stays empty;
9. composite: a stored whole, else the parts that no other field of the form claims, else a fallback;
10. atom: the value of the field's concept, or of those that stand in for it.

Fields and stored values meet on the owner and a word, a key or three letters of one, never all with all. Labels are
matched with concepts once each, however many fields have them. The concepts that a form's fields claim are a set of at
most as many as there are concepts, gathered with partial aggregation; nothing else is collected by form.

Stored values and claims ask for merge joins: a vault that was exploded counts as no larger than its source with Spark, which
would send it to the driver as a broadcast.

Input: fields (owner, form, pos, label, name, max_length), vault (owner, ord, key, value), phrases (ord, concept, phrase).
Empty values count as absent. Null labels and names have no words. Fields without an owner in the vault stay empty, but
for dates of application.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.functions import predicates as P
from formweave.functions.text import initial, key_of_label, words_of_label
from formweave.operators.matching import best_concept
from formweave.sources.shared import written

#: Fixed word lists: what makes a name an alternate one, an address a qualified one, a name one in a script.
ALTERNATE = ("preferred", "former", "previous", "prior", "maiden", "other", "alternate", "alternative", "nickname", "nick", "alias", "aka")
ALTERNATE_ALONE = ("nickname", "nick", "alias", "aka")
ALTERNATE_NOUNS = ("name", "nickname", "alias", "aka")
ADDRESSES = ("correspondence", "mailing", "postal", "office", "business", "work", "employer", "permanent", "previous", "former", "overseas", "foreign", "abroad")
SCRIPTS = (
    "chinese", "japanese", "korean", "arabic", "hindi", "tamil", "telugu", "kannada", "malayalam", "bengali", "gujarati",
    "punjabi", "marathi", "urdu", "russian", "thai", "greek", "hebrew", "persian", "farsi", "devanagari", "cyrillic", "kanji",
    "kana", "katakana", "hiragana", "hanzi", "hangul", "native", "local", "vernacular",
)
SECOND_LINE = ("address 2", "address line 2", "addr 2", "line 2", "apartment", "apt", "suite", "unit")
NOT_SECOND_LINE = ("city", "state", "province", "zip", "postal", "country", "phone")
SECOND_LINE_KEYS = ("address 2", "address line 2", "apartment", "apt", "suite", "unit")


@dataclass(frozen=True)
class Composite:
    """A value of several concepts: `prefer` as a whole, else `members`, else `fallback`."""

    members: tuple[str, ...]
    separator: str
    prefer: str | None = None
    fallback: str | None = None


@dataclass(frozen=True)
class Rules:
    """What the resolver knows of concepts beyond their phrases. `stand_ins`: concepts whose values serve in order; `levels`:
    words of a label that name a level of education, in order of precedence."""

    composites: dict[str, Composite] = field(
        default_factory=lambda: {
            "full": Composite(("given", "middle", "family"), " ", "full", "full"),
            "givenmiddle": Composite(("given", "middle"), " ", None, "given"),
            "address": Composite(("street1", "street2", "city", "state", "zip", "country"), ", "),
        }
    )
    names: tuple[str, ...] = ("given", "middle", "family", "givenmiddle", "full")
    stand_ins: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"nationality": ("nationality", "country"), "phone": ("cellphone", "phone", "homephone")})
    levels: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("doctorate", ("phd", "ph d", "doctorate", "doctoral", "dphil")),
        ("master", ("masters", "master", "post graduate", "postgraduate", "pg", "ms", "msc", "mba")),
        ("bachelor", ("bachelors", "bachelor", "under graduate", "undergraduate", "ug", "graduation", "degree", "bs", "bsc", "ba")),
        ("diploma", ("diploma", "associate")),
        ("highschool", ("high school", "highschool", "secondary school", "12th", "hsc", "intermediate")),
    )


def _first_of(words: Column, options: tuple[str, ...]) -> Column:
    """The first of a label's words that is an option, else null."""
    return F.get(F.filter(words, lambda w: w.isin(*options)), F.lit(0))


def routes(fields: DataFrame) -> DataFrame:
    """`fields` with `route` and `q`, the qualifier that the route looks for; a null route goes on to keys and concepts."""
    said, named = words_of_label(F.col("label")), words_of_label(F.col("name"))
    f = fields.withColumns({"said": said, "named": named}).withColumn("words", F.split("said", " "))
    noun = F.array_contains("words", "address")
    plain = noun & _first_of(F.col("words"), ADDRESSES).isNull()
    asked = f.groupBy("owner", "form").agg(F.bool_or(plain).alias("asks_plain"))
    f = f.join(asked.withColumnsRenamed({"owner": "_o", "form": "_f"}).hint("merge"), F.col("owner").eqNullSafe(F.col("_o")) & F.col("form").eqNullSafe(F.col("_f"))).drop("_o", "_f")
    alternate = F.when(F.arrays_overlap("words", F.array(*map(F.lit, ALTERNATE_NOUNS))), _first_of(F.col("words"), ALTERNATE))
    script = F.when(F.array_contains("words", "name"), _first_of(F.col("words"), SCRIPTS))
    address = F.when(noun & F.col("asks_plain"), _first_of(F.col("words"), ADDRESSES))
    second = P.has_phrase(F.col("said"), SECOND_LINE) & ~P.has_phrase(F.col("said"), NOT_SECOND_LINE)
    route = (
        F.when(P.office_use(F.col("label"), F.col("name")), "office")
        .when(alternate.isNotNull(), "alternate")
        .when(second, "second_line")
        .when(P.screening_prompt(F.col("label")), "prompt")
        .when(address.isNotNull(), "qualified")
        .when(script.isNotNull(), "script")
    )
    q = F.when(F.col("route") == "alternate", alternate).when(F.col("route") == "qualified", address).when(F.col("route") == "script", script).when(F.col("route") == "second_line", "")
    return f.withColumn("route", route).withColumn("q", q).drop("asks_plain")


def stored(vault: DataFrame) -> DataFrame:
    """(owner, key, ord, value): keys by their words; the place is the first key's, the value the last's."""
    return vault.groupBy("owner", words_of_label(F.col("key")).alias("key")).agg(F.min("ord").alias("ord"), F.max_by("value", "ord").alias("value"))


def _qualified(keys: DataFrame) -> DataFrame:
    """(owner, route, q, held): the first stored value for each qualifier of a route."""
    words = F.split("key", " ")
    each = keys.select("owner", "ord", "value", words.alias("words"), F.explode(F.array_distinct(words)).alias("q"))
    named, addressed = F.array_contains("words", "name"), F.array_contains("words", "address")
    kinds = F.array(
        F.when(F.col("q").isin(*ALTERNATE) & (named | F.col("q").isin(*ALTERNATE_ALONE)), "alternate"),
        F.when(F.col("q").isin(*ADDRESSES) & addressed, "qualified"),
        F.when(F.col("q").isin(*SCRIPTS) & named, "script"),
    )
    found = each.select("owner", "q", "ord", "value", F.explode(F.array_compact(kinds)).alias("route"))
    place = F.array_position(F.array(*map(F.lit, SECOND_LINE_KEYS)), F.col("key"))
    second = keys.where(F.col("key").isin(*SECOND_LINE_KEYS) & (F.col("value") != "")).select("owner", F.lit("").alias("q"), place.alias("ord"), "value", F.lit("second_line").alias("route"))
    return found.unionByName(second).groupBy("owner", "route", "q").agg(F.min_by("value", "ord").alias("held"))


def prompted(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """(owner, said, held): for each distinct prompt the stored key with the most words that all stand in it.

    A key meets a prompt on the first three letters of its longest word, which the prompt's letters must hold."""
    prompts = asked.select("owner", "said", F.split("said", " ").alias("words"), F.replace("said", F.lit(" "), F.lit("")).alias("joined")).distinct()
    n = F.length("joined")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring("joined", i, F.lit(3))))
    prompts = prompts.where(n >= 3).withColumn("gram", F.explode(grams))
    parts = keys.select("owner", "ord", "value", F.filter(F.split("key", " "), lambda w: F.length(w) > 2).alias("parts")).where("size(parts) > 0")
    parts = parts.where((F.size("parts") >= 2) | F.exists("parts", lambda w: F.length(w) >= 6))
    longest = F.array_max(F.transform("parts", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    parts = parts.withColumn("gram", F.substring(longest.w, 1, 3))
    met = prompts.join(parts.hint("merge"), ["owner", "gram"])
    met = met.where(F.forall("parts", lambda w: (F.length(w) > 1) & F.array_contains("words", w) | F.contains("joined", w)))
    return met.groupBy("owner", "said").agg(F.max_by("value", F.struct(F.size("parts"), -F.col("ord"))).alias("held"))


def concepts_of(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(text, concept) of distinct `texts` (text), which are words already."""
    each = texts.where("text <> ''").distinct()
    return best_concept(each.select(F.col("text").alias("id"), F.col("text").alias("label")), phrases).select(F.col("id").alias("text"), "concept")


def picks(routed: DataFrame, phrases: DataFrame) -> DataFrame:
    """`routed` with `concept`: by the label, else by the field's name; null on every route."""
    free = routed.where("route IS NULL")
    found = written(concepts_of(free.select(F.explode(F.array("said", "named")).alias("text")), phrases), "concepts")  # distinct labels: of known size
    by_label, by_name = (found.select(F.col("text").alias(c), F.col("concept").alias(f"by_{c}")) for c in ("said", "named"))
    met = routed.join(by_label, "said", "left").join(by_name, "named", "left")
    return met.withColumn("concept", F.when(F.col("route").isNull(), F.coalesce("by_said", "by_named"))).drop("by_said", "by_named")


def atoms(keys: DataFrame, phrases: DataFrame) -> DataFrame:
    """(owner, atoms): a map of each concept's stored value, the first key that is one of its phrases."""
    met = keys.join(phrases.select("concept", F.col("phrase").alias("key")).distinct(), "key").groupBy("owner", "concept").agg(F.min_by("value", "ord").alias("value"))
    return met.where("value <> ''").groupBy("owner").agg(F.map_from_entries(F.collect_list(F.struct("concept", "value"))).alias("atoms"))


def _years(birth: Column, today: Column) -> Column:
    """Full years since a date written month first, of two-digit years those up to 30 in this century."""
    part = lambda i: F.regexp_extract(birth, r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})", i)
    year = part(3).cast("int")
    year = F.when((year < 100) & (year > 30), year + 1900).when(year < 100, year + 2000).otherwise(year)
    born = F.try_to_date(F.concat_ws("-", year.cast("string"), part(1), part(2)), "y-M-d")
    n = F.floor(F.months_between(today, born, False) / 12)
    return F.when((n >= 0) & (n < 150), n.cast("string"))


def _atom(concept: str, rules: Rules, today: Column) -> Column:
    at = lambda c: F.try_element_at("atoms", F.lit(c))
    full = F.filter(F.split(F.coalesce(at("full"), F.lit("")), r"\s+"), lambda w: w != "")
    if concept == "given":
        return F.coalesce(at("given"), F.get(full, F.lit(0)))
    if concept == "family":
        return F.coalesce(at("family"), F.try_element_at(full, F.lit(-1)))
    if concept in ("age", "dependent_age"):
        return F.coalesce(at(concept), _years(at(concept.replace("age", "dob")), today))
    if concept == "appdate":
        return F.coalesce(at("appdate"), F.date_format(today, "MM/dd/yyyy"))
    return F.coalesce(*map(at, rules.stand_ins.get(concept, (concept,))))


def atom_value(concept: Column, rules: Rules, today: Column) -> Column:
    """The value of a column of concepts: the stored one, or what stands in for it."""
    derived = ("given", "family", "age", "dependent_age", "appdate", *rules.stand_ins)
    out = F.try_element_at("atoms", concept)
    for c in derived:
        out = F.when(concept == c, _atom(c, rules, today)).otherwise(out)
    return out


def composite_value(concept: Column, rules: Rules, today: Column) -> Column:
    """The value of a column of composites, of the parts that are not in `claimed`."""
    out = F.lit(None).cast("string")
    for name, c in rules.composites.items():
        parts = F.array_compact(F.array(*(F.when(~F.array_contains("claimed", m), F.nullif(_atom(m, rules, today), F.lit(""))) for m in c.members)))
        ways = [F.try_element_at("atoms", F.lit(c.prefer))] if c.prefer else []
        ways.append(F.nullif(F.array_join(parts, c.separator), F.lit("")))
        ways += [F.try_element_at("atoms", F.lit(c.fallback))] if c.fallback else []
        out = F.when(concept == name, F.coalesce(*ways)).otherwise(out)
    return out


def _level(text: Column, rules: Rules) -> Column:
    return F.coalesce(*(F.when(P.has_phrase(text, words), level) for level, words in rules.levels), F.lit(None).cast("string"))


def resolve_forms(fields: DataFrame, vault: DataFrame, phrases: DataFrame, today: Column, rules: Rules | None = None, education: DataFrame | None = None, kinds: DataFrame | None = None) -> DataFrame:
    """(owner, form, pos, value, source) of every field; `source` names the way that gave the value, or that kept it empty.
    `education` (owner, level, rank, kind, value) with `kinds` (ord, concept, phrase) of its parts."""
    rules = rules or Rules()
    keys = written(stored(vault), "keys")
    f = written(picks(written(routes(fields), "routed"), phrases), "picked")  # read for claims, prompts and parts of education as well
    picked = f
    claims = f.where(F.col("concept").isNotNull() & ~F.col("concept").isin(*rules.composites)).groupBy(F.col("owner").alias("_o"), F.col("form").alias("_f")).agg(F.collect_set("concept").alias("claimed"))
    f = f.join(claims.hint("merge"), F.col("owner").eqNullSafe(F.col("_o")) & F.col("form").eqNullSafe(F.col("_f")), "left").drop("_o", "_f")
    f = f.withColumn("claimed", F.coalesce("claimed", F.array().cast("array<string>")))
    f = f.join(_qualified(keys).hint("merge"), ["owner", "route", "q"], "left")
    answers = prompted(f.where("route = 'prompt'"), keys).withColumnRenamed("held", "answer").withColumn("route", F.lit("prompt"))
    f = f.join(answers.hint("merge"), ["owner", "route", "said"], "left")
    own = vault.groupBy("owner", key_of_label(F.col("key")).alias("own_key")).agg(F.min_by("value", "ord").alias("own")).where("own_key <> '' AND own <> ''")
    for c in ("label", "name"):
        f = f.withColumn("own_key", F.when(F.col("route").isNull() | (F.col("route") == "script"), key_of_label(F.col(c)))).join(own.withColumnRenamed("own", f"own_{c}").hint("merge"), ["owner", "own_key"], "left").drop("own_key")
    f = f.join(atoms(keys, phrases).hint("merge"), "owner", "left").withColumn("atoms", F.coalesce("atoms", F.expr("map()").cast("map<string,string>")))
    taught, is_taught = F.lit(None).cast("string"), F.lit(False)
    if education is not None and kinds is not None:
        f = f.join(written(concepts_of(picked.where("route IS NULL").select(F.col("said").alias("text")), kinds), "kinds").withColumnsRenamed({"text": "said", "concept": "kind"}), "said", "left")
        once = education.groupBy("owner", "level", "kind").agg(F.min("value").alias("value"), F.max("rank").alias("rank"))
        held = once.groupBy("owner").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "level", "kind"), F.col("value")))).alias("taught"), F.max_by("level", "rank").alias("highest"))
        f = f.join(held.hint("merge"), "owner", "left")
        level = _level(F.concat_ws(" ", "said", "named"), rules)
        has = F.exists(F.map_keys("taught"), lambda k: F.startswith(k, F.concat(level, F.lit(" "))))
        level = F.when(has, level).otherwise(F.col("highest"))
        taught = F.nullif(F.try_element_at("taught", F.concat_ws(" ", level, F.col("kind"))), F.lit(""))
        is_taught = F.col("taught").isNotNull() & F.col("kind").isNotNull()
    short = (P.has_phrase(F.col("said"), ("initial", "init")) | (F.col("max_length") == 1)) & F.coalesce(F.col("concept").isin(*rules.names), F.lit(False))
    cut = lambda v: F.when(short, F.nullif(initial(v), F.lit(""))).otherwise(v)
    mine = F.coalesce("own_label", "own_name")
    known = F.col("route").isNull()
    whole = F.col("concept").isin(*rules.composites)
    value = (
        F.when(F.col("route") == "prompt", F.nullif("answer", F.lit("")))
        .when(F.col("route") == "script", F.coalesce(F.nullif("held", F.lit("")), mine))
        .when(~known, F.nullif("held", F.lit("")))
        .when(mine.isNotNull(), cut(mine))
        .when(is_taught, taught)
        .when(whole, cut(composite_value(F.col("concept"), rules, today)))
        .otherwise(cut(F.nullif(atom_value(F.col("concept"), rules, today), F.lit(""))))
    )
    source = F.coalesce("route", F.when(mine.isNotNull(), "own").when(is_taught, "education").when(whole, "composite").when(F.col("concept").isNotNull(), "atom"), F.lit("none"))
    return f.select("owner", "form", "pos", value.alias("value"), source.alias("source"))
