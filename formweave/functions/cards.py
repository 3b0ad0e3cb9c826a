"""Unlabelled identity cards: a staged scan of lines, in which later stages see what earlier ones left.

Lines in capitals are candidates for names; a line that begins with the number of the family name's field is surer. Streets
are numbers and words up to a word for a street, cities stand before a state, dates are ranked by class: the oldest that
can be a birth, the furthest in the future as expiry, the newest past one that is neither as issue. Column expressions over
arrays of a text's lines; nothing leaves the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words for streets, states of the USA, words that aren't names.
STREETS = "WAY ST STREET AVE AVENUE RD ROAD DR DRIVE LN LANE BLVD BOULEVARD CT COURT CIR PL PLACE TER TERRACE HWY PKWY TRL LOOP".split()
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split()
STOP = "DRIVER LICENSE LICENCE IDENTIFICATION CLASS RESTR ENDORS DONOR ORGAN EYES HAIR VETERAN COMMISSIONER".split()
STOP_WORDS = "SEX HGT WGT ISS EXP DLN DOB USA".split()
_STREET = r"\b(" + "|".join(STREETS) + r")\b"
_STATE = "(" + "|".join(STATES) + ")"
_NOT_NAME = r"(?i)" + "|".join(STOP) + r"|\b(" + "|".join(STOP_WORDS) + r")\b"
_DATE = r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b"
_WORD = "[A-Z][A-Z'’.]+"


def _none(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _is_name(c: Column) -> Column:
    return ~c.rlike(_STREET) & ~c.rlike(rf"\b{_STATE}\b") & ~c.rlike(_NOT_NAME)


def _letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^A-Z]", ""))


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return _none(F.regexp_extract(c, pattern, group))


def card_values(docs: DataFrame, year: int) -> DataFrame:
    """(doc_id, family, given, middle, street, city, state, zip, born, expires, issued) of texts (doc_id, text), as of `year`; a
    part that no stage finds is null."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("text"), F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines"))
    named = F.transform("lines", lambda x: F.regexp_extract(x, rf"^(?:\d{{1,2}}[a-z]?\s+)?({_WORD}(?:\s+{_WORD}){{0,3}})$", 1))
    d = d.withColumn("names", F.filter(named, lambda x: (x != "") & _is_name(x) & (_letters(x) >= 3)))
    marked = F.get(F.filter("lines", lambda x: x.rlike(r"^1[\s.:_-]+[A-Z]")), F.lit(0))
    tokens = F.filter(F.split(F.regexp_extract(marked, r"^1[\s.:_-]+(.+)$", 1), r"\s+"), lambda x: x.rlike(f"^{_WORD}$") & _is_name(x))
    d = d.withColumn("sure", _none(F.array_join(tokens, " ")))
    # the longest candidate that doesn't begin with the sure family name; the first of equals
    others = F.filter("names", lambda x: F.coalesce(F.split_part(x, F.lit(" "), F.lit(1)) != F.split_part("sure", F.lit(" "), F.lit(1)), F.lit(True)))
    ranked = F.array_sort(F.transform(others, lambda x, i: F.struct((-_letters(x)).alias("n"), i.alias("i"), x.alias("x"))))
    d = d.withColumn("best", F.coalesce(F.get(ranked, F.lit(0)).x, F.get("names", F.lit(0))))
    parts, n = F.split("best", r"\s+"), F.size(F.split("best", r"\s+"))
    two_lines = F.col("sure").isNull() & (F.size("names") >= 2) & (F.col("best") == F.try_element_at("names", F.lit(-1)))
    family = F.coalesce("sure", F.when(two_lines, F.split_part(F.get("names", F.lit(0)), F.lit(" "), F.lit(1))).when(n >= 2, F.try_element_at(parts, F.lit(-1))))
    rest = F.when(F.col("sure").isNotNull() | two_lines, F.slice(parts, 2, F.greatest(n - 1, F.lit(0)))).otherwise(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))))
    # noisy scans without a candidate: the numbers of the fields
    sur, giv = _first(F.col("text"), r"(?:^|[\s—-])1\s+([A-Z][A-Z'’]{2,})\b"), _first(F.col("text"), r"(?:^|\s)2\s+([A-Z][A-Z'’]{2,}(?:\s+[A-Z][A-Z'’]+)*)")
    noisy = F.col("best").isNull() & F.col("sure").isNull()
    d = d.withColumns(
        {
            "family": F.when(noisy, F.when(~sur.rlike(_NOT_NAME), sur)).otherwise(family),
            "given": F.when(noisy, F.split_part(giv, F.lit(" "), F.lit(1))).otherwise(F.get(parts, F.lit(0))),
            "middle": _none(F.array_join(F.when(noisy, F.slice(F.split(giv, r"\s+"), 2, 9)).otherwise(rest), " ")),
        }
    )
    streets = F.filter(F.transform("lines", lambda x: F.regexp_extract(x, rf"(\d{{2,}}\s+[A-Z][A-Za-z .]*?{_STREET})", 1)), lambda x: x != "")
    d = d.withColumn("line", F.get(streets, F.lit(0)))
    beside = F.coalesce(F.replace("text", "line", F.lit(" ")), F.col("text"))  # the number of the street found is no code
    city = r"([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,3}?)[,\s]+" + _STATE + r"(?=\d|\b)"
    places = F.transform("lines", lambda x: F.struct(F.regexp_extract(x, city, 1).alias("city"), F.regexp_extract(x, city, 2).alias("state")))
    fits = lambda x: (x.city != "") & ~x.city.rlike(_NOT_NAME) & ~x.city.rlike(_STREET) & (x.city.rlike(r"\s") | (F.length(x.city) >= 5))
    d = d.withColumn("place", F.get(F.filter(places, fits), F.lit(0)))
    of = lambda x: F.regexp_extract(x, r"(\d{2,4})$", 1)
    full = lambda x: F.when(F.length(of(x)) > 2, of(x).cast("int")).when(of(x).cast("int") > year % 100, of(x).cast("int") + 1900).otherwise(of(x).cast("int") + 2000)
    dates = F.transform(F.regexp_extract_all("text", F.lit(f"({_DATE})"), F.lit(1)), lambda x, i: F.struct(full(x).alias("y"), i.alias("i"), x.alias("x")))
    d = d.withColumn("dates", dates)
    oldest = lambda keep: F.get(F.array_sort(F.filter("dates", keep)), F.lit(0)).x
    newest = lambda keep: F.get(F.array_sort(F.transform(F.filter("dates", keep), lambda x: F.struct((-x.y).alias("y"), x.i.alias("i"), x.x.alias("x")))), F.lit(0)).x
    said = lambda word: _first(F.col("text"), rf"(?i)\b{word}\b[^0-9]{{0,8}}({_DATE[2:-2]})")
    d = d.withColumn("born", oldest(lambda x: (x.y >= 1900) & (x.y <= year - 14)))
    d = d.withColumn("expires", F.coalesce(said("EXP"), newest(lambda x: x.y > year)))
    past = newest(lambda x: (x.y <= year) & (x.y > year - 20) & ~x.x.eqNullSafe(F.col("born")) & ~x.x.eqNullSafe(F.col("expires")))
    d = d.withColumn("issued", F.coalesce(said("ISS"), past))
    return d.select(
        "doc_id", "family", "given", "middle", F.regexp_replace("line", r"\s+", " ").alias("street"), F.col("place.city").alias("city"), F.col("place.state").alias("state"),
        _first(F.when(F.col("text").rlike("[0-9]{5}"), beside), r"\b(?:[A-Z]{2})?(\d{5})(?:-\d{4})?\b").alias("zip"), "born", "expires", "issued",
    )
