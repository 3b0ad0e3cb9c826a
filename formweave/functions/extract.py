"""Information extraction from text: lines, cards, phones, addresses of mail, search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.functions.text import decode_entities, strip_tags, unwrap_redirect


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line) of all non-blank lines."""
    each = docs.select("doc_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("pos", "line"))
    return each.withColumn("line", F.trim("line")).where("line <> ''")


def next_line_values(docs: DataFrame, label: str) -> DataFrame:
    """(doc_id, value): the line after the first line that is the label alone."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("pos")
    each = lines(docs).withColumn("value", F.lead("line").over(w)).where((F.lower("line") == label) & F.col("value").isNotNull())
    return each.groupBy("doc_id").agg(F.min_by("value", "pos").alias("value"))


def email(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0), F.lit(""))


def card_number(c: Column) -> Column:
    """The first run of 13 to 19 digits that passes the check digit, in groups of four."""
    runs = F.transform(F.regexp_extract_all(c, F.lit(r"(?<![0-9])((?:[0-9][ -]?){12,18}[0-9])(?![0-9])"), F.lit(1)), lambda x: F.regexp_replace(x, "[^0-9]", ""))
    valid = F.filter(runs, lambda x: F.call_function("luhn_check", x))
    return F.trim(F.regexp_replace(F.get(valid, F.lit(0)), "([0-9]{4})", "$1 "))


def phone(c: Column) -> Column:
    """The first number of 10 digits, or 11 after a 1, that is written with separators."""
    runs = F.regexp_extract_all(c, F.lit(r"(?<![0-9])(\+?[0-9(][0-9() .-]{8,16}[0-9])(?![0-9])"), F.lit(1))
    fits = lambda x: (F.regexp_replace(x, "[^0-9]", "").rlike("^1?[0-9]{10}$")) & x.rlike("[() .-]")
    return F.get(F.filter(runs, fits), F.lit(0))


def search_results(pages: DataFrame, param: str = "uddg", most: int = 10) -> DataFrame:
    """(page_id, pos, url, title): the first links of a result page, redirects unwrapped, http only, titled only."""
    found = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(r"(?s)<a [^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>"), F.lit(1)).alias("href"),
        F.regexp_extract_all("html", F.lit(r"(?s)<a [^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>"), F.lit(2)).alias("title"),
    )
    each = pages.select("page_id", F.posexplode(found).alias("pos", "r"))
    rows = each.select("page_id", "pos", unwrap_redirect(decode_entities(F.col("r.href")), param).alias("url"), F.trim(decode_entities(strip_tags(F.col("r.title")))).alias("title"))
    kept = rows.where("url RLIKE '^https?://' AND title <> ''")
    top = kept.groupBy("page_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "url", "title"))), 1, most).alias("r"))
    return top.select("page_id", F.explode("r").alias("r")).select("page_id", "r.*")


def segments(words: DataFrame) -> DataFrame:
    """(line, seg, text): recognised words cut at box markers (a-h, 1-2 digits, 12a); a running count of markers names
    the segment."""
    from pyspark.sql import Window

    w = Window.partitionBy("line").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    marked = words.withColumn("seg", F.sum(F.when(F.col("word").rlike("^([a-h]|[0-9]{1,2}[a-z]?)$"), 1).otherwise(0)).over(w))
    parts = F.array_sort(F.collect_list(F.struct("x", "word")))
    return marked.groupBy("line", "seg").agg(F.array_join(F.transform(parts, lambda p: p.word), " ").alias("text"))
