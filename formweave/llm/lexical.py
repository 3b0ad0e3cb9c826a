"""Operator 12, exact ranked lexical search over a tiered index.

The index holds a posting for each distinct text and term: the term's weighted impact there. A term's postings are dealt
into tiers by impact, from a histogram of its impacts: the levels of highest impact that hold TIERS[0] postings first, those
that hold TIERS[1] next, then the rest. For each term and tier the highest impact below it is kept, the residual bound. The index is
written by tier, so that lower tiers are read only for items that need them.

An item reads the first tier of its terms. The best texts so far are scored in full, and the tenth gives a threshold.
No text that was not met can score more than the sum of the residual bounds; where that is below the threshold, the item's
result is proven. The other items fall through: of their terms, those whose bounds add up to less than the threshold can't
bring in a text on their own and are read no further; the others are read one tier deeper. At the last tier nothing is
left below, so every item ends exact. Texts whose impacts met and whose bounds of terms not met reach the threshold are
then scored in full.

Equal texts are one entry with its ten least ids, so that copies, however many, neither fill the tiers nor are scored again;
statistics count every document. Entries are known by a 64-bit hash of the text (collisions of the order of N*N/2**65).
Terms, their statistics and thresholds grow with the queries, not the documents: they are broadcast up to
BROADCAST_ROWS rows, and joined by a shuffle beyond.

Defined results: null texts and texts without terms are in no result and not in N; rows of one id are documents of their
own; a document with a null id counts in the statistics but is never returned; a repeated item_id stands for all terms of
its rows; a null item_id gives no rows; items whose terms no document holds, or all of them hold (weight 0), give none;
extra columns are ignored; empty tables give none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formweave.llm.common import forget, table, written
from formweave.llm.words import words

#: Postings of a term, at least, that the first tier and the first two hold.
TIERS = (64, 4096)
#: Width of a level of the histogram of impacts, which go up to 1,000,000.
LEVEL = 1024
TOP = 10
#: Texts of the best sums so far that are scored in full for a threshold; more give a higher one, and so fewer postings to read.
AHEAD = 50
BROADCAST_ROWS = 1_000_000


@dataclass
class TieredIndex:
    """`postings` (tid, key, v, tier); `terms` (term, tid, bound1 ...): what a posting below each tier has at most, 0 below
    the last; `members` (key, id, n): the documents of each text, n only to tell rows apart."""

    postings: DataFrame
    terms: DataFrame
    members: DataFrame


def small(df: DataFrame) -> DataFrame:
    """`df`, a written table, with a broadcast hint if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term) once each."""
    named = items.where(F.col(item_col).isNotNull())
    return named.select(F.col(item_col).alias("item"), F.explode(words(F.col(text_col))).alias("term")).distinct()


def _counts(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(key, n, tid, tf, c, named) of each distinct text and each of the terms of `dictionary` in it; the row of tid -1 stands
    for the text itself, c is the number of its documents, `named` that of those with an id."""
    held = docs.select(F.xxhash64("text").alias("key"), words(F.col("text")).alias("words"))
    marked = held.select("key", F.size("words").alias("n"), F.explode(F.concat(F.array(F.lit("")), "words")).alias("term"))  # no word is empty
    counted = marked.join(small(dictionary), "term").groupBy("key", "n", "tid").agg(F.count(F.lit(1)).alias("all"))
    copies = docs.groupBy(F.xxhash64("text").alias("key")).agg(F.count(F.lit(1)).alias("c"), F.count("id").alias("named"))
    return counted.join(copies, "key").select("key", "n", "tid", F.expr("all DIV c").alias("tf"), "c", "named")


def build_index(df: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> TieredIndex:
    """The index of all rows of `df`, of the distinct `terms` (term)."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    numbered = written(terms.select("term", F.monotonically_increasing_id().alias("tid")), "terms")
    dictionary = written(numbered.unionByName(df.sparkSession.createDataFrame([("", -1)], "term string, tid long")), "dictionary")
    counts = written(_counts(docs, dictionary), "counts")
    whole = F.col("tid") < 0
    n_docs, length = counts.where(whole & (F.col("n") > 0)).agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.col("c") * F.col("n")), F.lit(0))).first()
    weight = F.floor(1000.0 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0)))
    weights = written(counts.where(~whole).groupBy("tid").agg(F.sum("c").alias("df")).select("tid", "df", weight.alias("w")).where("w > 0"), "weights")
    m = f"(10L + (90L * n * {n_docs}L) DIV {max(1, length)}L)"
    impacts = counts.where("named > 0").join(small(weights), "tid").select("tid", "key", "w", F.expr(f"(1000000000L * tf) DIV (1000L * tf + 8L * {m})").alias("u"))
    level = F.expr(f"u DIV {LEVEL}")
    histogram = impacts.groupBy("tid", "w", level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.max("u").alias("top"))
    above = Window.partitionBy("tid").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(above), F.lit(0))
    tier = F.lit(1)
    for size in TIERS:
        tier = tier + (before >= size).cast("int")
    levels = written(histogram.select("tid", "w", "level", "top", tier.alias("tier")), "levels")
    bounds = [F.coalesce(F.max(F.when(F.col("tier") > t, F.col("top") * F.col("w"))), F.lit(0)).alias(f"bound{t}") for t in range(1, len(TIERS) + 2)]
    starts = [F.min(F.when(F.col("tier") <= t, F.col("level"))).alias(f"start{t}") for t in range(1, len(TIERS) + 1)]
    known = written(levels.groupBy("tid").agg(*bounds, *starts), "bounds")
    dealt = impacts.join(small(known.select("tid", *(f"start{t}" for t in range(1, len(TIERS) + 1)))), "tid")
    tier = F.lit(1)
    for t in range(1, len(TIERS) + 1):
        tier = tier + (level < F.col(f"start{t}")).cast("int")
    postings = written(dealt.select("tid", "key", (F.col("u") * F.col("w")).alias("v"), tier.alias("tier")), "postings", "tier")
    for done in (counts, weights, levels, dictionary):
        forget(done)
    members = docs.where("id IS NOT NULL").select(F.xxhash64("text").alias("key"), "id", F.monotonically_increasing_id().alias("n"))
    return TieredIndex(postings, numbered.join(known, "tid").drop(*(f"start{t}" for t in range(1, len(TIERS) + 1))), members)


def _scored(pairs: DataFrame, wanted: DataFrame, postings: DataFrame) -> DataFrame:
    """(item, key, score) of `pairs` (item, key): the whole sum over the item's terms, from all tiers. Pairs meet the postings of
    their text, so that no row for each of an item's terms is shuffled."""
    held = pairs.select("item", "key").join(postings.select("tid", "key", "v"), "key")
    return held.join(small(wanted.select("item", "tid")), ["item", "tid"]).groupBy("item", "key").agg(F.sum("v").alias("score"))


def _first(df: DataFrame, by: str, n: int, order: list[Column]) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n)


def _best(index: TieredIndex, wanted: DataFrame) -> DataFrame:
    """(item, key, score) of each item's ten texts of the highest scores above 0, and all that equal the tenth, as a written
    table; `wanted` is (item, tid, bound1 ...)."""
    last = len(TIERS) + 1
    # `bound`: the most that a posting not read yet brings; `reads`: whether the next tier is read
    now = written(wanted.withColumns({"bound": F.col("bound1"), "reads": F.lit(True)}), "state")
    read, threshold, made = None, None, [now]
    for t in range(1, last + 1):
        tier = index.postings.where(F.col("tier") == t).select("tid", "key", "v")
        more = now.where("reads").select("item", "tid").join(tier, "tid")
        more = written(more.select("item", "tid", "key", "v"), f"read{t}")
        made.append(more)
        read = more if read is None else read.unionByName(more)
        open_items = now.where("reads").select("item").distinct()
        met = read.join(small(written(open_items, "open")), "item").groupBy("item", "key").agg(F.sum("v").alias("met"))
        ahead = _first(met, "item", AHEAD, [F.desc("met"), F.col("key")])
        tenth = _first(_scored(ahead, wanted, index.postings), "item", TOP, [F.desc("score"), F.col("key")])
        tenth = tenth.groupBy("item").agg(F.when(F.count(F.lit(1)) >= TOP, F.min("score")).otherwise(0).alias("t"))
        if threshold is not None:
            tenth = threshold.unionByName(tenth).groupBy("item").agg(F.max("t").alias("t"))
        threshold = written(tenth, "threshold")
        if t == last:
            break
        # terms whose bounds together stay below the threshold need no further reading: a text with no others is not among the
        # ten. Those that were left out before come first, so that no tier of a term is skipped
        running = F.sum("bound").over(Window.partitionBy("item").orderBy("reads", "bound", "tid").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        held = now.join(threshold, "item", "left").withColumn("t", F.coalesce("t", F.lit(0)))
        deeper = held.withColumn("reads", (F.col("bound") > 0) & (running >= F.col("t")))
        now = written(deeper.withColumn("bound", F.when(F.col("reads"), F.col(f"bound{t + 1}")).otherwise(F.col("bound"))).drop("t"), "state")
        if now.where("reads").isEmpty():
            break
    bounds = now.select("item", "tid", "bound")
    total = bounds.groupBy("item").agg(F.sum("bound").alias("all"))
    limits = written(threshold.join(total, "item"), "limits")
    seen = read.join(small(written(bounds, "bounds")), ["item", "tid"]).groupBy("item", "key").agg(F.sum(F.col("v") - F.col("bound")).alias("over"))
    reach = seen.join(small(limits), "item").where(F.col("over") + F.col("all") >= F.col("t")).select("item", "key")
    made.append(written(reach, "reach"))
    best = _scored(made[-1], wanted, index.postings).where("score > 0")
    # ten texts of the highest scores, and those that equal the tenth, whose ids may be less
    by = Window.partitionBy("item").orderBy(F.desc("score"))
    best = written(best.withColumn("place", F.rank().over(by)).where(F.col("place") <= TOP).drop("place"), "best")
    for table_ in made:
        forget(table_)
    return best


def search(index: TieredIndex, items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, rank, id, score): each item's ten documents of the highest scores above 0, equal ones by id."""
    wanted = item_terms(items, item_col, text_col).join(index.terms, "term").drop("term")
    best = _best(index, written(wanted, "wanted"))
    members = _first(index.members.join(best.select("key").distinct(), "key", "left_semi"), "key", TOP, [F.col("id"), F.col("n")])
    found = best.join(members.drop("place"), "key")
    found = _first(found, "item", TOP, [F.desc("score"), F.col("id"), F.col("n")])
    return found.select(F.col("item").alias(item_col), F.col("place").alias("rank"), "id", "score")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten `documents` of the highest scores for each item of `benchmark`."""
    items = table(spark, sf_dir, "benchmark")
    index = build_index(table(spark, sf_dir, "documents"), "doc_id", "text", item_terms(items, "item_id", "text").select("term").distinct())
    return search(index, items, "item_id", "text").withColumnRenamed("id", "doc_id")


OP12_SQL = r"""
WITH words AS (
    SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents
    UNION ALL
    SELECT 'i', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
postings AS (SELECT id, term, count(*) AS tf FROM words WHERE kind = 'd' GROUP BY ALL),
lengths AS (SELECT id, sum(tf)::BIGINT AS n FROM postings GROUP BY id),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, docs),
wanted AS (SELECT DISTINCT id AS item_id, term FROM words WHERE kind = 'i'),
scores AS (
    SELECT item_id, postings.id AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // len)))) AS BIGINT) AS score
    FROM wanted JOIN weights USING (term) JOIN postings USING (term) JOIN lengths ON lengths.id = postings.id, totals GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


def brute_force(documents: list[tuple[int | None, str | None]], items: list[tuple[int, str | None]]) -> list[tuple]:
    """Every item against every document, for tests."""

    def terms(text: str | None) -> list[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    counts = [(d, Counter(terms(text))) for d, text in documents]
    counts = [(d, c) for d, c in counts if c]
    n_docs, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted: dict[int, set[str]] = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, of in wanted.items():
        scores = []
        for d, c in counts:
            m = 10 + (90 * c.total() * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in of if c[t])
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:TOP])]
    return out
