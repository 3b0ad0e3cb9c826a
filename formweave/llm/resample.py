"""Operator 13, importance resampling towards a target distribution by hashed word n-grams.

Words of whole texts are exploded with their positions; lead() windows over a document's positions join each word with
those that follow, for every order; the n-grams are hashed into buckets and counted. A bucket's gain is the logarithm of
its smoothed share in the target over that in the source; gains are joined back to the positions and summed by document.
A document's score is its weight with Gumbel noise from a hash of its id, so that the highest scores are a draw without
replacement, the same on each run.

Texts are dealt by row before they are exploded, so that the window, which reads one row's words, needs no shuffle of
words; a task holds about PART_BYTES of text, or one text that is longer. The table of gains has one row a bucket, and so
is broadcast. Ranks come from a sort by ranges: each range is numbered on its own, after the sizes of those before it.

Defined results: null texts and texts without words have no features and weight 0; they are scored but not drawn; rows of
one id are each returned and drawn on their own (ties of score and id in the order of the input); a null id hashes as an empty one,
and comes last among equal scores; extra columns are ignored; an empty table gives none, and an empty target smoothed
shares only.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formweave.llm.common import forget, table, written
from formweave.llm.words import words

ORDERS, BUCKETS, PERCENT, MIN_WORDS, SEED = 3, 10_000, 5, 20, 42
#: Bytes of text in a task of the window.
PART_BYTES = 16 << 20


def ngram_positions(df: DataFrame, id_col: str, text_col: str, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(row, id, b1 ... b_orders): a row for each word, with the bucket of the n-gram of each order that begins there, null
    where the text ends before; a single row of nulls for a text without words."""
    held = df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    docs = docs.repartition(1 + held // PART_BYTES, "row")
    placed = docs.select("row", "id", F.posexplode_outer(words(F.col("text"))).alias("pos", "w1"))
    follows = Window.partitionBy("row").orderBy("pos")
    placed = placed.select("row", "id", "w1", *(F.lead("w1", k).over(follows).alias(f"w{k + 1}") for k in range(1, orders)))

    def bucket(k: int) -> Column:
        # concat is null where one of the words is
        text = F.concat(*(x for j in range(1, k + 1) for x in ([F.lit(" ")] if j > 1 else []) + [F.col(f"w{j}")]))
        return F.pmod(F.crc32(text.cast("binary")), F.lit(buckets)).cast("int").alias(f"b{k}")

    return placed.select("row", "id", *(bucket(k) for k in range(1, orders + 1)))


def bucket_counts(positions: DataFrame) -> DataFrame:
    """(bucket, n) over all orders; counted order by order before a shuffle of one row a bucket and task."""
    names = [c for c in positions.columns if c.startswith("b")]
    each = positions.select(F.explode(F.array(*names)).alias("bucket")).where("bucket IS NOT NULL")
    return each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the buckets that `source` (bucket, n) has."""
    total_s, total_t = (df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (source, target))
    s, t = F.col("n").cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    ratio = ((t + 1.0) * float(total_s + buckets)) / ((s + 1.0) * float(total_t + buckets))
    joined = source.join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    return joined.select("bucket", F.floor(1000.0 * F.log(ratio)).alias("gain"))


def document_weights(positions: DataFrame, gains: DataFrame) -> DataFrame:
    """(row, id, n_words, n_features, weight) of every document."""
    names = [c for c in positions.columns if c.startswith("b")]
    for b in names:
        one = gains.select(F.col("bucket").alias(b), F.col("gain").alias(f"g{b}"))
        positions = positions.join(F.broadcast(one), b, "left")  # one row a bucket
    gained = [F.coalesce(F.col(f"g{b}"), F.lit(0)) for b in names]
    features = [F.col(b).isNotNull().cast("long") for b in names]
    return positions.groupBy("row", "id").agg(F.count("b1").alias("n_words"), F.sum(sum(features[1:], features[0])).alias("n_features"), F.sum(sum(gained[1:], gained[0])).alias("weight"))


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise) of a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """`df` with `rank` from 1 in `order`, which must be total for a rank that is the same on each run. Sorted by ranges; a
    range gets its first rank from the sizes of those before it, of which there are as many as partitions."""
    placed = written(df.orderBy(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    numbered = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return numbered.join(F.broadcast(starts), "_range").withColumn("rank", F.col("_start") + F.col("_n")).drop("_range", "_start", "_n")


def resample(df: DataFrame, target: DataFrame, id_col: str, text_col: str, target_text: str, percent: int = PERCENT, min_words: int = MIN_WORDS, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of `df`; rank is null for those that are not drawn."""
    positions = written(ngram_positions(df, id_col, text_col, orders, buckets), "positions")
    source = written(bucket_counts(positions), "source")
    goal = bucket_counts(ngram_positions(target.withColumn("_none", F.lit(None).cast("long")), "_none", target_text, orders, buckets))
    goal = written(goal, "target")
    gains = written(bucket_gains(source, goal, buckets), "gains")
    weighed = document_weights(positions, gains)
    scored = written(weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "scores")
    for t in (positions, source, goal, gains):
        forget(t)
    eligible = scored.where(F.col("n_words") >= min_words)
    drawn = percent * eligible.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    winners = ranked(eligible.select("row", "id", "score"), order).where(F.col("rank") <= drawn).select("row", "rank")
    out = scored.join(winners, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twentieth of `documents`, drawn towards the texts of `benchmark`."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "text")


def brute_force(documents: list[tuple[int, str | None]], target: list[str | None]) -> dict[int, tuple]:
    """Plain loops, for tests; ids are unique and not null."""

    def features(text: str | None) -> tuple[int, Counter]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        runs = (" ".join(ws[i : i + k]) for k in range(1, ORDERS + 1) for i in range(len(ws) - k + 1))
        return len(ws), Counter(zlib.crc32(f.encode()) % BUCKETS for f in runs)

    mine = {d: features(text) for d, text in documents}
    s, t = Counter(), Counter()
    for _, f in mine.values():
        s.update(f)
    for text in target:
        t.update(features(text)[1])
    n_s, n_t = s.total() + BUCKETS, t.total() + BUCKETS
    gain = {b: math.floor(1000 * math.log(float(t[b] + 1) * float(n_s) / (float(s[b] + 1) * float(n_t)))) for b in s}
    out = {}
    for d, (_, f) in mine.items():
        weight = sum(gain[b] * n for b, n in f.items())
        h = int(sha256(f"{SEED}:{d}".encode()).hexdigest()[:8], 16)
        out[d] = (f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    order = sorted((d for d in out if mine[d][0] >= MIN_WORDS), key=lambda d: (-out[d][2], d))
    ranks = {d: i + 1 for i, d in enumerate(order[: PERCENT * len(order) // 100])}
    return {d: (*x, ranks.get(d)) for d, x in out.items()}
