"""Operator 11, SimHash near duplicates found by the pigeonring principle.

A text's fingerprint has a bit set where over half of its 3-word shingles' XXH64 have it set, repeats included. Documents
of equal fingerprints are one class; classes link at MOST or fewer differing bits.

The 64 bits are cut into MOST + 1 segments in a ring. For two fingerprints within MOST bits there is a segment from which
every chain of consecutive segments keeps a proportional budget: the first j of them differ in at most
j * MOST / (MOST + 1) bits, rounded down, so the first not at all and the first two in at most one. The join key is such a
chain of two segments (some 42 bits): each class gives its chains as they are, and probes with each chain and the chains
that differ in one bit of the second segment. Only classes that meet in a key get the full Hamming check.

A key of over SHORT_KEY classes, as a large group of near copies gives, isn't expanded into pairs. Two fingerprints within
two bits have one in common that is within one bit of both; so the classes that meet in a long key each give their
fingerprint and its 64 neighbours of one bit, and all of a neighbour are linked with its least: a row a bit instead of a
row a pair, and exact. Links are joined by a distributed union-find over fingerprints.

Fingerprints that hold over 1 / HOT_PARTS of all rows (so fewer than HOT_PARTS of them) are joined back by broadcast, all
others by a shuffle.

Chains, probes and neighbours are exploded from classes, and Spark takes a table for no larger than what it was exploded from. So they ask
for merge joins: else the probes of a few hundred thousand classes, 20 million rows, are sent to the driver as a broadcast.

Defined results: null texts and texts without words have fingerprint zero and link like any other; fewer than three words are one
shingle; rows of one id are each returned; a row with a null id links with nothing and its component is null; extra
columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm.common import arrow_map, forget, table, written
from formweave.llm.components import connected_components

WORDS, SEED, MOST = 3, 42, 2
#: (first bit, bits) of the ring's segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Classes of a key that are paired directly; those of longer keys meet in neighbours of one bit.
SHORT_KEY = 16
HOT_PARTS = 1000
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: bytes | None) -> list[int]:
    import xxhash

    words = (text or b"").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return []
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < WORDS:
        return [hashed(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -WORDS].tolist()]
    return [hashed(line[a:b], SEED) for a, b in zip(starts, (ends[WORDS - 1 :] - 1).tolist(), strict=True)]


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """Unsigned 64-bit fingerprints. Bits are counted by way of the values of each of the eight bytes."""
    lists = [shingle_hashes(t) for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    h = np.fromiter((x for part in lists for x in part), np.uint64, int(sizes.sum()))
    of = np.repeat(np.arange(len(texts)) * 256, sizes)
    out = np.zeros(len(texts), np.uint64)
    for k in range(8):
        values = ((h >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)
        counts = np.bincount(of + values, minlength=256 * len(texts)).reshape(-1, 256) @ _BITS
        byte = ((2 * counts > sizes[:, None]) << np.arange(8)).sum(axis=1)
        out |= byte.astype(np.uint64) << np.uint64(8 * k)
    return out


def _fingerprinted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) of every row; fp as a signed long."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprints(piece.column("text").slice(at, 512).to_pylist()) for at in range(0, piece.num_rows, 512)]
        return pa.record_batch([piece.column("id"), pa.array(np.concatenate([np.empty(0, np.uint64), *fps]).view(np.int64))], ["id", "fp"])

    return arrow_map(src, work, f"id {src.schema['id'].dataType.simpleString()}, fp long", "text")


def _chain(fp: Column, i: int) -> Column:
    """Segments i and i + 1 of the ring as one number, segment i in the upper part, above them the number of the chain."""
    (a, n), (b, m) = SEGMENTS[i], SEGMENTS[(i + 1) % len(SEGMENTS)]
    first, second = (F.shiftrightunsigned(fp, at).bitwiseAND((1 << bits) - 1) for at, bits in ((a, n), (b, m)))
    return F.shiftleft(F.lit(i).cast("long"), 60).bitwiseOR(F.shiftleft(first, m)).bitwiseOR(second)


def _chains(classes: DataFrame) -> DataFrame:
    """(key, fp): the chains of each class."""
    keys = F.array(*(_chain(F.col("fp"), i) for i in range(len(SEGMENTS))))
    return classes.select(F.explode(keys).alias("key"), "fp").hint("merge")


def _probes(classes: DataFrame) -> DataFrame:
    """(key, fp): the chains of each class, and those with a bit of the second segment turned. The first segments stay equal:
    a budget of none for a chain of one, of one for a chain of two."""
    keys = []
    for i in range(len(SEGMENTS)):
        chain, bits = _chain(F.col("fp"), i), SEGMENTS[(i + 1) % len(SEGMENTS)][1]
        keys += [chain, *(chain.bitwiseXOR(F.lit(1 << b).cast("long")) for b in range(bits))]
    return classes.select(F.explode(F.array(*keys)).alias("key"), "fp").hint("merge")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _neighbour_links(classes: DataFrame) -> DataFrame:
    """(a, b) of classes (fp): each with the least of those that share a fingerprint within one bit; all are within two."""
    bits = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))
    near = classes.select(F.explode(F.transform(bits, lambda x: x.bitwiseXOR(F.col("fp")))).alias("key"), "fp").hint("merge")
    least = near.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("key", "lo")
    return near.join(least, "key").where("fp <> lo").select(F.col("fp").alias("a"), F.col("lo").alias("b")).distinct()


def hamming_links(classes: DataFrame) -> DataFrame:
    """(a, b): links of distinct fingerprints `classes` (fp) that join whatever is within MOST bits, all of them within MOST."""
    chains, probes = _chains(classes), _probes(classes)
    sizes = chains.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("one"))
    met = probes.join(sizes, "key").where("n > 1 OR one <> fp")  # a class always meets itself
    met = written(met, "met")
    short = met.where(F.col("n") <= SHORT_KEY).select("key", F.col("fp").alias("a")).join(chains.select("key", F.col("fp").alias("b")), "key")
    # a pair with no difference in the second segment meets from both sides, any other in one of its two keys
    short = short.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(_distance("a", "b") <= MOST).distinct()
    long = met.where(F.col("n") > SHORT_KEY)
    members = long.select("fp").unionByName(chains.join(long.select("key").distinct(), "key", "left_semi").select("fp")).distinct()
    links = written(short.unionByName(_neighbour_links(members)), "links")
    forget(met)
    return links


def near_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fingerprint, component) of every row; the component is the least id reachable by links."""
    docs = written(_fingerprinted(df, id_col, text_col), "fingerprints")
    known = docs.where("id IS NOT NULL")
    classes = written(known.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    links = hamming_links(classes.select("fp"))
    nodes = written(connected_components(links, "simhash"), "components")
    forget(links)
    linked = nodes.join(classes, F.col("node") == F.col("fp")).select("fp", F.col("component").alias("c"), "first")
    heads = linked.groupBy("c").agg(F.min("first").alias("head"))
    heads = linked.join(heads, "c").select("fp", "head")
    found = classes.join(heads, "fp", "left").select("fp", "n", F.coalesce("head", "first").alias("component_id"))
    found = written(found, "found")
    hot = found.where(F.col("n") * HOT_PARTS > F.lit(known.count())).select("fp", "component_id")
    often = docs.join(F.broadcast(hot), "fp")
    rare = docs.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(found.select("fp", "component_id"), "fp", "left")
    component = F.when(F.col("id").isNotNull(), F.col("component_id"))
    both = often.unionByName(rare)
    return both.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def brute_force(documents: list[tuple[int, str | None]]) -> dict[int, tuple[str, int]]:
    """All pairs, plain loops, for tests; ids are unique and not null."""
    import xxhash

    fps = {}
    for doc, text in documents:
        words = (text or "").encode().lower().split()
        runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        fps[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root, left = {}, set(fps.values())
    by_fp: dict[int, int] = {}
    for doc in sorted(fps):
        by_fp.setdefault(fps[doc], doc)
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 2}
            left -= near
            todo += near
        least = min(by_fp[x] for x in group)
        root |= dict.fromkeys(group, least)
    return {doc: (f"{fp:016x}", root[fp]) for doc, fp in fps.items()}
