"""Operator 4, n-gram Jaccard join with adaptive multi-match prefixes.

A document's set is that of its word shingles, as 64-bit hashes; documents of equal sets are one class. The shingles of
a class stand in a global order, rare ones first: what the corpus holds often is counted over all documents, and the
HEAVY most frequent of it are broadcast (others count as rare; the order decides only cost, never results). Two sets
that link share their first l common shingles within the first n - need + l of either, for every l. A class takes the l
of the least estimated cost, from the frequencies in its prefix, and a pair needs the smaller l of the two in common.

Each of these common shingles also stands early enough for the rest of both sets to make up the overlap. Pairs are not
expanded within groups of copies. A class is first verified against one centre, the class of its posting lists whose
shingles most others share. In lists that then still hold several components, those of SHORT_LIST classes are paired
directly. Classes of longer lists meet on what is not common: each is taken as its difference from the list's centre, and
two classes that do not both link with the centre are similar only if they share rare parts of their differences, so the
pairs do not grow with the square of a group. Every pair that could join two components is verified by exact set sizes,
so components are exact (up to collisions of 64-bit hashes, of the order of N*N/2**65 for N classes).

Defined results: null texts and texts without words have empty sets, link with nothing and are their own component; rows
of one id are each returned; a row with a null id links with nothing, its component is null; extra columns are ignored
by `near_duplicates` and kept by `keep_one`; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formweave.llm.common import arrow_map, forget, sifted, slices, table, written
from formweave.llm.components import connected_components

WORDS, PERCENT = 4, 85
#: Shingles in the frequency order, and those of a slice that are counted beyond it. Bounds of a statistic for the order.
HEAVY, HEAVY_SLICE, HEAVY_LEAST = 1 << 18, 20_000, 4
MOST_MATCHES = 256
#: Classes in a posting list whose members are paired directly; those of longer lists meet on their differences from its centre.
SHORT_LIST = 16
#: Bytes of text whose words are held at once.
WORK_BYTES = 2 << 20
#: Estimated costs of reading a posting, and of verifying a candidate: at least, and a shingle.
READ_COST, VERIFY_COST, VERIFY_SHINGLE = 1.0, 20.0, 0.05
_MIX1, _MIX2, _BASE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array | list[bytes | None], k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Words are runs between ASCII white space, A-Z lower-cased. What is
    made on the way, some ten times the text, is that of WORK_BYTES of text at once, or of one longer text."""
    rows = pa.record_batch([pa.array(texts, pa.binary())], ["text"])
    return [s for piece in slices([rows], "text", WORK_BYTES) for s in _shingle_sets(piece.column("text"), k)]


def _shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    import xxhash

    lowered = pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string()))
    lists = pc.ascii_split_whitespace(lowered)
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)  # white space at either end of a text leaves an empty word
    if (n_words := pc.sum(real).as_py() or 0) < len(words):
        ends = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[ends]
        words = words.filter(real)
    kinds = words.dictionary_encode()
    value = np.fromiter(map(xxhash.xxh3_64_intdigest, kinds.dictionary.view(pa.binary()).to_pylist()), np.uint64, len(kinds.dictionary))
    h = value[kinds.indices.to_numpy()] if n_words else np.empty(0, np.uint64)
    acc = np.full(max(0, n_words - k + 1), k, np.uint64)
    for j in range(k):
        acc = acc * _BASE + h[j : j + len(acc)]
    acc, out = _mix(acc), []
    for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if end - start >= k:
            x = np.sort(acc[start : end - k + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x)
        elif end > start:
            few = np.full(1, end - start, np.uint64)
            for j in range(start, end):
                few = few * _BASE + h[j]
            out.append(_mix(few))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _describe(src: DataFrame, k: int) -> DataFrame:
    """One pass: rows (id, n, sig) of documents with rows (token, count) of what is frequent in a slice."""

    def work(piece: pa.RecordBatch) -> list[pa.RecordBatch]:
        sets = shingle_sets(piece.column("text"), k)
        sigs = [signature(s) if len(s) else None for s in sets]
        docs = pa.record_batch([piece.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.int64()), pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.int64()), piece.column("mark")], names)
        tokens, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *dict(zip(sigs, sets, strict=True)).values()]), return_counts=True)
        often = np.flatnonzero(counts >= HEAVY_LEAST)
        often = often[np.argsort(-counts[often], kind="stable")[:HEAVY_SLICE]]
        nothing = pa.nulls(len(often), pa.int64())
        return [docs, pa.record_batch([pa.nulls(len(often), piece.schema.field("id").type), nothing, nothing, pa.array(_signed(tokens[often])), pa.array(counts[often].astype(np.int64)), nothing], names)]

    names = ["id", "n", "sig", "token", "count", "mark"]
    return arrow_map(src, work, f"id {src.schema['id'].dataType.simpleString()}, n long, sig long, token long, count long, mark long", "text")


def _cheapest(reads: np.ndarray, n: int) -> int:
    """The number of matches l of the least estimated cost, `reads` being the postings of prefixes for l = 1, 2, ..."""
    return int(np.argmin(reads * (READ_COST + (VERIFY_COST + VERIFY_SHINGLE * n) / np.arange(1, len(reads) + 1)))) + 1


@lru_cache(1 << 16)
def least_matches(n: int, percent: int) -> int:
    """Any set of n shingles has at least so many matches: three quarters of what is cheapest for unknown frequencies.
    It does not fall as n grows."""
    need = -(-percent * n // 100)
    return max(1, 3 * _cheapest(n - need + np.arange(1.0, min(MOST_MATCHES, need) + 1), n) // 4)


def prefix_plan(frequency: np.ndarray, need: int, percent: int) -> int:
    """The number of matches of a set, for frequencies in the global order."""
    n = len(frequency)
    reads = np.cumsum(frequency)[n - need : n - need + min(MOST_MATCHES, need)].astype(float)
    return max(least_matches(n, percent), _cheapest(reads, n))


class _Order:
    """Frequencies of shingles as far as they are known: those of the broadcast table, 1 for all others."""

    SLOTS = 1 << 22

    def __init__(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        self.tokens, self.counts = tokens, counts
        self.slots = np.zeros(self.SLOTS, bool)
        self.slots[(tokens & np.uint64(self.SLOTS - 1)).astype(np.int64)] = True

    def of(self, s: np.ndarray) -> np.ndarray:
        out = np.ones(len(s), np.int64)
        maybe = np.flatnonzero(self.slots[(s & np.uint64(self.SLOTS - 1)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.tokens, s[maybe]), len(self.tokens) - 1)
            out[maybe] = np.where(self.tokens[at] == s[maybe], self.counts[at], 1)
        return out


def _postings(src: DataFrame, k: int, percent: int, heavy) -> DataFrame:
    """(token, node, n, l, least, i) of the prefixes of all classes: l matches for n shingles, and what any class of similar
    size has at least; i the place in the order. A class comes once from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _Order(*heavy.value)
        done: set[int] = set()
        for piece in slices(batches, "text"):
            sets = shingle_sets(piece.column("text"), k)
            frequencies = np.split(order.of(np.concatenate([np.empty(0, np.uint64), *sets])), np.cumsum([len(s) for s in sets])[:-1])
            parts: list[tuple[np.ndarray, int, int, int, int]] = []
            for s, frequency in zip(sets, frequencies, strict=True):
                if not len(s) or (sig := signature(s)) in done:
                    continue
                done.add(sig)
                if frequency.max() > 1:
                    by = np.argsort(frequency, kind="stable")
                    s, frequency = s[by], frequency[by]
                need = -(-percent * len(s) // 100)
                matches = prefix_plan(frequency, need, percent)
                parts.append((s[: len(s) - need + matches], sig, len(s), matches, least_matches(need, percent)))
            if parts:
                sizes = [len(p[0]) for p in parts]
                columns = [np.repeat(np.array([p[i] for p in parts], t), sizes) for i, t in ((1, np.int64), (2, np.int32), (3, np.int32), (4, np.int32))]
                columns.append(np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]))
                yield pa.record_batch([pa.array(_signed(np.concatenate([p[0] for p in parts]))), *map(pa.array, columns)], ["token", "node", "n", "l", "least", "i"])

    return src.mapInArrow(run, "token long, node long, n int, l int, least int, i int")


def _fits(a: str, b: str, percent: int) -> str:
    """A condition on two postings of a token that every pair of similar sets meets at its first l common tokens: sizes,
    and places early enough that what follows can still make up the overlap."""
    sizes = f"100L * least({a}.n, {b}.n) >= {percent}L * greatest({a}.n, {b}.n)"
    early = (f"{100 + percent}L * ({x}.n - {x}.i + least({a}.l, {b}.l) - 1) >= {percent}L * ({a}.n + {b}.n)" for x in (a, b))
    return " AND ".join([sizes, *early])


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """`pairs` (a, b, ...) with the texts of both."""
    left, right = (texts.select(F.col("sig").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")
    return pairs.join(right, "b").join(left, "a").select(*pairs.columns, "text_a", "text_b")


def _sets_of(piece: pa.RecordBatch, k: int) -> dict[int, np.ndarray]:
    known: dict[int, bytes] = {}
    for side in "ab":
        known.update(zip(piece.column(side).to_pylist(), piece.column(f"text_{side}").to_pylist(), strict=True))
    return dict(zip(known, shingle_sets(list(known.values()), k), strict=True))


def _verified(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b, text_a, text_b) of classes those whose sets are similar enough, by exact sizes."""

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        sets, keep = _sets_of(piece, k), []
        for a, b in zip(piece.column("a").to_pylist(), piece.column("b").to_pylist(), strict=True):
            x, y = sets[a], sets[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        return piece.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return arrow_map(pairs, work, "a long, b long", "text_b")


def _differences(members: DataFrame, k: int, percent: int, heavy) -> DataFrame:
    """(p, x, token, n, d, i, short) of members (a: the centre p, b: x, text_a, text_b) of the lists of a centre.

    A member's difference is the set of shingles that only one of x and p has. For two members the differences differ
    exactly where their sets do; so, unless both link with p, similar ones share at least half of what is over the
    allowed distance, and so a shingle of their prefixes: as many as the distance to the largest similar set, and for
    the smaller difference half of that (`short`). What x adds comes before what it lacks, rare before frequent. A
    member that links with its centre also gives a row without a token, whose `short` is null."""
    names = ["p", "x", "token", "n", "d", "i", "short"]

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        order, sets = _Order(*heavy.value), _sets_of(piece, k)
        rows: list[tuple] = []
        for p, x in zip(piece.column("a").to_pylist(), piece.column("b").to_pylist(), strict=True):
            own, centre = sets[x], sets[p]
            more, less = np.setdiff1d(own, centre, assume_unique=True), np.setdiff1d(centre, own, assume_unique=True)
            n, d = len(own), len(more) + len(less)
            more = more[np.argsort(order.of(more), kind="stable")]
            most = (100 - percent) * n // percent
            prefix = np.concatenate([more, less])[: most + 1]
            if (100 + percent) * d <= (100 - percent) * (n + len(centre)):
                rows.append((p, x, None, n, d, 0, None))
            rows += [(p, x, t, n, d, i, i <= most // 2) for i, t in enumerate(_signed(prefix).tolist())]
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.bool_()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return arrow_map(members, work, "p long, x long, token long, n int, d int, i int, short boolean", "text_b")


def _components(edges: DataFrame) -> DataFrame:
    return written(connected_components(edges), "components", rows=2 * edges.count()).select("node", F.col("component").alias("c"))


def _in_component(rows: DataFrame, components: DataFrame, node: str, c: str) -> DataFrame:
    """`rows` with the component `c` of the class `node`: the class itself where it has no links."""
    found = components.select(F.col("node").alias("_node"), F.col("c").alias(c))
    return rows.join(found, F.col(node) == F.col("_node"), "left").drop("_node").withColumn(c, F.coalesce(c, node))


def _left_over(live: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """`live` with c, the rows of the lists that still hold several components, and of each class (node): `last`, counting its shingles from the most frequent one; `long`, how many of them
    are in lists of over SHORT_LIST classes."""
    named = _in_component(live, components, "node", "c")
    several = named.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
    node = Window.partitionBy("node")
    return named.join(several, "token", "left_semi").withColumns(
        {
            "long": F.sum((F.col("m") > SHORT_LIST).cast("int")).over(node),
            "last": F.row_number().over(node.orderBy(F.desc("m"), "token")),
        }
    )


def link_classes(src: DataFrame, classes: DataFrame, k: int, percent: int, heavy) -> DataFrame:
    """(node, c): the components of classes (sig, id, mark) that link with another; `src` is (id, text, mark)."""
    by_token = Window.partitionBy("token")
    spread = _postings(src, k, percent, heavy).repartition("token").groupBy("token", "node").agg(*(F.min(c).alias(c) for c in ("n", "l", "least", "i")))
    live = written(spread.withColumn("m", F.count(F.lit(1)).over(by_token)).where("m > 1"), "postings")
    # of a list that class is the centre whose shingles most others share: what links within a group mostly links with it
    weights = live.groupBy("node").agg(F.sum("m").alias("w"))
    heads = live.join(weights, "node").groupBy("token").agg(F.max_by(F.struct("node", "n", "l", "i"), F.struct("w", "node")).alias("p"))
    heads = written(heads, "heads")
    met = live.alias("x").join(heads, "token").where("p.node <> x.node")
    nearest = met.where(_fits("p", "x", percent)).groupBy(F.col("p.node").alias("a"), F.col("x.node").alias("b")).agg(F.count(F.lit(1)).alias("m"), F.min(F.least("p.l", "x.l")).alias("l"))
    nearest = written(nearest.where("m >= l").groupBy("b").agg(F.max_by("a", F.struct("m", "a")).alias("a")).select("a", "b"), "pairs")
    texts = _texts(src, classes, nearest)
    edges = written(_verified(_with_texts(nearest, texts), k, percent), "edges")
    forget(texts)
    components = _components(edges)

    left = written(_left_over(live, components, percent), "postings")
    forget(live)
    x, y = (left.where(F.col("m") <= SHORT_LIST).alias(a) for a in "xy")
    short = x.join(y, F.expr(f"x.token = y.token AND x.c < y.c AND {_fits('x', 'y', percent)}"))
    short = short.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count(F.lit(1)).alias("m"), F.min(F.least("x.l", "y.l")).alias("l"), F.min(F.least("x.long", "y.long")).alias("long"))
    short = short.where("m + long >= l").select("a", "b")
    # similar classes share `least` shingles, so the rarest of these is not among the least - 1 most frequent of either
    members = left.where((F.col("m") > SHORT_LIST) & (F.col("last") >= F.col("least"))).select("token", F.col("node").alias("b"))
    members = members.join(heads.select("token", F.col("p.node").alias("a")), "token").where("a <> b").select("a", "b").distinct()
    short, members = written(short, "pairs"), written(members, "members")
    texts = _texts(src, classes, short.unionByName(members))
    found = written(_differences(_with_texts(members, texts), k, percent, heavy), "differences")
    linked = found.where("token IS NULL").select(F.col("p").alias("a"), F.col("x").alias("b"))
    named = _in_component(found.where("token IS NOT NULL"), components, "x", "c")
    u, v = named.where("short").alias("u"), named.alias("v")
    allowed = f"({100 - percent}L * (u.n + v.n) DIV {100 + percent})"
    fits = f"u.d <= v.d AND u.c <> v.c AND 100L * least(u.n, v.n) >= {percent}L * greatest(u.n, v.n) AND 2 * least(u.d - u.i, v.d - v.i) >= u.d + v.d - {allowed}"
    differing = u.join(v, F.expr(f"u.p = v.p AND u.token = v.token AND {fits}")).select(F.least("u.x", "v.x").alias("a"), F.greatest("u.x", "v.x").alias("b"))
    more = _verified(_with_texts(short.unionByName(differing.distinct()), texts), k, percent)
    edges = written(edges.unionByName(linked).unionByName(more), "edges")
    forget(texts)
    return _components(edges)


def _texts(src: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sig, text) of the classes of `pairs` (a, b), as a written table; most other texts are kept from the shuffle."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    chosen = written(classes.join(wanted, "sig"), "chosen", rows=2 * pairs.count())
    maybe = sifted(src, "mark", chosen).select("id", "mark", "text")
    return written(maybe.join(chosen, ["id", "mark"]).dropDuplicates(["sig"]).select("sig", "text"), "texts")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component) of every row; the component is the least id reachable by links."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).withColumn("mark", F.xxhash64("text"))
    described = written(_describe(src, words), "sets")
    often = described.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("count"))
    often = often.orderBy(F.desc("count"), "token").limit(HEAVY).toPandas().sort_values("token", key=lambda x: x.astype("int64").to_numpy().view(np.uint64))
    heavy = df.sparkSession.sparkContext.broadcast((often["token"].to_numpy(np.int64).view(np.uint64), often["count"].to_numpy(np.int64)))
    docs = described.where("count IS NULL").select("id", "n", "sig", "mark")
    classes = docs.where("sig IS NOT NULL AND id IS NOT NULL").groupBy("sig").agg(F.min(F.struct("id", "mark")).alias("x")).select("sig", "x.id", "x.mark")
    linked = link_classes(src, classes, words, percent, heavy)
    least = linked.withColumnRenamed("node", "sig").join(classes, "sig")
    heads = least.groupBy("c").agg(F.min("id").alias("head"))
    heads = least.join(heads, "c").select("sig", "head")
    found = docs.join(classes.select("sig", F.col("id").alias("first")), "sig", "left").join(heads, "sig", "left")
    component = F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("head", "first", "id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(df: DataFrame, id_col: str, text_col: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `df`, all columns, of one document of each component: its least id. Of rows of that id, all stay."""
    found = near_duplicates(df.select(id_col, text_col), id_col, text_col, words, percent)
    gone = found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("_formweave_id")).distinct()
    return df.join(gone, df[id_col] == F.col("_formweave_id"), "left_anti")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def brute_force(documents: list[tuple[int, str | None]], words: int = WORDS, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """All pairs, plain sets, for tests."""
    sets = {}
    for doc, text in documents:
        ws = (text or "").encode().lower().split()
        sets[doc] = {tuple(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))} if ws else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = sorted((root(a), root(b)))
                    parent[q] = p
    return {d: (len(s), root(d)) for d, s in sets.items()}
