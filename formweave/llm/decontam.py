"""Operator 3, benchmark decontamination with an FM-index in each shard of documents.

A shard is a slice of texts of bounded size. Its words, as ids of the benchmark's vocabulary (1 for every other word and
between documents), get a suffix array, the Burrows-Wheeler transform in a wavelet matrix and a sample of suffix
positions. All benchmark windows are searched backwards at once by ranks in the wavelet matrix; the occurrences are
located by walking back to a sampled position, and overlapping ones merge into removal spans.

The benchmark is broadcast in blocks of at most BLOCK_WORDS words; a larger one takes one pass a block over the shards,
each adding its spans to those before. Documents are never shuffled.

Defined results: null texts and texts without words have no words and no hits; items without words or id are no items;
an empty benchmark hits nothing; repeated documents repeat; other columns are kept by `drop_contaminated`, ignored else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm.common import slices, table

WINDOW = 13
#: Contaminated: that many times the hit words reach the words.
RATIO = 20
SHARD_BYTES = 4 << 20
BLOCK_WORDS = 5_000_000
SAMPLE = 8

#: Word bytes are 0-9, a-z and everything beyond ASCII; A-Z is lower-cased, all else becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def suffix_array(s: np.ndarray, bits: int) -> np.ndarray:
    """Suffixes of s in order; s ends with its only 0. The first sort packs as many symbols as 62 bits hold; prefix
    doubling then sorts only rows that are still tied."""
    n, packed = len(s), max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(packed):
        key <<= bits
        if k < n:
            key[: n - k] |= s[k:]
    sa = np.argsort(key)
    row, rank = np.arange(n), np.empty(n, np.int64)
    key = key[sa]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    rank[sa] = np.maximum.accumulate(np.where(first, row, 0))
    tied = ~(first & np.concatenate([first[1:], [True]]))
    rows, h = row[tied], packed
    while len(rows):
        at = sa[rows]
        behind = at + h
        key = rank[at] * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[rows] = at
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = rows[np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]
        rows = rows[~(first & np.concatenate([first[1:], [True]]))]
        h *= 2
    return sa


class FmIndex:
    """FM-index over ids 1..sigma-1; the end mark 0 is added here."""

    def __init__(self, ids: np.ndarray, sigma: int, sample: int = SAMPLE) -> None:
        s = np.append(ids, 0).astype(np.int32)
        self.n, self.bits = len(s), max(1, int(sigma - 1).bit_length())
        sa = suffix_array(s, self.bits)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        cur = s[sa - 1]
        self.ones, self.zeros = [], []
        for b in reversed(range(self.bits)):
            bit = (cur >> b) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        self.start = self._down(np.arange(sigma), np.zeros(sigma, np.int64))
        marked = sa % sample == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.places = sa[marked]

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
            k = ones[i]
            i = np.where((symbol >> b) & 1, zeros + k, i - k)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i symbols of the transform equal `symbol`."""
        return self._down(symbol, i) - self.start[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns, which stand at the right of their matrix rows; all are extended together."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for t in range(patterns.shape[1]):
            live = live[(lengths[live] > t) & (high[live] > low[live])]
            if not len(live):
                break
            c = patterns[live, -1 - t]
            low[live] = self.less[c] + self.rank(c, low[live])
            high[live] = self.less[c] + self.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: each walks back until its position is sampled."""
        out, steps, left, rows = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(left):
            found = self.marks[rows + 1] > self.marks[rows]
            out[left[found]] = self.places[self.marks[rows[found]]] + steps
            left, rows = left[~found], rows[~found]
            symbol, i = np.zeros(len(rows), np.int64), rows
            for b, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
                k = ones[i]
                bit = ones[i + 1] - k
                symbol |= bit.astype(np.int64) << b
                i = np.where(bit, zeros + k, i - k)
            rows = self.less[symbol] + i - self.start[symbol]
            steps += 1
        return out


class Phrases:
    """The windows of a block of items: ids, lengths, and for each distinct window the items that have it."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.names = [name for name, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(k)
        self.sigma = len(self.vocabulary) + 2
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.windows = np.zeros((len(found), window), np.int64)
        for i, w in enumerate(found):
            self.windows[i, window - len(w) :] = w
        self.owners = [sorted(x) for x in found.values()]


def shard_hits(texts: list[bytes | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text: its words, the merged spans (first word, word after the last) and the names of items found."""
    get, counts, parts = phrases.vocabulary.get, [], []
    for text in texts:
        ws = words_of(text)
        counts.append(len(ws))
        parts.append(np.array([get(w, 1) for w in ws] + [1], np.int32))
    out = [(n, [], set()) for n in counts]
    if not len(phrases.lengths) or not sum(counts):
        return out
    starts = np.cumsum([0, *(n + 1 for n in counts)])
    ids = np.concatenate(parts)
    kept = np.flatnonzero((ids != 1) | (np.concatenate([[0], ids[:-1]]) != 1))  # no phrase crosses a foreign word: one of a run will do
    index = FmIndex(ids[kept], phrases.sigma)
    low, high = index.search(phrases.windows, phrases.lengths)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return out
    sizes = high[hit] - low[hit]
    which = np.repeat(hit, sizes)
    rows = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low[hit], sizes)
    at = kept[index.locate(rows)]
    doc = np.searchsorted(starts, at, side="right") - 1
    for d, w in np.unique(np.stack([doc, which], 1), axis=0):
        out[d][2].update(phrases.names[k] for k in phrases.owners[w])
    order = np.argsort(at)
    at, end, doc = at[order], (at + phrases.lengths[which])[order], doc[order]
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.concatenate([[True], at[1:] > reach[:-1]]))
    for d, a, b in zip(doc[first], at[first], reach[np.append(first[1:], len(at)) - 1], strict=True):
        out[d][1].append((int(a - starts[d]), int(b - starts[d])))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def phrase_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list:
    """The benchmark as broadcasts of at most about `block_words` words each: its size is measured first."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * block_words)))
    out = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect() if blocks > 1 else items.collect()
        out.append(spark.sparkContext.broadcast(Phrases(sorted((r.item, bytes(r.text)) for r in rows), window)))
    return out


def find_spans(df: DataFrame, id_col: str, text_col: str, blocks: list) -> DataFrame:
    """(id, n_words, spans, items): word spans to remove, merged, and the benchmark items that occur."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    src = src.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<a:int,b:int>>"), "items": F.array().cast("array<string>")})
    for block in blocks:

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for piece in slices(batches, "text", SHARD_BYTES):
                found = shard_hits(piece.column("text").to_pylist(), block.value)
                old = zip(piece.column("spans").to_pylist(), piece.column("items").to_pylist(), strict=True)
                spans, items = zip(*((merged([(x["a"], x["b"]) for x in s] + new), sorted({*i, *names})) for (_, new, names), (s, i) in zip(found, old, strict=True)), strict=True)
                yield pa.record_batch(
                    [
                        piece.column("id"),
                        piece.column("text"),
                        pa.array([n for n, _, _ in found], pa.int64()),
                        pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    ["id", "text", "n_words", "spans", "items"],
                )

        src = src.mapInArrow(run, f"id {kind}, text binary, n_words long, spans array<struct<a:int,b:int>>, items array<string>")
    return src.drop("text").withColumnRenamed("id", id_col)


def is_contaminated(n_words: int, spans: list[tuple[int, int]]) -> bool:
    hit = sum(b - a for a, b in spans)
    return hit > 0 and RATIO * hit >= n_words


def drop_contaminated(df: DataFrame, text_col: str, blocks: list) -> DataFrame:
    """The rows of `df`, all columns as they are, without contaminated documents."""
    for block in blocks[:1] if len(blocks) == 1 else ():

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in slices(batches, text_col, SHARD_BYTES):
                texts = piece.column(text_col).cast(pa.binary()).to_pylist()
                yield piece.filter(pa.array([not is_contaminated(n, s) for n, s, _ in shard_hits(texts, block.value)], pa.bool_()))

        return df.mapInArrow(run, df.schema)
    names = df.columns
    key = "_formweave_row"
    rows = df.select(F.struct(*[df[c] for c in names]).alias("r"), df[text_col].alias("t"))
    found = find_spans(rows, "r", "t", blocks).withColumnRenamed("r", key)
    hit = F.aggregate("spans", F.lit(0), lambda n, x: n + x.b - x.a)
    return found.where(~((hit > 0) & (RATIO * hit >= F.col("n_words")))).select(f"{key}.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = phrase_blocks(table(spark, sf_dir, "benchmark"), "item_id", "text")
    found = find_spans(table(spark, sf_dir, "documents"), "doc_id", "text", blocks)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x.b - x.a)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((hit > 0) & (RATIO * hit >= F.col("n_words"))).alias("contaminated"),
    )


def brute_force(documents: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple]:
    """Plain windows against every place, for tests."""
    sets: dict[tuple[bytes, ...], set[str]] = {}
    for name, text in items:
        ws = words_of((text or "").encode())
        for i in range(max(1, len(ws) - window + 1) if ws else 0):
            sets.setdefault(tuple(ws[i : i + window]), set()).add(str(name))
    sizes, out = {len(w) for w in sets}, {}
    for doc, text in documents:
        ws, hit, names = words_of((text or "").encode()), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if got := sets.get(tuple(ws[i : i + n])):
                    hit.update(range(i, i + n))
                    names |= got
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out[doc] = (len(ws), len(hit), len(names), digest, bool(hit) and RATIO * len(hit) >= len(ws))
    return out
