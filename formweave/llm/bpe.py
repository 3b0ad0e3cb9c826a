"""Operator 2, byte-level BPE encoding and decoding with DuckDB recursive queries in each partition.

Every Python worker holds one in-memory DuckDB with the merge table (left id, right id -> merged id). The pre-tokens
that a slice of texts brings for the first time become rows (word, token list); a recursive query unnests them to
token-position rows, joins the merge table, contracts each word's leftmost minimum-rank pair and goes on until no word
has a pair. Decoding joins the ids with the vocabulary and puts the bytes together by an ordered aggregation. What is
encoded stays in Arrow columns, from which pieces and texts are put together by their places.

Defined results: a null or empty text has no ids (n_tokens 0, hashes of nothing); repeated rows give repeated rows;
texts of any length are encoded whole; columns other than the id and the text are ignored; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from formweave.llm.common import slices, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens of more bytes are merged with a heap: one contraction an iteration would take a query as long as the word.
LONG_WORD = 64
#: Bytes of text, and new words, in one recursive query; of the latter also the sum of their squared lengths, as the query
#: holds a word once for each of its contractions.
SLICE_BYTES, QUERY_WORDS, QUERY_SQUARES = 4 << 20, 20_000, 8 << 20
#: Words, and pieces, that a worker keeps encoded, and the bytes of the ids and texts of either.
CACHE_WORDS, CACHE_PIECES, CACHE_BYTES = 300_000, 150_000, 32 << 20

_ENCODE = """
WITH RECURSIVE state(w, t, done) AS (
  SELECT w, t, false FROM src
  UNION ALL (
    WITH pairs AS (
      SELECT w, unnest(t)::BIGINT * 16777216 AS l, unnest(t[2:])::BIGINT AS r, generate_subscripts(t, 1) AS pos
      FROM state WHERE NOT done),
    best AS (
      SELECT pairs.w, min(merges.m::BIGINT * 65536 + pairs.pos) AS b
      FROM pairs JOIN merges ON merges.lr = pairs.l + pairs.r GROUP BY pairs.w)
    SELECT state.w,
           CASE WHEN b IS NULL THEN t ELSE t[:(b % 65536) - 1] || [(b // 65536)::INT] || t[(b % 65536) + 2:] END,
           b IS NULL
    FROM state LEFT JOIN best USING (w) WHERE NOT done)),
ended AS MATERIALIZED (SELECT w, t FROM state WHERE done),
back AS (
  SELECT w, string_agg(h, '' ORDER BY pos) AS h
  FROM (SELECT w, unnest(t) AS id, generate_subscripts(t, 1) AS pos FROM ended) JOIN vocab USING (id) GROUP BY w)
SELECT w, len(t) AS n, array_to_string(t, ',') AS ids, unhex(h) AS b FROM ended JOIN back USING (w)
"""
_DECODE = """
SELECT w, unhex(string_agg(h, '' ORDER BY pos)) AS b
FROM (SELECT w, unnest(t) AS id, generate_subscripts(t, 1) AS pos FROM src) JOIN vocab USING (id) GROUP BY w
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Memo:
    """What a worker keeps encoded: the place of each string in the columns n, ids and back."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.place: dict[str, int] = {}
        self.n, self.ids, self.back = np.empty(0, np.int64), pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.again = np.empty(0, bool)

    def trim(self) -> None:
        """Where it is too much, keep what was met again since the last time; if that is much too, nothing."""
        if len(self.place) <= self.most and self.ids.nbytes + self.back.nbytes <= CACHE_BYTES:
            return
        keep = np.flatnonzero(self.again)
        keys, ids, back, n = list(compress(self.place, self.again)), self.ids.take(pa.array(keep)), self.back.take(pa.array(keep)), self.n[keep]
        self.__init__(self.most)
        if 2 * len(keys) <= self.most and 2 * (ids.nbytes + back.nbytes) <= CACHE_BYTES:
            self.add(keys, n, ids, back)

    def new(self, keys: list[str]) -> list[str]:
        """Of distinct strings those that are to be encoded."""
        at = np.fromiter((self.place.get(k, -1) for k in keys), np.int64, len(keys))
        self.again[at[at >= 0]] = True
        return list(compress(keys, at < 0))

    def add(self, keys: list[str], n: np.ndarray, ids: pa.Array, back: pa.Array) -> None:
        self.place.update(zip(keys, range(len(self.place), len(self.place) + len(keys)), strict=True))
        self.n, self.again = np.concatenate([self.n, n]), np.concatenate([self.again, np.zeros(len(n), bool)])
        self.ids, self.back = pa.concat_arrays([self.ids, ids]), pa.concat_arrays([self.back, back])

    def places(self, keys: Iterable[str], count: int) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, keys), np.int64, count)

    def joined(self, places: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(number of ids, ids, decoded bytes) of runs of so many places; what has no ids leaves no comma."""
        n = self.n[places]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        if not n.all():
            ends = np.concatenate([[0], np.cumsum(n > 0)])[ends]
            places, n = places[n > 0], n[n > 0]
        total = np.concatenate([[0], np.cumsum(n)])[ends]
        offsets, at = pa.array(ends, pa.int32()), pa.array(places)
        ids, back = (pc.binary_join(pa.ListArray.from_arrays(offsets, c.take(at)), pa.scalar(by, c.type)) for c, by in ((self.ids, ","), (self.back, b"")))
        return np.diff(total), ids, back


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        self.ranks = load_ranks(path)
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.pattern = regex.compile(pattern)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self._register("m", l=pa.array(left, pa.int64()), r=pa.array(right, pa.int64()), m=pa.array(merged, pa.int32()))
        self.con.execute("CREATE TABLE merges AS SELECT l * 16777216 + r AS lr, m FROM m")
        self._register("v", id=pa.array(self.bytes_of, pa.int32()), h=pa.array([t.hex() for t in self.bytes_of.values()]))
        self.con.execute("CREATE TABLE vocab AS SELECT id, h FROM v")
        self.con.unregister("m"), self.con.unregister("v")
        self.words, self.pieces = Memo(CACHE_WORDS), Memo(CACHE_PIECES)

    def _register(self, name: str, **columns: pa.Array) -> None:
        self.con.register(name, pa.table(columns))

    def _query(self, sql: str, lists: pa.Array) -> pa.Table:
        self._register("src", w=pa.array(np.arange(len(lists), dtype=np.int32)), t=lists)
        out = self.con.sql(sql).to_arrow_table()
        self.con.unregister("src")
        return out

    def encode_words(self, words: list[str]) -> None:
        """Keep the words, new distinct pre-tokens, encoded; one that is in the vocabulary is one token."""
        known, hard, raws = [], [], []
        for word in words:
            raw = word.encode()
            if (rank := self.ranks.get(raw)) is not None:
                known.append((word, 1, str(rank), self.bytes_of[rank]))
            elif len(raw) > LONG_WORD:
                ids = self._by_heap(raw)
                known.append((word, len(ids), ",".join(map(str, ids)), b"".join([self.bytes_of[i] for i in ids])))
            else:
                hard.append(word)
                raws.append(raw)
        if known:
            keys, n, ids, back = zip(*known, strict=True)
            self.words.add(keys, np.array(n, np.int64), pa.array(ids, pa.large_string()), pa.array(back, pa.large_binary()))
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        for start, end in _query_slices(sizes):
            ids = self.byte_ids[np.frombuffer(b"".join(raws[start:end]), np.uint8)]
            ends = np.concatenate([[0], np.cumsum(sizes[start:end])]).astype(np.int32)
            found = self._query(_ENCODE, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))).combine_chunks()
            n, ids, back = (found[c].cast(kind).combine_chunks() for c, kind in (("n", pa.int64()), ("ids", pa.large_string()), ("b", pa.large_binary())))
            self.words.add([hard[start + w] for w in found["w"].to_numpy().tolist()], n.to_numpy(), ids, back)

    def _by_heap(self, raw: bytes) -> list[int]:
        """The same contraction order, leftmost minimum rank first, in n log n for long words."""
        ids, nxt, prv = self.byte_ids[list(raw)].tolist(), list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))
        alive = [True] * len(ids)
        ends = list(range(1, len(raw) + 1))

        def pair(i: int) -> tuple[int, int, int, int] | None:
            j = nxt[i]
            if j >= len(ids):
                return None
            rank = self.ranks.get(raw[i : ends[j]])
            return None if rank is None else (rank, i, ends[i], ends[j])

        heap = [p for i in range(len(ids)) if (p := pair(i))]
        heapq.heapify(heap)
        while heap:
            rank, i, mid, end = heapq.heappop(heap)
            if not alive[i] or ends[i] != mid or (j := nxt[i]) >= len(ids) or ends[j] != end:
                continue
            ids[i], ends[i], alive[j], nxt[i] = rank, end, False, nxt[j]
            if nxt[i] < len(ids):
                prv[nxt[i]] = i
            for k in (prv[i], i):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(heap, p)
        return [t for t, a in zip(ids, alive, strict=True) if a]

    def decode_lists(self, lists: list[list[int]]) -> list[bytes]:
        out: list[bytes] = [b""] * len(lists)
        for k in range(0, len(lists), QUERY_WORDS):
            found = self._query(_DECODE, pa.array(lists[k : k + QUERY_WORDS], pa.list_(pa.int32())))
            for w, b in zip(found["w"].to_pylist(), found["b"].to_pylist(), strict=True):
                out[k + w] = b
        return out

    def _split(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct pieces of texts, which the pattern splits independently of each other; all pieces by their place in
        that list, and their number in each text. A piece begins with every space that stands between characters other
        than white space, as no match crosses it. Texts with other spaces are split by a look at both sides."""
        apart = pc.invert(pc.match_substring_regex(texts, _BESIDE_SPACE)).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts.filter(pa.array(apart)), " ")
        sizes = np.zeros(len(texts), np.int64)
        sizes[apart] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        codes = lists.flatten().dictionary_encode()
        # a text's first piece has no space before it
        keys = codes.indices.to_numpy().astype(np.int64) * 2
        keys[np.cumsum(sizes[apart]) - sizes[apart]] += 1
        place = np.full(2 * len(codes.dictionary), -1, np.int64)
        place[keys] = 0
        met = np.flatnonzero(place == 0)
        strings = codes.dictionary.to_numpy(zero_copy_only=False).tolist()
        distinct = {strings[k >> 1] if k & 1 else " " + strings[k >> 1]: i for i, k in enumerate(met.tolist())}
        place[met] = np.arange(len(met))
        parts = [_BETWEEN_SIGNS.split(t) for t in texts.filter(pa.array(~apart)).to_pylist()]
        others = [distinct.setdefault(p, len(distinct)) for p in chain.from_iterable(parts)]
        sizes[~apart] = list(map(len, parts))
        pieces = np.empty(len(keys) + len(others), np.int64)
        where = np.repeat(apart, sizes)
        pieces[where], pieces[~where] = place[keys], others
        return list(distinct), pieces, sizes

    def learn(self, new: list[str]) -> None:
        parts = list(map(self.pattern.findall, new))
        words = list(chain.from_iterable(parts))
        self.words.trim()
        if fresh := self.words.new(list(dict.fromkeys(words))):
            self.encode_words(fresh)
        places = self.words.places(words, len(words))
        self.pieces.add(new, *self.words.joined(places, np.fromiter(map(len, parts), np.int64, len(parts))))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(number of ids, ids, decoded bytes) of each text, the ids joined by commas."""
        distinct, pieces, sizes = self._split(pc.fill_null(texts.cast(pa.large_string()), ""))
        self.pieces.trim()
        if new := self.pieces.new(distinct):
            self.learn(new)
        return self.pieces.joined(self.pieces.places(distinct, len(distinct))[pieces], sizes)


def _query_slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of words of these lengths that one query takes."""
    squares, start = np.concatenate([[0], np.cumsum(sizes**2)]), 0
    while start < len(sizes):
        end = min(start + QUERY_WORDS, max(start + 1, int(np.searchsorted(squares, squares[start] + QUERY_SQUARES, "right")) - 1))
        yield start, min(end, len(sizes))
        start = end


#: White space in Python and in `regex`; a space before or after other white space, or white space at the end of a text: there
#: the lookahead of the pattern matters.
_WHITE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\pZ]"
_BESIDE_SPACE = rf" {_WHITE}|{_WHITE} |{_WHITE}\z"
_BETWEEN_SIGNS = re.compile(r"(?<=\S)(?= \S)")
_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN


def encode(df: DataFrame, id_col: str, text_col: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids): the token ids of every text, in order."""
    path, pattern = _defaults(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for piece in slices(batches, "text", SLICE_BYTES):
            ids = [list(map(int, x.split(","))) if x else [] for x in c.texts(piece.column("text"))[1].to_pylist()]
            yield pa.record_batch([piece.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str, ids_col: str, path: str | None = None) -> DataFrame:
    """(id, bytes) of lists of ids; null or empty lists give no bytes."""
    path, pattern = _defaults(path, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for k in range(0, len(batch), 256):
                piece = batch.slice(k, 256)
                out = c.decode_lists([x or [] for x in piece.column("ids").to_pylist()])
                yield pa.record_batch([piece.column("id"), pa.array(out, pa.binary())], ["id", "bytes"])

    src = df.select(df[id_col].alias("id"), df[ids_col].alias("ids"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, bytes binary").withColumnRenamed("id", id_col)


def digests(df: DataFrame, id_col: str, text_col: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode, decode and return (id, n_tokens, ids_sha256, decoded_sha256) without moving the ids out of the worker."""
    path, pattern = _defaults(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for piece in slices(batches, "text", SLICE_BYTES):
            counts, *parts = c.texts(piece.column("text"))
            ids, back = ([hashlib.sha256(x).hexdigest() for x in part.cast(pa.large_binary()).to_pylist()] for part in parts)
            yield pa.record_batch([piece.column("id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    schema = f"id {src.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), "doc_id", "text")
