"""Operator 6, token counts without ids.

The texts are normalised and cut into pre-tokens by the tokenizer file's own rules. Within a worker the pieces of each
distinct pre-token are counted once; a document's count is the sum over its distinct pre-tokens of frequency times
pieces. No id list exists, and nothing is shuffled: the table of distinct pre-tokens is the worker's, bounded by
CACHE_WORDS, beyond which it is emptied and filled again (counts do not depend on it).

Special strings inside a text are one token each, as by the library's default. Defined results: null and empty texts
have 0 bytes and 0 tokens; repeated rows repeat; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from formweave.llm.common import slices, table

VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 300_000
MAX_TOKENS = 2048


#: White space beyond ASCII, which the normaliser may turn into a space inside a chunk.
_WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class PieceCounter:
    """Counts of one worker: pieces of each distinct pre-token, and their sums for chunks between ASCII white space,
    which the rules cut independently of their neighbours."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        self.model, self.cut = tok.model, tok.pre_tokenizer.pre_tokenize_str
        self.clean = tok.normalizer.normalize_str if tok.normalizer else str
        added = sorted((a.content for a in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added)).encode()) if added else None
        self.pieces: dict[str, int] = {}
        self.chunks: dict[bytes, int] = {}

    def pieces_of(self, word: str) -> int:
        if (n := self.pieces.get(word)) is None:
            n = self.pieces[word] = len(self.model.tokenize(word))
        return n

    def learn(self, chunks: list[bytes]) -> None:
        """Pre-tokens of new chunks: normalised and cut together, told apart by the places of the spaces between them."""
        known = self.chunks
        for k in range(0, len(chunks), 5000):
            part = chunks[k : k + 5000]
            text = b" ".join(part).decode()
            clean = self.clean(text)
            ends, at = [], 0
            for c in clean.split(" "):
                at += len(c)
                ends.append(at)
                at += 1
            if len(ends) != len(part) or _WIDE_SPACE.search(text):
                for c in part:
                    known[c] = sum([self.pieces_of(w) for w, _ in self.cut(self.clean(c.decode()))])
                continue
            sums, i = [0] * len(part), 0
            for word, (_, end) in self.cut(clean):
                while end > ends[i]:
                    i += 1
                sums[i] += self.pieces_of(word)
            known.update(zip(part, sums, strict=True))

    def count(self, texts: list[bytes]) -> list[int]:
        specials, frequencies = [], []
        for text in texts:
            n = 0
            if self.special and (found := self.special.findall(text)):
                n, text = len(found), self.special.sub(b"\n", text)
            specials.append(n)
            frequencies.append(Counter(text.split()))
        if len(self.chunks) + len(self.pieces) > CACHE_WORDS:
            self.chunks.clear(), self.pieces.clear()
        known = self.chunks
        self.learn([c for c in set().union(*frequencies) if c not in known])
        return [n + sum([k * known[c] for c, k in f.items()]) for n, f in zip(specials, frequencies, strict=True)]


_COUNTERS: dict[str, PieceCounter] = {}


def count_tokens(df: DataFrame, id_col: str, text_col: str, path: str | None = None, limit: int = MAX_TOKENS) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every text."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = PieceCounter(path)
        for piece in slices(batches, "text"):
            texts = [t or b"" for t in piece.column("text").cast(pa.binary()).to_pylist()]
            n = _COUNTERS[path].count(texts)
            size = [len(t) for t in texts]
            yield pa.record_batch([piece.column("id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text")
