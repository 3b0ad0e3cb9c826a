"""Operator 5, quality rules, line first.

Every line of a text is judged by rules of punctuation (symbols, exclamation runs, capitals), navigation (separators
between short parts) and boilerplate (fixed phrases), each in proportion to the line's words, so that a long line of prose
doesn't fail for one phrase. Failing lines go; a document that loses more than MAX_LOSS per
cent of its word characters is rejected, as is one that fails the base rules (too few words, repeated word windows).

All of it runs in one pass over bounded slices, in bytes: words are runs between ASCII white space.

Defined results: null and empty texts have no words and are rejected (fewer than MIN_WORDS); blank lines are never
judged; repeated rows repeat; other columns are kept by `clean`, ignored by `judge`; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formweave.llm.common import slices, table

MIN_WORDS = 50
#: Per cent of words in repeated three-word windows, and of word characters lost with failing lines.
MAX_REPEAT, MAX_LOSS = 50, 50
SYMBOLS = b"#*$%&|<>"
#: Words of a line for each boilerplate phrase, and for each run of exclamation marks, at most, for the line to fail.
PHRASE_SPAN, SHOUT_SPAN = 15, 10
_SPACES = b" \t\n\x0b\x0c\r"
#: Fixed phrases of boilerplate lines, lower case.
BOILERPLATE = (
    "accept cookies",
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "share this",
    "sign up for our newsletter",
    "skip to content",
    "terms of service",
    "terms of use",
)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_PRETTY_BARS = ("›".encode(), "»".encode(), "•".encode())


def _count(line: bytes, kinds: bytes) -> int:
    return len(line) - len(line.translate(None, kinds))


def line_fails(line: bytes, n_words: int) -> bool:
    """The rules for one line with words."""
    symbols = _count(line, SYMBOLS)
    if symbols >= 3 and 4 * symbols > n_words:
        return True
    bars = line.count(b"|") + sum(line.count(b) for b in _PRETTY_BARS)
    if bars >= 3 and 4 * bars > n_words:
        return True
    shouts = line.count(b"!!")
    if (shouts >= 3 and SHOUT_SPAN * shouts > n_words) or (n_words >= 3 and _count(line, _UPPER) > _count(line, _LOWER)):
        return True
    phrases = len(_BOILERPLATE.findall(line.lower()))
    return phrases > 0 and PHRASE_SPAN * phrases >= n_words


def _word_chars(text: bytes) -> int:
    """Code points that are not white space: bytes that do not continue a character."""
    solid = text.translate(None, _SPACES)
    return len(solid) if solid.isascii() else len(solid.decode())


def repeated_words(words: list[list[bytes]]) -> list[int]:
    """For each text its words in three-word windows that it holds twice or more."""
    sizes = np.array([len(w) for w in words], np.int64)
    if not sizes.sum():
        return [0] * len(words)
    flat, most = np.empty(sizes.sum(), np.int64), 0
    for ws, end, n in zip(words, np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
        number = dict(zip(dict.fromkeys(ws), range(n)))
        flat[end - n : end] = list(map(number.__getitem__, ws))
        most = max(most, len(number))
    doc = np.repeat(np.arange(len(words)), sizes)
    at = np.flatnonzero(doc[:-2] == doc[2:])
    bits = most.bit_length()
    owner, pair, last = doc[at], (flat[at] << bits) | flat[at + 1], flat[at + 2]
    if 3 * bits + len(words).bit_length() <= 63:
        keys = [(owner << 3 * bits) | (pair << bits) | last]
        order = np.argsort(keys[0])
    else:
        keys = [last, pair, owner]
        order = np.lexsort(keys)
    same = np.ones(max(0, len(order) - 1), bool)
    for key in keys:
        key = key[order]
        same &= key[1:] == key[:-1]
    often = np.zeros(len(order), bool)
    often[1:] |= same
    often[:-1] |= same
    start = at[order[often]]
    hit = np.zeros(len(flat), bool)
    for k in range(3):
        hit[start + k] = True
    return np.bincount(doc, weights=hit, minlength=len(words)).astype(int).tolist()


def judged(texts: list[bytes]) -> list[tuple[int, int, int, int, int, bool, bool, bytes]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, text without failing lines)."""
    words = [t.split() for t in texts]
    out = []
    for text, ws, repeat in zip(texts, words, repeated_words(words), strict=True):
        seen: set[bytes] = set()
        duplicates, lost, good = 0, 0, []
        for line in text.split(b"\n"):
            if not (n := len(line.split())):
                good.append(line)
                continue
            duplicates += line in seen
            seen.add(line)
            if line_fails(line, n):
                lost += _word_chars(line)
            else:
                good.append(line)
        chars = _word_chars(text)
        failed = len(ws) < MIN_WORDS or 100 * repeat > MAX_REPEAT * len(ws)
        out.append((len(ws), chars, _count(text, SYMBOLS), duplicates, repeat, failed, not failed and 100 * lost <= MAX_LOSS * chars, b"\n".join(good)))
    return out


def judge(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            columns = list(zip(*judged([t or b"" for t in piece.column("text").to_pylist()]), strict=True))
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.binary()]
            yield pa.record_batch([piece.column("id"), *map(pa.array, columns, kinds)], names)

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned"]
    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, cleaned binary"
    out = src.mapInArrow(run, schema)
    return out.withColumn("cleaned", F.col("cleaned").cast("string")).withColumnRenamed("id", id_col)


def clean(df: DataFrame, text_col: str, chars_col: str | None = None) -> DataFrame:
    """The rows of `df` that are kept, all columns, their text without failing lines and `chars_col` counted anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text_col):
            found = judged([t or b"" for t in piece.column(text_col).cast(pa.binary()).to_pylist()])
            texts = [x[7].decode() for x in found]
            for name, values in ((text_col, texts), (chars_col, [len(t) for t in texts])):
                if name:
                    i = piece.schema.get_field_index(name)
                    piece = piece.set_column(i, piece.schema.field(i), pa.array(values).cast(piece.schema.field(i).type))
            yield piece.filter(pa.array([x[6] for x in found], pa.bool_()))

    return df.mapInArrow(run, T.StructType(df.schema.fields))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.drop("cleaned")


_PHRASES = "|".join(BOILERPLATE)
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
b AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM often, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
m AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
             length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
             length(line) - length(regexp_replace(line, '[|\x{{203a}}\x{{bb}}\x{{2022}}]', '', 'g')) AS bars,
             len(regexp_extract_all(line, '!!')) AS shouts, len(regexp_extract_all(line, '(?i){_PHRASES}')) AS phrases,
             length(regexp_replace(line, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(line, '[^a-z]', '', 'g')) AS lower,
             length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars FROM l),
f AS (SELECT doc_id, line, pos, n, chars,
             (symbols >= 3 AND 4 * symbols > n) OR (bars >= 3 AND 4 * bars > n) OR (shouts >= 3 AND {SHOUT_SPAN} * shouts > n) OR (n >= 3 AND upper > lower)
             OR (phrases > 0 AND {PHRASE_SPAN} * phrases >= n) AS bad FROM m WHERE n > 0),
q AS (SELECT doc_id, sum(CASE WHEN bad THEN chars ELSE 0 END) AS lost, count(*) - count(DISTINCT line) AS dup FROM f GROUP BY doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * coalesce(r.n, 0) > {MAX_REPEAT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * coalesce(r.n, 0) > {MAX_REPEAT} * n_words) AND 100 * coalesce(lost, 0) <= {MAX_LOSS} * word_chars AS kept
FROM b LEFT JOIN r USING (doc_id) LEFT JOIN q USING (doc_id)
"""
