"""Operator 1, toxicity by compression distance.

Two zstandard dictionaries share a trained body of ordinary text. The toxic one adds a dictionary trained on the words
that labelled toxic documents hold far more often than ordinary ones; the ordinary one adds as much ordinary text. Every
window of a text is compressed with both: the bytes that the toxic dictionary saves are the window's distance. A
document's largest and mean distances, in a logistic calibration fitted on labelled documents that made no dictionary,
give its score; a score of THRESHOLD or more predicts toxic.

Fitting uses at most MAX_TOXIC + MAX_ORDINARY labelled documents of at most MAX_BYTES each, those of the least hash of
their ids. Labelled texts that begin alike (ALIKE_BYTES) are taken for versions of one: they make one training text, in which
each further version adds the words that it has beyond the others, they are toxic if one of them is labelled so, and
they stand on one side of dictionaries and calibration; none is dropped. The trained body of ordinary text is made of BODY_SAMPLE
bytes of each ordinary training text. Scoring reads every whole text, in one pass without a shuffle. The model (some 25 kB) goes with the tasks.

Defined results: null and empty texts score as one empty window; without labels of both kinds every score is the share
of toxic labels (0 without any); repeated rows repeat; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm.common import slices, table

MAX_TOXIC, MAX_ORDINARY, MAX_BYTES = 4000, 12_000, 50_000
#: Bytes of a beginning that versions of a text share; bytes of an ordinary training text, from either end, in the dictionaries.
ALIKE_BYTES, BODY_SAMPLE = 60, 4000
WINDOW, STEP = 32, 16
BODY_BYTES, TAIL_BYTES = 8192, 3796
THRESHOLD = 0.3
_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: list[float] = field(default_factory=list)
    centre: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    share: float = 0.0

    def compressors(self) -> tuple:
        import zstandard as zs

        p = zs.ZstdCompressionParameters(window_log=17, chain_log=15, hash_log=15, search_log=4, min_match=3, target_length=32, strategy=zs.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
        return tuple(zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=p).compress for d in (self.toxic, self.ordinary))

    def score(self, texts: list[bytes]) -> list[float]:
        if not self.weights:
            return [self.share] * len(texts)
        by_toxic, by_ordinary = self.compressors()
        x = np.array([features(t, by_toxic, by_ordinary) for t in texts])
        z = np.c_[(x - self.centre) / self.scale, np.ones(len(x))] @ np.array(self.weights)
        return (1 / (1 + np.exp(-np.clip(z, -50, 50)))).tolist()


def windows(text: bytes) -> list[bytes]:
    return [text[i : i + WINDOW] for i in range(0, max(1, len(text) - WINDOW + STEP), STEP)]


def features(text: bytes, by_toxic, by_ordinary) -> list[float]:
    """Of the distances of all windows, those of the largest, and how many are large."""
    d = np.sort(np.array([len(by_ordinary(w)) - len(by_toxic(w)) for w in windows(text.lower())], float))[::-1]
    n = len(d)
    return [d[0], d[:2].mean(), d[:4].mean(), d[: max(1, n // 20)].mean(), d.mean(), np.log1p((d >= 5).sum()), np.log1p((d >= 3).sum()) / np.log(n + 2), np.log(n + 1)]


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A zstandard dictionary of the samples, or the end of them where they are too few to train on."""
    import zstandard as zs

    try:
        return zs.train_dictionary(size, samples).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-size:]


def merged(versions: list[bytes]) -> bytes:
    """One text of several versions: the first, and of each other the words that none before has."""
    seen, out = set(_WORD.findall(versions[0])), [versions[0]]
    for t in versions[1:]:
        more = [w for w in dict.fromkeys(_WORD.findall(t)) if w not in seen]
        seen.update(more)
        out.append(b" ".join(more))
    return b" ".join(out)


def fit(rows: list[tuple[bytes, int]], toxic_share: float) -> Model:
    """`rows` are (text, 0 or 1) in an order that says nothing; every third group of versions calibrates, the rest make the
    dictionaries."""
    model = Model(share=toxic_share)
    groups: dict[bytes, tuple[dict[bytes, None], list[int]]] = {}
    for text, y in rows:
        texts, ys = groups.setdefault(text[:ALIKE_BYTES].lower(), ({}, []))
        texts[text.lower()] = None
        ys.append(y)
    fresh = [(list(texts), max(ys)) for texts, ys in groups.values()]
    held = [(t, y) for texts, y in fresh[::3] for t in texts]
    part = np.array([1 / len(texts) for texts, _ in fresh[::3] for _ in texts])  # a group weighs as much as a single text
    making = [(merged(texts), y) for i, (texts, y) in enumerate(fresh) if i % 3]
    bad, good = ([t for t, y in making if y == k] for k in (1, 0))
    if not bad or not good or len({y for _, y in held}) < 2:
        return model
    counts = [Counter(), Counter()]
    for t, y in making:
        counts[y].update(set(_WORD.findall(t)))
    least, p = 3 + len(bad) // 200, len(bad) / len(making)
    told = set()
    for w, n in counts[1].items():
        m = counts[0][w]
        if n >= least and n - (n + m) * p >= 6 * np.sqrt((n + m) * p * (1 - p)) and n / len(bad) > 8 * m / len(good):
            told.add(w)
    picked = [b" " + b" ".join(ws) + b" " for t in bad if (ws := [w for w in _WORD.findall(t) if w in told])] or bad
    body = _trained(BODY_BYTES, [t[:BODY_SAMPLE] for t in good])
    model.toxic = _trained(TAIL_BYTES + 300, picked)[-TAIL_BYTES:] + body
    model.ordinary = _trained(TAIL_BYTES + 300, [t[-BODY_SAMPLE:] for t in good])[-TAIL_BYTES:] + body
    by_toxic, by_ordinary = model.compressors()
    x, y = np.array([features(t, by_toxic, by_ordinary) for t, _ in held]), np.array([y for _, y in held], float)
    model.centre, model.scale = x.mean(0).tolist(), (x.std(0) + 1e-9).tolist()
    x = np.c_[(x - model.centre) / model.scale, np.ones(len(x))]
    weight = part * np.where(y == 1, toxic_share / y.mean(), (1 - toxic_share) / (1 - y.mean()))
    w, ridge = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = (x * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (weight * (y - q)) - ridge @ w)
        w += step / max(1.0, np.abs(step).max() / 4)
    model.weights = w.tolist()
    return model


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column) -> tuple[list[tuple[bytes, int]], float]:
    """A bounded sample of labelled texts, and the toxic share of all usable labels. The ids are picked from the labels
    alone; at most MAX_TOXIC + MAX_ORDINARY of them are broadcast to the documents."""
    usable_labels = labels.where(usable & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).cast("int").alias("y"))
    n, toxic = usable_labels.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n:
        return [], 0.0
    order = F.xxhash64(F.col("k").cast("string"))
    picked = [usable_labels.where(F.col("y") == y).orderBy(order, "k").limit(most) for y, most in ((1, MAX_TOXIC), (0, MAX_ORDINARY))]
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where(F.col("t").isNotNull() & (F.octet_length("t") <= MAX_BYTES))
    found = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "k").groupBy("k").agg(F.min("t").alias("t"), F.max("y").alias("y"))
    rows = found.orderBy(order, "k").collect()
    return [(r.t.encode(), r.y) for r in rows], (toxic or 0) / n


def score(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """(id, score, predicted) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            p = model.score([t or b"" for t in piece.column("text").to_pylist()])
            yield pa.record_batch([piece.column("id"), pa.array(p, pa.float64()), pa.array([int(x >= THRESHOLD) for x in p], pa.int32())], ["id", "score", "predicted"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    rows, share = training_rows(docs, labels, "doc_id", "text", "toxic", part != 2)
    return score(docs, "doc_id", "text", fit(rows, share)).select("doc_id", (part == 2).alias("held_out"), "score", "predicted")
