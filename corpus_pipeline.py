"""Corpus pipeline over `documents`: five stages, each calling one training-data operator.

Every stage takes all that its predecessor kept. The first four return the columns of documents; what they decide is in
their rows and texts (and n_chars, where there is one). The last returns the token counts and digests of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from formweave.llm import bpe, decontam, linededup, ngramjoin, quality
from formweave.llm.common import table, written


def _chars(docs: DataFrame) -> str | None:
    return "n_chars" if "n_chars" in docs.columns else None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without failing lines, and without the documents that the rules reject."""
    return quality.clean(docs, "text", _chars(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of similar lines stays; no document goes, though a text may become empty."""
    return linededup.dedup_lines(docs, "doc_id", "text", _chars(docs))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 80 %) stays, that of the least doc_id."""
    return ngramjoin.keep_one(docs, "doc_id", "text", words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages contaminate go."""
    return decontam.drop_contaminated(docs, "text", decontam.phrase_blocks(table(spark, sf_dir, "benchmark"), "item_id", "text"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of what they decode to."""
    return bpe.digests(docs, "doc_id", "text")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express fuzzy components; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
