"""Tiered lexical search against every item and document, with tiers that tests can exhaust."""

import random

import pytest

from formweave.llm import lexical
from formweave.llm.common import table

ODD = [None, "", "...", "one", "ONE one", "É x x", "é X", "long " * 20_000 + "tail", "a b c", "a b c", "A-b.c"]


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in docs], "doc_id long, text string, key string, tid int, n int")
    b = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, item int")
    index = lexical.build_index(d, "doc_id", "text", lexical.item_terms(b, "item_id", "text").select("term").distinct())
    return sorted(tuple(r) for r in lexical.search(index, b, "item_id", "text").collect())


def test_lexical(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.op12_lexical(spark, sf).collect())
    assert got == sorted(lexical.brute_force(docs, items)) and len(got) > len(items)


def test_lexical_edges(spark):
    docs = [*enumerate(ODD), (None, "one tail"), (3, "one")]
    items = [(1, "One"), (2, None), (3, "nowhere"), (4, "É tail tail"), (5, "a b"), (5, "c x"), (None, "a")]
    got = run(spark, docs, items)
    want = lexical.brute_force(docs, [i for i in items if i[0] is not None])
    assert got == sorted(want) and [r[0] for r in got].count(5) == 5
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


@pytest.mark.parametrize("copies", [0, 300])
def test_lower_tiers_and_ties(spark, copies, monkeypatch):
    """Few words in many documents: items fall through all tiers, and equal scores go by id."""
    monkeypatch.setattr(lexical, "TIERS", (4, 40))
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(400)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))) for i in range(300)]
    docs += [(1000 - i, "w1 w2 w3 w7") for i in range(copies)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 12])))) for i in range(12)]
    assert run(spark, docs, items) == sorted(lexical.brute_force(docs, items))
