"""Importance resampling against plain loops, and its edge cases."""

from formweave.llm import resample
from formweave.llm.common import table

ODD = [None, "", " ..", "one", "One TWO", "a b c a b c", "É日本 x9 " * 30, "w " * 3000, "w " * 3000, "Stop-gap_word's " * 12]


def test_resample(spark, sf):
    want = resample.brute_force([tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()], [r.text for r in table(spark, sf, "benchmark").collect()])
    got = {r.doc_id: tuple(r)[1:] for r in resample.op13_resample(spark, sf).collect()}
    assert got == want and sum(w[3] is not None for w in want.values()) == 5 * sum(w[0] >= 57 for w in want.values()) // 100


def test_resample_edges(spark):
    docs = spark.createDataFrame([(i, t, "clash", "clash", 1) for i, t in enumerate(ODD)], "doc_id long, text string, rank string, row string, b1 int")
    goal = ["a b c", None, "w w w"]
    target = spark.createDataFrame([(t,) for t in goal], "text string")
    want = resample.brute_force(list(enumerate(ODD)), goal)
    got = {r.doc_id: tuple(r)[1:] for r in resample.resample(docs, target, "doc_id", "text", "text").collect()}
    assert got == want
    drawn = resample.resample(docs, target.limit(0), "doc_id", "text", "text", percent=50)
    assert {r.doc_id: tuple(r)[1:3] for r in drawn.collect()} == {k: w[:2] for k, w in resample.brute_force(list(enumerate(ODD)), []).items()}
    assert sorted(r["rank"] for r in drawn.where("rank IS NOT NULL").collect()) == [1, 2]
    assert resample.resample(docs.limit(0), target, "doc_id", "text", "text").collect() == []


def test_resample_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "w " * 25), (1, "w " * 25), (None, "v " * 25), (None, None)], "doc_id long, text string")
    rows = resample.resample(docs, docs, "doc_id", "text", "text", percent=100).collect()
    assert len(rows) == 4 and sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3]
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
