"""Held-out accuracy, and how labelled rows are gathered."""

from pyspark.sql import functions as F

from formweave.llm import toxicity
from formweave.llm.common import table


def test_held_out_accuracy(spark, sf):
    """Labels of a quarter of the ids are not learned from; of these most toxic texts are caught and ordinary ones left alone."""
    big = sf.replace("sf0.001", "sf0.1")
    labels = table(spark, big, "labels").where("toxic IN (0, 1)").select("doc_id", "toxic")
    found = toxicity.op1_toxicity(spark, big).where("held_out").join(labels, "doc_id")
    n = {(r.toxic, r.predicted): r.n for r in found.groupBy("toxic", "predicted").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, ordinary = (sum(v for k, v in n.items() if k[0] == y) for y in (1, 0))
    assert toxic > 50 and n.get((1, 1), 0) > 0.6 * toxic and n.get((0, 0), 0) > 0.94 * ordinary  # from 3,000 labelled texts


def test_versions_are_merged_not_dropped():
    same = b"x" * toxicity.ALIKE_BYTES
    assert toxicity.merged([same + b" one two", same + b" two three", same + b" four one"]) == same + b" one two " + b"three" + b" " + b"four"
    rows = [(same + b" v%d bad words here" % i, i % 2) for i in range(6)] + [(b"%d ordinary text of its own %d" % (i, i) * 5, 0) for i in range(40)]
    model = toxicity.fit(rows, 0.1)  # a single toxic group: dictionaries or calibration have none
    assert model.weights == [] and model.score([b"", b"x"]) == [0.1, 0.1]


def test_training_rows(spark):
    docs = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (2, "c", 0), (3, None, 0), (4, "d", 0), (None, "e", 0), (5, "f", 0)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (4, None), (None, 1), (5, 7), (9, 1)], "doc_id long, toxic int")
    rows, share = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", F.col("doc_id").isNotNull())
    assert sorted(rows) == [(b"a", 1), (b"c", 0)] and share == 0.75
    assert toxicity.training_rows(docs, labels.limit(0), "doc_id", "text", "toxic", F.lit(True)) == ([], 0.0)
    got = toxicity.score(docs, "doc_id", "text", toxicity.fit(rows, share)).collect()
    assert len(got) == 7 and {r.score for r in got} == {0.75}
