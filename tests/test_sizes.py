"""Tables that Spark takes for smaller than they are, as after an explode, must not be broadcast."""

from pyspark.sql import functions as F

from formweave.operators import matching
from formweave.streaming import machines


def exploded(spark, folder, n=50):
    """`n` rows for each of a small file: Spark knows the size of the file only."""
    spark.range(200).write.parquet(str(folder))
    return spark.read.parquet(str(folder)).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def vault(spark, n):
    return spark.createDataFrame([(i, f"key {i}", f"value {i}") for i in range(n)], "ord long, key string, value string")


def test_own_values_broadcast_the_vault_not_the_labels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(matching, "MOST_RULES", 20)
    labels = exploded(spark, tmp_path / "labels").select((F.col("k") * 100 + F.col("step")).alias("id"), F.concat(F.lit("Key "), "step").alias("label"))
    few, many = (matching.own_values(labels, vault(spark, n)) for n in (20, 30))
    assert "BuildRight" in plan(few) and "BuildLeft" not in plan(few) and "BroadcastHashJoin" not in plan(many)
    assert few.count() == 200 * 19 and many.count() == 200 * 29
    assert sorted(few.where("id < 100").collect()) == sorted((i, f"value {i}") for i in range(1, 20))


def test_resolve_broadcasts_no_labels(spark, tmp_path):
    labels = exploded(spark, tmp_path / "labels").select((F.col("k") * 100 + F.col("step")).alias("id"), F.concat(F.lit("Key "), "step").alias("label"))
    phrases = spark.createDataFrame([(1, "key 7", "seven")], "ord long, concept string, phrase string")
    found = matching.resolve(labels.where("id % 100 < 3").unionByName(labels.limit(1).selectExpr("-1L AS id", "'seven' AS label")), phrases, vault(spark, 20), F.lit(False))
    assert "BuildLeft" not in plan(found)
    assert {tuple(r) for r in found.where("id < 100").collect()} == {(-1, "value 7", "concept"), (1, "value 1", "own"), (2, "value 2", "own")}


def test_steps_are_not_broadcast(spark, tmp_path):
    steps = exploded(spark, tmp_path / "steps", 14).select("k", F.col("step").cast("long")).selectExpr("'r' || k AS run_id", "step", "1L AS filled", "0L AS saved", "false AS auth", "0L AS n_required_empty", "step = 5 AND k = 3 AS submit", "NOT (step = 5 AND k = 3) AS advance", "true AS moved")
    found = machines.stop_reasons(steps)
    assert "BroadcastHashJoin" not in plan(found)
    got = {r.run_id: (r.stop, r.step, r.filled) for r in found.collect()}
    assert got == {f"r{k}": ("at-submit", 5, 5) if k == 3 else ("max-steps", 12, 12) for k in range(200)}


def test_resolver_broadcasts_no_vault(spark, tmp_path):
    from formweave.operators import resolver

    rows = exploded(spark, tmp_path / "vault").withColumnRenamed("k", "owner")
    vault = rows.selectExpr("owner", "cast(step AS bigint) AS ord", "concat('Key ', step) AS key", "concat('v', step) AS value")
    fields = rows.where("step <= 2").selectExpr("owner", "owner AS form", "step AS pos", "concat('Key ', step) AS label", "cast(NULL AS string) AS name", "cast(NULL AS int) AS max_length")
    phrases = spark.createDataFrame([(1, "city", "city")], "ord long, concept string, phrase string")
    found = resolver.resolve_forms(fields, vault, phrases, F.lit("2024-06-30").cast("date"))
    assert "BroadcastHashJoin [owner" not in plan(found) and "SortMergeJoin [owner" in plan(found)
    assert {tuple(r) for r in found.where("owner = 7").collect()} == {(7, 7, 1, "v1", "own"), (7, 7, 2, "v2", "own")} and found.count() == 400


def test_scripts_are_counted_once(spark, tmp_path):
    """A filter on the script must not run the counts again."""
    from formweave.functions import language

    spark.createDataFrame([("पूरा नाम 123",), ("name имя",), ("name",), ("",), (None,)], "t string").write.parquet(str(tmp_path / "texts"))
    found = language.with_script(spark.read.parquet(str(tmp_path / "texts")), "t").where("script IS NOT NULL")
    once = found._jdf.queryExecution().optimizedPlan().toString()
    assert once.count("\\p{L}") == 1 and found.columns == ["t", "script"]
    assert {(r.t, r.script.script, r.script.lang, round(r.script.share, 3)) for r in found.collect()} == {("पूरा नाम 123", "Devanagari", "hi", 1.75), ("name имя", "Cyrillic", "ru", 0.429)}
