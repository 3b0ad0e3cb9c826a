"""Sessions by timers equal those of the whole table, across a restart."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from formweave.streaming import timers

GAP = 6 * 3600


def test_sessions_over_a_restart(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    thirds = events.withColumn("h", F.ntile(3).over(Window.orderBy("ts")))
    folder = str(tmp_path / "in")
    put = lambda k: thirds.where(F.col("h") == k).drop("h").coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run = lambda: timers.run_available(timers.expiring_sessions(stream(), GAP, "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    put(1)
    first = run().count()
    put(2)
    put(3)
    got, want = run(), timers.all_sessions(events, GAP)
    assert 0 < first < got.count() and got.exceptAll(want).isEmpty()
    now = events.agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0]
    open_ = want.exceptAll(got).select("user_id", (F.unix_millis("ended") + GAP * 1000).alias("end")).collect()
    assert all(r.end > now - 3_600_000 for r in open_) and len({r.user_id for r in open_}) == len(open_)
