"""Structured Streaming over the event log: counters, windows, deduplication, convergent sync."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def counts(events: DataFrame) -> DataFrame:
    """Append-only counters of (instance, kind)."""
    return events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def windowed(events: DataFrame, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Tumbling counts with a watermark, after events of one id are taken once."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    return timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def drain(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over all that its source holds, into a table in memory; for results of bounded size."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="formweave-stream-")
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{base}/stream-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
