"""Keyed state with event-time timers, by transformWithState: sessions that expire, and the transaction machine with deadlines.

A key's rows of a batch are folded in event order; each sets a timer, and a timer that the watermark passes emits what
expired. State lives in the state store (RocksDB) and a restarted query goes on from its checkpoint. The batch functions
give what a stream that has seen all rows and whose watermark has passed them all has emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SESSION = "user_id long, began timestamp, ended timestamp, n long"


class Sessions(StatefulProcessor):
    """A session is kept fresh by its heartbeats and ends `gap_ms` after the last one, when it is emitted."""

    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "began long, last long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get() if self.state.exists() else None
        beats = sorted(int(t.value // 1_000_000) for b in rows for t in b["at"])
        done, timer = [], now[1] + self.gap_ms if now else None
        for t in beats:
            if now and now[1] - self.gap_ms <= t <= now[1] + self.gap_ms:
                now = (min(now[0], t), max(now[1], t), now[2] + 1)
            else:
                if now:
                    done.append(now)
                now = (t, t, 1)
        if timer is not None:
            self.handle.deleteTimer(timer)
        if now:
            self.state.update(now)
            self.handle.registerTimer(now[1] + self.gap_ms)
        yield self._rows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.state.get() if self.state.exists() else None
        self.state.clear()
        yield self._rows(key, [now] if now else [])

    def _rows(self, key, sessions: list) -> pd.DataFrame:
        at = lambda ms: pd.Timestamp(ms, unit="ms")
        return pd.DataFrame([(key[0], at(s[0]), at(s[1]), s[2]) for s in sessions], columns=["user_id", "began", "ended", "n"]).astype({"began": "datetime64[ns]", "ended": "datetime64[ns]"})

    def close(self) -> None:
        pass


def expiring_sessions(events: DataFrame, gap_seconds: int, late: str) -> DataFrame:
    """(user_id, began, ended, n): sessions of a stream (user_id, ts) without a gap of over `gap_seconds`, each when it ends."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    timed = events.select("user_id", F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("at")).withWatermark("at", late)
    return timed.groupBy("user_id").transformWithStateInPandas(Sessions(gap_seconds * 1000), SESSION, "Append", "EventTime")


def all_sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """The same sessions of a whole table, the last of each user included."""
    w = Window.partitionBy("user_id").orderBy("at")
    timed = events.select("user_id", F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("at"))
    starts = timed.withColumn("new", F.coalesce(F.unix_millis("at") - F.unix_millis(F.lag("at").over(w)) > gap_seconds * 1000, F.lit(True)))
    numbered = starts.withColumn("session", F.sum(F.col("new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.min("at").alias("began"), F.max("at").alias("ended"), F.count(F.lit(1)).alias("n")).drop("session")


def run_available(df: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Run a stream in append mode over all that its source holds, into a table at `folder`; called again with the same
    checkpoint it goes on where it stopped."""
    spark: SparkSession = df.sparkSession
    query = df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(folder)
