"""A declared store: a table of parts under a folder, whose manifests say which parts and columns it has.

A commit writes its rows to a new part, then the next manifest, first under another name, which a rename then makes the
newest; what failed before that is never read. Migrations only add columns: old parts read with nulls there. Upserts append, and
the newest row of a key is taken when the store is read, until `compact` writes one part of them. A batch of a stream is
known by its query and number, so that one that comes again changes nothing.

One writer at a time is assumed: a second one that took the same number gets FileExistsError.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass
class Manifest:
    """Columns as (name, type), parts as folder names, and the last batch of each query."""

    columns: list[list[str]]
    keys: list[str]
    order: str
    parts: list[str] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def open(cls, spark: SparkSession, folder: str, schema: StructType | str, keys: list[str], order: str) -> Store:
        """The store at `folder` with at least the columns of `schema`, made or migrated if need be; doing so twice changes
        nothing. Of rows with equal `keys` that of the greatest `order` counts. A column that has another type raises ValueError."""
        if isinstance(schema, str):
            schema = StructType.fromDDL(schema)
        wanted = [[f.name, f.dataType.simpleString()] for f in schema]
        store = cls(spark, folder)
        n, now = store._latest()
        if now is None:
            store._commit(0, Manifest(wanted, keys, order))
            return store
        known = dict(now.columns)
        if wrong := [c for c, t in wanted if known.get(c, t) != t]:
            raise ValueError(f"columns of another type: {wrong}")
        if keys != now.keys or order != now.order:
            raise ValueError("the store has other keys")
        if more := [c for c in wanted if c[0] not in known]:
            now.columns += more
            store._commit(n + 1, now)
        return store

    def _latest(self) -> tuple[int, Manifest | None]:
        if not self._fs.exists(self._path(self.folder)):
            return -1, None
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        numbers = [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]
        if not numbers:
            return -1, None
        lines = self.spark.read.text(self._manifest(max(numbers)), wholetext=True).first()
        return max(numbers), Manifest(**json.loads(lines[0]))

    def _manifest(self, n: int) -> str:
        return f"{self.folder}/manifest-{n}.json"

    def _commit(self, n: int, manifest: Manifest) -> None:
        draft, final = self._path(f"{self.folder}/_draft-{uuid.uuid4().hex}"), self._path(self._manifest(n))
        out = self._fs.create(draft, False)
        out.write(json.dumps(vars(manifest)).encode())
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise FileExistsError(self._manifest(n))

    def _columns(self, df: DataFrame, manifest: Manifest) -> DataFrame:
        return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in manifest.columns))

    def upsert(self, rows: DataFrame, query: str | None = None, batch: int | None = None) -> bool:
        """Append `rows`; False, and nothing done, if this batch of the query, or a later one, is in the store."""
        n, now = self._latest()
        if query is not None and now.batches.get(query, -1) >= batch:
            return False
        part = f"part-{uuid.uuid4().hex}"
        self._columns(rows, now).write.parquet(f"{self.folder}/{part}")
        now.parts.append(part)
        if query is not None:
            now.batches[query] = batch
        self._commit(n + 1, now)
        return True

    def read(self) -> DataFrame:
        """The newest row of each key."""
        _, now = self._latest()
        schema = ", ".join(f"`{c}` {t}" for c, t in now.columns)
        if not now.parts:
            return self.spark.createDataFrame([], schema)
        rows = reduce(DataFrame.unionByName, (self.spark.read.schema(schema).parquet(f"{self.folder}/{p}") for p in now.parts))
        rest = [c for c, _ in now.columns if c not in now.keys]
        newest = rows.groupBy(*now.keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(now.order), F.xxhash64(*rest))).alias("_r"))
        return newest.select(*now.keys, "_r.*").select(*(c for c, _ in now.columns))

    def compact(self) -> None:
        """One part of the newest rows instead of all. Old parts stay for those who read them; `vacuum` deletes them."""
        n, now = self._latest()
        part = f"part-{uuid.uuid4().hex}"
        self.read().write.parquet(f"{self.folder}/{part}")
        now.parts = [part]
        self._commit(n + 1, now)

    def vacuum(self) -> int:
        """Delete parts that the newest manifest doesn't name; their number."""
        _, now = self._latest()
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        gone = [x for x in names if x.startswith(("part-", "_draft-")) and x not in now.parts]
        for x in gone:
            self._fs.delete(self._path(f"{self.folder}/{x}"), True)
        return len(gone)

    def sink(self, query: str):
        """A function for `foreachBatch` that upserts each batch once."""

        def put(rows: DataFrame, batch: int) -> None:
            self.upsert(rows, query, batch)

        return put


def sync_available(stream: DataFrame, store: Store, query: str, checkpoint: str) -> DataFrame:
    """Upsert all that a stream's source holds, batch by batch, and read the store."""
    q = stream.writeStream.foreachBatch(store.sink(query)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return store.read()
