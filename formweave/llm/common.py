"""Helpers that the training-data operators share: table access, bounded Arrow slices, the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds at once, a single longer text aside.
SLICE_BYTES = 8 << 20
#: Rows of an Arrow batch between the JVM and Python where tables are written; both sides hold whole batches.
BATCH_ROWS = 2_500
#: Bits of the map that says which rows a join needs: 8 MB when broadcast.
FILTER_BITS = 1 << 26
#: Rows of ids in a file of a table whose size is known.
FILE_ROWS = 20_000
_BATCH_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text column of each piece holds `limit` bytes, or one row if that is longer. What
    a batch took is given back after it, as other workers and the JVM share the executor's memory."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
        pa.default_memory_pool().release_unused()


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | list[pa.RecordBatch]], schema: str, text: str) -> DataFrame:
    """`work` over bounded slices of `df`, in one pass without a shuffle; a lost task is run again from its input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text):
            out = work(piece)
            yield from out if isinstance(out, list) else [out]

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one of our own where it is unset and the
    master is local, as in tests. Elsewhere a folder of one machine would not do: ValueError."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="formweave-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/formweave-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Plans made meanwhile send BATCH_ROWS rows a batch at most; afterwards the session has its own number again."""
    own = spark.conf.get(_BATCH_ROWS_KEY)
    if 0 < int(own) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(_BATCH_ROWS_KEY, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS_KEY, own)


def written(df: DataFrame, label: str, by: str | None = None, rows: int | None = None) -> DataFrame:
    """`df` as a table written to the shared folder and read again: the lineage ends there and survives lost executors. In
    folders by the values of the column `by`, which must be the last, if given. `rows` says about how many rows of a few
    ids it has: it then takes the files that these need instead of one of each partition. On local disks Hadoop starts
    processes for each file, so a file of ten rows costs more than its rows."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    with short_batches(spark):
        df.write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out._formweave_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the table that `written` made, once nothing that is still to run reads it."""
    drop_path(df.sparkSession, df._formweave_path)


def _bits(df: DataFrame, key: str, wanted: DataFrame, how: str) -> DataFrame:
    """`df` with _fw_set: whether the bit of its `key` is set in the map of those of `wanted`, which is broadcast."""
    bit = F.pmod(key, F.lit(FILTER_BITS))
    bitmap = wanted.groupBy(F.bitmap_bucket_number(bit).alias("_fw_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_fw_bits"))
    named = df.withColumns({"_fw_bucket": F.bitmap_bucket_number(bit), "_fw_bit": F.bitmap_bit_position(bit)})
    is_set = F.expr("(CAST(conv(hex(substring(_fw_bits, CAST(_fw_bit DIV 8 AS INT) + 1, 1)), 16, 10) AS INT) >> CAST(_fw_bit % 8 AS INT)) & 1 = 1")
    return named.join(F.broadcast(bitmap), "_fw_bucket", how).withColumn("_fw_set", is_set)


def sifted(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of `df` whose `key`, a long, may be among those of `wanted`: all that are and, where the map of FILTER_BITS
    bits is full, also others. The map is broadcast and keeps most rows out of the shuffle of a join that follows."""
    return _bits(df, key, wanted, "inner").where("_fw_set").select(df.columns)


def sifted_out(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The other rows: those that `sifted` leaves out, null keys included."""
    return _bits(df, key, wanted, "left").where("NOT coalesce(_fw_set, false)").select(df.columns)


def among(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of `df` whose `key`, a long, is in `wanted`, a table of this column in which keys may repeat."""
    return sifted(df, key, wanted).join(wanted.distinct(), key)
