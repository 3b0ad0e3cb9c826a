"""Operator 10, shard placement by a permutation-filled lookup table; DataFrame operations only.

Every shard has a permutation of the slots of a table of prime size, from an offset and a skip of its name. The shards
take turns; each claims the first slot of its order of preference that is still free. All shards own the same number of
slots, give or take one, and few slots change hands when a shard comes or goes. The table, whose size is a checked
parameter and not the data's, is broadcast; a row's key hashes to a slot, and placement is one lookup, without a shuffle.

Defined results: a null key hashes as the empty string; equal keys share a shard; repeated rows repeat; all columns of
the input stay, and its own columns of the names `slot` and `shard` are replaced; an empty table gives none.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm.common import table

SHARDS = 64
#: Prime, and at least a hundred slots a shard.
SLOTS = 65537
MAX_SLOTS = 1 << 20


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's index for each slot."""
    if not 2 < slots <= MAX_SLOTS or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the number of slots must be a prime of at most {MAX_SLOTS}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("between one shard and one for each slot, of different names")
    at = [_number(f"offset/{s}") % slots for s in shards]
    skip = [_number(f"skip/{s}") % (slots - 1) + 1 for s in shards]
    out, free = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while out[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            out[at[k]] = k
            free -= 1
            if not free:
                return out


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard), made from one binary literal: four bytes a slot."""
    packed = F.lit(bytearray(b"".join(k.to_bytes(4, "big") for k in fill_table(shards, slots))))
    number = F.conv(F.hex(F.substring(packed, F.col("id") * 4 + 1, 4)), 16, 10).cast("int")
    names = F.array(*map(F.lit, shards))
    return spark.range(slots).select(F.col("id").alias("slot"), F.element_at(names, number + 1).alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots


def assign_shards(df: DataFrame, key_col: str, shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """`df` with `slot` and `shard`."""
    lookup = lookup_table(df.sparkSession, shards or shard_names(), slots)
    placed = df.drop("slot", "shard") if key_col not in ("slot", "shard") else df
    return placed.withColumn("slot", slot_of(df[key_col], slots)).join(F.broadcast(lookup), "slot").select(*[c for c in placed.columns if c not in ("slot", "shard")], "slot", "shard")


def write_shards(df: DataFrame, key_col: str, path: str, shards: list[str] | None = None, slots: int = SLOTS) -> None:
    """Parquet folders shard=..., rows dealt by slot, so that a hot shard is written by many tasks."""
    placed = assign_shards(df, key_col, shards, slots)
    placed.repartition("slot").drop("slot").write.partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
