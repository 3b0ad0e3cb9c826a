"""The versioned entity-attribute-value store: scans, upserts, deletes, versions, event counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.select("id", "name").orderBy("name", "id")


def unpivot_points(df: DataFrame, id_col: str, fields: dict[str, Column]) -> DataFrame:
    """(profile_id, key, value): a row for each field of a wide table, without a shuffle."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()))
    return df.select(F.col(id_col).alias("profile_id"), F.explode(pairs).alias("p")).select("profile_id", "p.key", "p.value")


def vault(points: DataFrame) -> DataFrame:
    """(profile_id, vault): a map a profile; keys in order."""
    entries = F.array_sort(F.collect_list(F.struct("key", "value")))
    return points.groupBy("profile_id").agg(F.map_from_entries(entries).alias("vault"))


def field_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n_fields"))


def profiles_with_counts(profiles: DataFrame, points: DataFrame) -> DataFrame:
    counts = field_counts(points).withColumnRenamed("profile_id", "id")
    return profiles.join(counts, "id", "left").select("id", "name", F.coalesce("n_fields", F.lit(0)).alias("n_fields"))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`changes` replace rows of equal keys; of several changes of one key the last by `order` holds."""
    rest = [c for c in base.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return base.join(last, keys, "left_anti").unionByName(last.select(*keys, "_last.*"))


def insert_if_absent(base: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first of `rows` for every key that `base` lacks, appended."""
    rest = [c for c in base.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return base.unionByName(first.join(base, keys, "left_anti").select(*keys, "_first.*"))


def delete_cascade(parents: DataFrame, children: list[DataFrame], gone: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, list[DataFrame]]:
    """Parents and children without those of `gone`'s keys."""
    keys = gone.select(F.col(parent_key).alias("_gone")).distinct()
    keep = lambda df, key: df.join(keys, df[key] == F.col("_gone"), "left_anti")
    return keep(parents, parent_key), [keep(c, child_key) for c in children]


def number_versions(rows: DataFrame, instance: str, *order: str) -> DataFrame:
    """Dense version numbers from 1 in each instance, computed once for a batch."""
    return rows.withColumn("version_no", F.row_number().over(Window.partitionBy(instance).orderBy(*order)))


def next_versions(existing: DataFrame, new: DataFrame, instance: str, *order: str) -> DataFrame:
    """Numbers that continue each instance's versions, or start at 1."""
    top = existing.groupBy(instance).agg(F.max("version_no").alias("_top"))
    numbered = number_versions(new, instance, *order).join(top, instance, "left")
    return numbered.withColumn("version_no", F.col("version_no") + F.coalesce("_top", F.lit(0))).drop("_top")


def latest_version(versions: DataFrame, instance: str) -> DataFrame:
    rest = [c for c in versions.columns if c not in (instance, "version_no")]
    return versions.groupBy(instance).agg(F.max("version_no").alias("version_no"), F.max_by(F.struct(*rest), "version_no").alias("_v")).select(instance, "version_no", "_v.*")


def event_counts(events: DataFrame, instance: str, kind: str) -> DataFrame:
    return events.groupBy(instance).agg(F.count_if(F.col("kind") == kind).alias(f"n_{kind}"))


def large_values(points: DataFrame, most: int) -> DataFrame:
    """(profile_id, small, large): how many values fit into `most` bytes, and the keys of those that don't."""
    big = F.octet_length("value") > most
    keys = F.array_join(F.array_sort(F.collect_list(F.when(big, F.col("key")))), ",")
    return points.groupBy("profile_id").agg(F.count_if(~big).alias("n_small"), keys.alias("large"))
