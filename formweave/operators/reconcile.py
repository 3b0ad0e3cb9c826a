"""Two-vault reconciliation, record matching and map overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """Last write wins over a full outer join: (keys, direction, value, updated_at) of what must be copied.

    A later local row is pushed even if its value is the remote one; a later remote row is pulled only if it differs; of
    rows of one time the remote value wins where the values differ.
    """
    a = local.select(*keys, F.struct("value", "updated_at").alias("l"))
    b = remote.select(*keys, F.struct("value", "updated_at").alias("r"))
    both = a.join(b, keys, "full_outer")
    push = F.col("r").isNull() | (F.col("l.updated_at") > F.col("r.updated_at"))
    pull = F.col("l").isNull() | ((F.col("l.updated_at") <= F.col("r.updated_at")) & ~F.col("l.value").eqNullSafe(F.col("r.value")))
    side = F.when(F.col("l").isNotNull() & push, "to_remote").when(F.col("r").isNotNull() & pull, "to_local")
    row = F.when(F.col("direction") == "to_remote", F.col("l")).otherwise(F.col("r"))
    return both.withColumn("direction", side).where("direction IS NOT NULL").withColumn("row", row).select(*keys, "direction", "row.value", "row.updated_at")


def migration_plan(local: DataFrame, remote: DataFrame, keys: list[str], unlocked: bool = True, migrated: bool = False) -> DataFrame:
    """Local rows that the remote vault lacks or holds empty; none unless it is unlocked and was not migrated."""
    filled = remote.where("value IS NOT NULL AND value <> ''").select(*keys)
    plan = local.where("value IS NOT NULL AND value <> ''").join(filled, keys, "left_anti")
    return plan if unlocked and not migrated else plan.where(F.lit(False))


def normal_name(c: Column) -> Column:
    """Lower case, letters and digits with single spaces; camel case is not split."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def normal_birth_date(c: Column) -> Column:
    """MMDDYYYY of M/D/YYYY or YYYY-MM-DD; null if it is neither."""
    us, iso = r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\s*$", r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})\s*$"
    part = lambda p, k, n: F.lpad(F.regexp_extract(c, p, k), n, "0")
    return F.when(c.rlike(us), F.concat(part(us, 1, 2), part(us, 2, 2), part(us, 3, 4))).when(c.rlike(iso), F.concat(part(iso, 2, 2), part(iso, 3, 2), part(iso, 1, 4)))


def match_identity(people: DataFrame, profiles: DataFrame) -> DataFrame:
    """(person, profile): equal names, and equal birth dates or one missing; the first profile by `ord`."""
    p = people.select(F.col("id").alias("person"), normal_name(F.col("name")).alias("n"), normal_birth_date(F.col("dob")).alias("pd"))
    q = profiles.select(F.col("id").alias("profile"), "ord", normal_name(F.col("name")).alias("n"), normal_birth_date(F.col("dob")).alias("qd"))
    met = p.where("n <> ''").join(q, "n").where("pd IS NULL OR qd IS NULL OR pd = qd")
    return met.groupBy("person").agg(F.min_by("profile", "ord").alias("profile"))


def overlay(base: Column, record: Column, reserved: str = "records") -> Column:
    """A vault map overlaid by a record's fields, without the reserved key; keys of the record win."""
    rest = F.map_filter(base, lambda k, v: (k != reserved) & ~F.map_contains_key(record, k))
    return F.map_concat(rest, record)


def plan_import(backup: DataFrame, existing: DataFrame) -> DataFrame:
    """The profile id of every profile of a backup: that of an existing one of its name (ASCII case folded), else its
    own, else one made of its place and name."""
    ascii_lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = existing.groupBy(ascii_lower(F.col("name")).alias("k")).agg(F.min("id").alias("known_id"))
    made = F.concat(F.lit("import-"), F.col("idx").cast("string"), F.lit("-"), F.col("name"))
    joined = backup.withColumn("k", ascii_lower(F.col("name"))).join(known, "k", "left")
    return joined.select("idx", "name", F.coalesce("known_id", F.when(F.col("id") != "", F.col("id")), made).alias("id"), F.col("known_id").isNotNull().alias("merged"))


def choose_profile(counts: DataFrame, group: str) -> DataFrame:
    """The profile with the most fields in each group; the first by `ord` of equals."""
    return counts.groupBy(group).agg(F.max_by("profile", F.struct("n", -F.col("ord"))).alias("profile"))


def new_information(typed: DataFrame, vault: DataFrame) -> DataFrame:
    """Typed pairs that tell something new: a value, no data: URL, a capturable key, not what the vault holds; the first
    such pair of each key, with the prior value. An unchanged pair does not use up its key."""
    usable = typed.where("trim(value) <> '' AND value NOT LIKE 'data:%' AND key <> '' AND NOT key RLIKE '^[0-9_]+$'")
    changed = usable.join(vault.select("key", F.col("value").alias("prior")), "key", "left").where("NOT (trim(value) <=> prior)")
    first = F.row_number().over(Window.partitionBy("key").orderBy("pos"))
    return changed.withColumn("_k", first).where("_k = 1").select("pos", "key", F.trim("value").alias("value"), "prior")
