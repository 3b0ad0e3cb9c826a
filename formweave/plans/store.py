"""Store core: scans, upserts, deletes, versions, saved forms."""

from pyspark.sql import functions as F

from formweave.operators import store
from formweave.plans.fixtures import table
from formweave.plans.registry import query

_POINTS_SQL = """p AS (
  SELECT c_custkey AS profile_id, unnest(['balance', 'name', 'nation', 'segment']) AS key,
         unnest([CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS value
  FROM customer)"""
_VERSIONS_SQL = """v AS (
  SELECT l_orderkey AS instance_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS version_no,
         l_partkey, l_shipdate FROM lineitem)"""


def profiles(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def points(spark, sf):
    fields = {"balance": F.floor("c_acctbal").cast("long"), "name": F.col("c_name"), "nation": F.col("c_nationkey"), "segment": F.col("c_mktsegment")}
    return store.unpivot_points(table(spark, sf, "customer"), "c_custkey", fields)


def versions(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("instance_id"), "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    return store.number_versions(rows, "instance_id", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")


def instances(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("instance_id"), F.col("o_custkey").alias("profile_id"), F.col("o_orderdate").alias("created_at"))


@query("s3_list_profiles", "SELECT c_custkey AS id, c_name AS name FROM customer")
def s3(spark, sf):
    return store.list_profiles(profiles(spark, sf))


@query("s4_vault_scan", f"WITH {_POINTS_SQL} SELECT profile_id, key, value FROM p WHERE profile_id % 7 = 3")
def s4(spark, sf):
    return points(spark, sf).where("profile_id % 7 = 3").orderBy("profile_id", "key")


@query("a13_vault_map", f"WITH {_POINTS_SQL} SELECT profile_id, string_agg(key || '=' || value, ';' ORDER BY key) AS vault FROM p GROUP BY profile_id")
def a13(spark, sf):
    entry = F.transform(F.map_entries("vault"), lambda e: F.concat(e.key, F.lit("="), e.value))
    return store.vault(points(spark, sf)).select("profile_id", F.array_join(entry, ";").alias("vault"))


@query("a1_field_counts", f"WITH {_POINTS_SQL} SELECT profile_id, count(*) AS n_fields FROM p WHERE NOT (key = 'nation' AND value = '7') GROUP BY profile_id")
def a1(spark, sf):
    return store.field_counts(points(spark, sf).where("NOT (key = 'nation' AND value = '7')"))


@query("j3_profiles_with_counts", f"WITH {_POINTS_SQL}, f AS (SELECT profile_id, count(*) AS n FROM p WHERE profile_id % 3 = 0 GROUP BY 1) SELECT c_custkey AS id, c_name AS name, coalesce(n, 0) AS n_fields FROM customer LEFT JOIN f ON c_custkey = profile_id")
def j3(spark, sf):
    return store.profiles_with_counts(profiles(spark, sf), points(spark, sf).where("profile_id % 3 = 0"))


@query("p3_large_values", f"WITH {_POINTS_SQL} SELECT profile_id, count(*) FILTER (WHERE strlen(value) <= 9) AS n_small, coalesce(string_agg(key, ',' ORDER BY key) FILTER (WHERE strlen(value) > 9), '') AS large FROM p GROUP BY profile_id")
def p3(spark, sf):
    return store.large_values(points(spark, sf), 9)


@query("p4_meta_scan", f"WITH {_POINTS_SQL} SELECT profile_id, key, strlen(value) AS n_bytes FROM p WHERE strlen(value) <= 9")
def p4(spark, sf):
    return points(spark, sf).where(F.octet_length("value") <= 9).select("profile_id", "key", F.octet_length("value").cast("long").alias("n_bytes"))


@query("p5_point_field", "SELECT c_custkey AS profile_id, c_mktsegment AS value FROM customer WHERE c_custkey = 42")
def p5(spark, sf):
    return points(spark, sf).where("profile_id = 42 AND key = 'segment'").select("profile_id", "value")


@query("p6_upsert", f"""WITH {_POINTS_SQL}, e AS (
  SELECT user_id AS profile_id, 'segment' AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id)
SELECT profile_id, key, value FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.profile_id = p.profile_id AND e.key = p.key) UNION ALL SELECT profile_id, key, value FROM e""")
def p6(spark, sf):
    changes = table(spark, sf, "events").select(F.col("user_id").alias("profile_id"), F.lit("segment").alias("key"), F.col("event_type").alias("value"), "event_id")
    return store.upsert(points(spark, sf), changes, ["profile_id", "key"], "event_id")


@query("p7_insert_if_absent", """SELECT o_orderkey AS instance_id, o_custkey AS profile_id FROM orders UNION ALL
SELECT event_id + 1000 AS instance_id, user_id AS profile_id FROM events WHERE event_id + 1000 NOT IN (SELECT o_orderkey FROM orders)""")
def p7(spark, sf):
    new = table(spark, sf, "events").select((F.col("event_id") + 1000).alias("instance_id"), F.col("user_id").alias("profile_id"), "event_id")
    return store.insert_if_absent(instances(spark, sf).select("instance_id", "profile_id"), new, ["instance_id"], "event_id")


@query("p8_delete_points", f"WITH {_POINTS_SQL} SELECT profile_id, key, value FROM p WHERE NOT (key = 'balance' AND profile_id % 2 = 0)")
def p8(spark, sf):
    return points(spark, sf).where(~((F.col("key") == "balance") & (F.col("profile_id") % 2 == 0)))


@query("p9_cascading_delete", """WITH g AS (SELECT c_custkey FROM customer WHERE c_nationkey = 5), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM g))
SELECT 'profiles' AS kept, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM g) UNION ALL SELECT 'points', 4 * count(*) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM g)
UNION ALL SELECT 'instances', count(*) FROM o UNION ALL SELECT 'removed_points', 4 * count(*) FROM g""")
def p9(spark, sf):
    gone = table(spark, sf, "customer").where("c_nationkey = 5").select(F.col("c_custkey").alias("id"))
    all_points = points(spark, sf)
    kept, (kept_points, kept_instances) = store.delete_cascade(profiles(spark, sf), [all_points, instances(spark, sf)], gone, "id", "profile_id")
    removed = all_points.join(gone, all_points.profile_id == gone.id, "left_semi")
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kept"), "n") for k, df in (("profiles", kept), ("points", kept_points), ("instances", kept_instances), ("removed_points", removed))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("w1_version_numbers", f"WITH {_VERSIONS_SQL} SELECT instance_id, version_no, l_partkey FROM v")
def w1(spark, sf):
    return versions(spark, sf).select("instance_id", "version_no", "l_partkey")


@query("w2_latest_version", f"WITH {_VERSIONS_SQL} SELECT instance_id, max(version_no) AS version_no, arg_max(l_partkey, version_no) AS l_partkey FROM v GROUP BY instance_id")
def w2(spark, sf):
    return store.latest_version(versions(spark, sf).select("instance_id", "version_no", "l_partkey"), "instance_id")


@query("a3_next_version", f"WITH {_VERSIONS_SQL} SELECT o_orderkey AS instance_id, coalesce(max(version_no), 0) + 1 AS version_no FROM orders LEFT JOIN v ON o_orderkey = instance_id GROUP BY o_orderkey")
def a3(spark, sf):
    new = instances(spark, sf).select("instance_id", "created_at")
    return store.next_versions(versions(spark, sf), new, "instance_id", "created_at").select("instance_id", F.col("version_no").cast("long").alias("version_no"))


@query("a2_event_count", "SELECT user_id AS instance_id, count(*) FILTER (WHERE event_type = 'click') AS n_click FROM events GROUP BY user_id")
def a2(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("instance_id"), F.col("event_type").alias("kind"))
    return store.event_counts(events, "instance_id", "click")


@query("saved_forms", f"""WITH {_VERSIONS_SQL}, l AS (SELECT instance_id, max(version_no) AS latest_version FROM v GROUP BY 1),
s AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n FROM events GROUP BY 1), g AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT o_orderkey AS instance_id, o_custkey AS profile_id, latest_version, coalesce(n, 0) AS n_saves, g.l_orderkey IS NOT NULL AS signed, o_orderdate AS created_at
FROM orders JOIN l ON instance_id = o_orderkey LEFT JOIN s ON user_id = o_custkey LEFT JOIN g ON g.l_orderkey = o_orderkey""")
def saved_forms(spark, sf):
    """J4: instances with their latest version (none without one), save counts and a signature flag, newest first."""
    latest = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("instance_id")).agg(
        F.count(F.lit(1)).alias("latest_version"), F.bool_or(F.col("l_returnflag") == "R").alias("signed")
    )
    saves = table(spark, sf, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("profile_id")).agg(F.count(F.lit(1)).alias("n"))
    joined = instances(spark, sf).join(latest, "instance_id").join(saves, "profile_id", "left")
    return joined.select("instance_id", "profile_id", "latest_version", F.coalesce("n", F.lit(0)).alias("n_saves"), "signed", "created_at").orderBy(F.desc("created_at"), "instance_id")


@query("j1_catalog_autofill", f"""WITH {_POINTS_SQL}, f AS (SELECT 'f' || k AS name, k AS ord, ['name', 'nation', 'phone', 'segment'][k] AS ontology_key FROM range(1, 5) r(k))
SELECT i.c_custkey AS profile_id, f.name, f.ord::INT AS ord, f.ontology_key, p.value FROM customer i CROSS JOIN f LEFT JOIN p ON p.profile_id = i.c_custkey AND p.key = f.ontology_key""")
def j1(spark, sf):
    """Left outer join of an entry's fields with each vault: a missing key leaves a null value, an empty one stays."""
    fields = F.array(*(F.struct(F.lit(f"f{k}").alias("name"), F.lit(k).alias("ord"), F.lit(key).alias("ontology_key")) for k, key in enumerate(("name", "nation", "phone", "segment"), 1)))
    wanted = profiles(spark, sf).select(F.col("id").alias("profile_id"), F.explode(fields).alias("f")).select("profile_id", "f.*")
    values = points(spark, sf).withColumnRenamed("key", "ontology_key")
    return wanted.join(values, ["profile_id", "ontology_key"], "left").select("profile_id", "name", "ord", "ontology_key", "value")


@query("j2_fill_plan", f"""WITH {_POINTS_SQL} SELECT profile_id, s.selector, value FROM p JOIN (VALUES ('#n', 'name'), ('#s', 'segment'), ('#x', 'fax')) s(selector, ontology_key) ON key = ontology_key""")
def j2(spark, sf):
    dom = spark.createDataFrame([("#n", "name"), ("#s", "segment"), ("#x", "fax")], "selector string, key string")
    return points(spark, sf).join(dom, "key").select("profile_id", "selector", "value")


@query("s5_autofill_history", """WITH r AS (SELECT event_id % 3 AS browser, event_type AS name, props AS value, ts, user_id, event_id, row_number() OVER (PARTITION BY event_id % 3 ORDER BY ts DESC, user_id DESC, event_id) AS k FROM events)
SELECT browser, name, value, event_id FROM r WHERE k <= 500 AND trim(name) <> '' AND trim(value) <> ''""")
def s5(spark, sf):
    """Browser history: the latest rows of each source (the limit is a source's), blank names and values dropped."""
    parts = [table(spark, sf, "events").where(f"event_id % 3 = {b}").orderBy(F.desc("ts"), F.desc("user_id"), "event_id").limit(500).select(F.lit(b).cast("long").alias("browser"), F.col("event_type").alias("name"), F.col("props").alias("value"), "event_id") for b in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("trim(name) <> '' AND trim(value) <> ''")


@query("s6_chunked_value", """WITH n AS (SELECT page_id, strlen(html) AS total FROM pages) SELECT page_id, unnest(range(0, total, 4096))::BIGINT AS start, least(4096, total - unnest(range(0, total, 4096)))::BIGINT AS n_bytes, total::BIGINT AS total FROM n""")
def s6(spark, sf):
    """Byte chunks of one value: (offset, length) with the total; the last chunk is done."""
    raw = table(spark, sf, "pages").select("page_id", F.col("html").cast("binary").alias("raw"))
    total = F.octet_length("raw").cast("long")
    starts = raw.where(total > 0).select("page_id", "raw", total.alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), total - 1, F.lit(4096).cast("long"))).alias("start"))
    return starts.select("page_id", "start", F.octet_length(F.substring("raw", (F.col("start") + 1).cast("int"), 4096)).cast("long").alias("n_bytes"), "total")


@query("o1_orders", "SELECT c_custkey, c_name FROM customer ORDER BY c_name LIMIT 10")
def o1(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name").orderBy("c_name").limit(10)


@query("u1_union_sources", "SELECT c_custkey AS id, 'customer' AS src FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def u1(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("src"))
    return a.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("src")))
