"""Reconciliation, matching of people, backup import, overlays, set operations."""

from pyspark.sql import functions as F

from formweave.operators import reconcile as rec
from formweave.plans.fixtures import Rows, table
from formweave.plans.registry import query

_SECONDS = "date_diff('second', TIMESTAMP '1970-01-01 00:00:00', ts)"
_SIDE_SQL = f"s AS (SELECT event_id % 2 AS side, user_id, event_type AS key, arg_max(props, event_id) AS value, arg_max({_SECONDS}, event_id) AS updated_at FROM events GROUP BY ALL), l AS (SELECT * FROM s WHERE side = 0), r AS (SELECT * FROM s WHERE side = 1)"


def side(spark, sf, k):
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    rows = table(spark, sf, "events").where(f"event_id % 2 = {k}")
    return rows.groupBy("user_id", F.col("event_type").alias("key")).agg(F.max_by("props", "event_id").alias("value"), F.max_by(seconds, "event_id").alias("updated_at"))


_LWW = """SELECT {keys}, 'to_remote' AS direction, l.value AS value, l.updated_at AS updated_at FROM l LEFT JOIN r USING ({keys}) WHERE r.updated_at IS NULL OR l.updated_at > r.updated_at
UNION ALL SELECT {keys}, 'to_local', r.value, r.updated_at FROM r LEFT JOIN l USING ({keys}) WHERE l.updated_at IS NULL OR (r.updated_at >= l.updated_at AND r.value <> l.value)"""


@query("j5_reconcile_vaults", f"WITH {_SIDE_SQL} {_LWW.format(keys='user_id, key')}")
def j5(spark, sf):
    return rec.reconcile(side(spark, sf, 0), side(spark, sf, 1), ["user_id", "key"])


_L = Rows("l", "key string,value string,updated_at bigint", [("a", "a", 900), ("b", "a", 5), ("c", "x", 9), ("d", "x", 5), ("e", "only", 1), ("g", "s", 4), ("h", "", 2)]).over(key="key || c_custkey", updated_at="updated_at + c_custkey % 3")
_R = Rows("r", "key string,value string,updated_at bigint", [("a", "b", 500), ("b", "b", 5), ("c", "x", 5), ("d", "x", 9), ("f", "only", 1), ("g", "s", 4), ("h", "v", 1)]).over(key="key || c_custkey")


@query("j5_reconcile_ties", f"WITH {_L.cte}, {_R.cte} {_LWW.format(keys='key')}")
def j5_ties(spark, sf):
    return rec.reconcile(_L.frame(spark, sf), _R.frame(spark, sf), ["key"])


@query("j6_migration_plan", f"WITH {_L.cte}, {_R.cte} SELECT key, value, updated_at FROM l WHERE value <> '' AND key NOT IN (SELECT key FROM r WHERE value <> '')")
def j6(spark, sf):
    return rec.migration_plan(_L.frame(spark, sf), _R.frame(spark, sf), ["key"])


@query("u2_key_union", f"WITH {_SIDE_SQL} SELECT user_id, key FROM l UNION SELECT user_id, key FROM r")
def u2(spark, sf):
    return side(spark, sf, 0).select("user_id", "key").union(side(spark, sf, 1).select("user_id", "key")).distinct()


_PEOPLE = Rows("people", "id bigint,name string,dob string", [(1, "John  Doe", "1/15/1985"), (2, "john doe", None), (3, "JOHN-DOE", "02/20/1990"), (4, "Ann Lee", "1990-02-03"), (5, "Ann Lee", "2/3/1990"), (6, "", None), (7, "Zoe Q", "x")]).over(id="c_custkey * 100 + id", name="name || ' ' || c_custkey")
_PROFILES = Rows("profiles", "id bigint,ord bigint,name string,dob string", [(10, 1, "John Doe", "02/20/1990"), (11, 2, "John Doe", "01/15/1985"), (12, 3, "Ann Lee", "02/03/1990"), (13, 4, "Zoe Q", "1/1/2000"), (14, 5, "", None)]).over(id="c_custkey * 100 + id", name="name || ' ' || c_custkey")
_NORM = """SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS n,
  CASE WHEN regexp_matches(dob, '^\\d{1,2}/\\d{1,2}/\\d{4}$') THEN lpad(split_part(dob, '/', 1), 2, '0') || lpad(split_part(dob, '/', 2), 2, '0') || split_part(dob, '/', 3)
       WHEN regexp_matches(dob, '^\\d{4}-\\d{1,2}-\\d{1,2}$') THEN lpad(split_part(dob, '-', 2), 2, '0') || lpad(split_part(dob, '-', 3), 2, '0') || split_part(dob, '-', 1) END AS d FROM """


@query("j16_match_identity", f"WITH {_PEOPLE.cte}, {_PROFILES.cte}, a AS ({_NORM} people), b AS ({_NORM} profiles) SELECT a.id AS person, arg_min(b.id, b.ord) AS profile FROM a JOIN b USING (n) WHERE n <> '' AND (a.d IS NULL OR b.d IS NULL OR a.d = b.d) GROUP BY a.id")
def j16(spark, sf):
    return rec.match_identity(_PEOPLE.frame(spark, sf), _PROFILES.frame(spark, sf))


@query("d2_birth_date_key", f"WITH {_PEOPLE.cte}, a AS ({_NORM} people) SELECT id, d AS dob_key FROM a")
def d2(spark, sf):
    return _PEOPLE.frame(spark, sf).select("id", rec.normal_birth_date(F.col("dob")).alias("dob_key"))


@query("a12_choose_profile", "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT c_nationkey AS nation, arg_max(c_custkey, n * 1000000 - c_custkey) AS profile FROM customer JOIN c ON c_custkey = o_custkey GROUP BY 1")
def a12(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("profile")).agg(F.count(F.lit(1)).alias("n"))
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("profile"), F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("ord"))
    return rec.choose_profile(people.join(n, "profile"), "nation")


_BACKUP = Rows("backup", "idx bigint,id string,name string", [(0, "b0", "Customer#000000007"), (1, "b1", "CUSTOMER#000000008"), (2, "", "New One"), (3, "b3", "Other"), (4, None, "Third")])


@query("s16_backup_import", f"WITH {_BACKUP.cte}, k AS (SELECT lower(c_name) AS k, min(CAST(c_custkey AS VARCHAR)) AS known_id FROM customer GROUP BY 1) SELECT idx, name, coalesce(known_id, nullif(id, ''), 'import-' || idx || '-' || name) AS id, known_id IS NOT NULL AS merged FROM backup LEFT JOIN k ON lower(name) = k.k")
def s16(spark, sf):
    existing = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    return rec.plan_import(_BACKUP.frame(spark, sf), existing)


@query("u5_map_overlay", """WITH b AS (SELECT c_custkey, unnest(['name', 'segment', 'nation']) AS key, unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS value FROM customer),
r AS (SELECT c_custkey, unnest(['segment', 'card']) AS key, unnest(['over', 'k' || c_custkey]) AS value FROM customer WHERE c_custkey % 2 = 0),
m AS (SELECT * FROM r UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.c_custkey = b.c_custkey AND r.key = b.key))
SELECT c_custkey, string_agg(key || '=' || value, ';' ORDER BY key) AS vault FROM m GROUP BY 1""")
def u5(spark, sf):
    base = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("records"), F.lit("[]"))
    card = F.create_map(F.lit("segment"), F.lit("over"), F.lit("card"), F.concat(F.lit("k"), F.col("c_custkey").cast("string")))
    record = F.when(F.col("c_custkey") % 2 == 0, card).otherwise(F.from_json(F.lit("{}"), "map<string,string>"))
    rows = table(spark, sf, "customer").select("c_custkey", rec.overlay(base, record).alias("m"))
    return rows.select("c_custkey", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e.key, F.lit("="), e.value))), ";").alias("vault"))


@query("u3_set_difference", "SELECT 'only_documents' AS side, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'only_labels', count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def u3(spark, sf):
    d, lab = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    return d.subtract(lab).agg(F.count(F.lit(1)).alias("n")).select(F.lit("only_documents").alias("side"), "n").unionByName(lab.subtract(d).agg(F.count(F.lit(1)).alias("n")).select(F.lit("only_labels").alias("side"), "n"))


@query("j25_traceability", "SELECT doc_id AS id, 'no label' AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT item_id + 990, 'no document' FROM benchmark WHERE item_id + 990 NOT IN (SELECT doc_id FROM documents)")
def j25(spark, sf):
    """Symmetric difference of two id sets, each side named."""
    docs, items = table(spark, sf, "documents").select(F.col("doc_id").alias("id")), table(spark, sf, "benchmark").select((F.col("item_id") + 990).alias("id"))
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return docs.join(labelled, "id", "left_anti").withColumn("missing", F.lit("no label")).unionByName(items.join(docs, "id", "left_anti").withColumn("missing", F.lit("no document")))


_TYPED = Rows("typed", "pos bigint,key string,value string", [(1, "city", "Rome"), (2, "city", "Oslo"), (3, "name", "Ann"), (4, "name", "Bea"), (5, "123_", "x"), (6, "photo", "data:image/png"), (7, "phone", "  "), (8, "phone", " 555 "), (9, "", "y")]).over(key="key || c_custkey", pos="c_custkey * 100 + pos")
_VAULT = Rows("vault", "key string,value string", [("name", "Ann"), ("city", "Paris"), ("zip", "1")]).over(key="key || c_custkey")


@query("p10_new_information", f"""WITH {_TYPED.cte}, {_VAULT.cte}, c AS (SELECT pos, key, trim(typed.value) AS value, vault.value AS prior, row_number() OVER (PARTITION BY key ORDER BY pos) AS k FROM typed LEFT JOIN vault USING (key)
 WHERE trim(typed.value) <> '' AND typed.value NOT LIKE 'data:%' AND key <> '' AND NOT regexp_matches(key, '^[0-9_]+$') AND trim(typed.value) IS DISTINCT FROM vault.value) SELECT pos, key, value, prior FROM c WHERE k = 1""")
def p10(spark, sf):
    return rec.new_information(_TYPED.frame(spark, sf), _VAULT.frame(spark, sf))


@query("c1_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def c1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("n1_json_map", "SELECT c_custkey, '{\"name\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment || '\"}' AS json, c_mktsegment AS segment FROM customer")
def n1(spark, sf):
    """A map as JSON with sorted keys, and back."""
    m = F.map_from_entries(F.array_sort(F.array(F.struct(F.lit("segment").alias("k"), F.col("c_mktsegment").alias("v")), F.struct(F.lit("name").alias("k"), F.col("c_name").alias("v")))))
    rows = table(spark, sf, "customer").select("c_custkey", F.to_json(m).alias("json"))
    return rows.select("c_custkey", "json", F.from_json("json", "map<string,string>")["segment"].alias("segment"))


_RECORDS = Rows("records", "owner bigint,id bigint,label string,main boolean", [(1, 1, "visa", False), (1, 2, "Amex", True), (1, 3, "amex", False), (1, 4, "Bank", False), (1, 5, "älpha", False), (2, 6, "Zürich", False), (2, 7, "zurich", True), (2, 8, "Élan", False), (2, 9, "east", False), (2, 10, "elan vital", False)]).over(owner="c_custkey * 100 + owner", id="c_custkey * 100 + id")


@query("o3_records_order", f"WITH {_RECORDS.cte} SELECT id, row_number() OVER (PARTITION BY owner ORDER BY main DESC, lower(strip_accents(label)), lower(label), id) AS place FROM records")
def o3(spark, sf):
    """The records of each owner: primary first, then by label in the root locale's order."""
    from pyspark.sql import Window

    w = Window.partitionBy("owner").orderBy(F.desc("main"), F.collate("label", "UNICODE_CI"), "id")
    return _RECORDS.frame(spark, sf).select("id", F.row_number().over(w).cast("long").alias("place"))
