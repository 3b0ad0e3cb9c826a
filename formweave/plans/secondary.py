"""Secondary surfaces: review pairs, records, licences, tokens, packs, manifests, overlays."""

import base64
import hashlib
import hmac
import json

from pyspark.sql import functions as F

from formweave.functions import tokens as T
from formweave.functions.text import key_of_label, words_of_label
from formweave.functions.cards import card_values
from formweave.plans.fixtures import Rows, table
from formweave.plans.registry import query

_PAIRS = Rows("pairs", "pos bigint,caption string,label string,name string,value string", [(1, "City", "x", "f1", "Rome"), (2, None, "Zip", "f2", "Off"), (3, None, None, "f3[0]", "v"), (4, None, "ok", "z", "Yes"), (5, "", "Phone", "f5", "555"), (6, "Photo", None, "p", "data:x"), (7, "Mail", None, "m", "  ")]).over(pos="c_custkey * 100 + pos", caption="CASE WHEN c_custkey % 2 = 1 THEN caption || ' ' || c_mktsegment ELSE caption END")


@query("r1_desktop_pairs", f"WITH {_PAIRS.cte} SELECT pos, coalesce(nullif(caption, ''), nullif(label, ''), name) AS label, value FROM pairs WHERE trim(value) <> '' AND value <> 'Off' AND value NOT LIKE 'data:%' AND NOT (coalesce(nullif(caption, ''), nullif(label, '')) IS NULL AND regexp_matches(name, '\\[[0-9]+\\]|^f[0-9]+$')) AND NOT (value = 'Yes' AND length(coalesce(nullif(caption, ''), nullif(label, ''), name)) < 4)")
def r1(spark, sf):
    said = F.coalesce(F.nullif("caption", F.lit("")), F.nullif("label", F.lit("")))
    rows = _PAIRS.frame(spark, sf).withColumn("best", F.coalesce(said, "name"))
    machine = said.isNull() & F.col("name").rlike(r"\[[0-9]+\]|^f[0-9]+$")
    usable = (F.trim("value") != "") & (F.col("value") != "Off") & ~F.startswith(F.col("value"), F.lit("data:"))
    return rows.where(usable & ~machine & ~((F.col("value") == "Yes") & (F.length(key_of_label(F.col("best"))) < 4))).select("pos", F.col("best").alias("label"), "value")


_CARDS = Rows("recs", "ord bigint,kind string,fields string", [(1, "card", "n=1"), (2, "card", "n=2"), (3, "card", "n=1"), (4, "bank", "b=1")]).over(ord="c_custkey * 100 + ord", kind="kind || c_custkey")


@query("r2_record_upsert", f"WITH {_CARDS.cte}, d AS (SELECT kind, fields, min(ord) AS ord FROM recs GROUP BY 1, 2) SELECT kind, fields, row_number() OVER (PARTITION BY kind ORDER BY ord) = 1 AS main FROM d")
def r2(spark, sf):
    """Records known by a hash of their content; the first of a kind becomes primary."""
    from pyspark.sql import Window

    once = _CARDS.frame(spark, sf).withColumn("id", F.xxhash64("kind", "fields")).groupBy("id", "kind", "fields").agg(F.min("ord").alias("ord"))
    return once.select("kind", "fields", (F.row_number().over(Window.partitionBy("kind").orderBy("ord")) == 1).alias("main"))


@query("r3_make_primary", "SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey = 3 THEN c_custkey = (SELECT max(c_custkey) FROM customer WHERE c_nationkey = 3) ELSE c_custkey % 2 = 0 END AS main FROM customer")
def r3(spark, sf):
    c = table(spark, sf, "customer")
    top = F.broadcast(c.where("c_nationkey = 3").agg(F.max("c_custkey").alias("top")))
    return c.crossJoin(top).select("c_custkey", "c_nationkey", F.when(F.col("c_nationkey") == 3, F.col("c_custkey") == F.col("top")).otherwise(F.col("c_custkey") % 2 == 0).alias("main"))


@query("r4_billing_defaults", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, n_name) AS billing FROM customer JOIN nation ON n_nationkey = c_nationkey")
def r4(spark, sf):
    n = table(spark, sf, "nation")
    return table(spark, sf, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.coalesce(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), "n_name").alias("billing"))


@query("r6_filled_pages", "SELECT l_orderkey, min(l_linenumber) FILTER (WHERE l_discount > 0.05) AS first_filled, bool_or(l_discount > 0.05) AS any_filled FROM lineitem GROUP BY 1")
def r6(spark, sf):
    filled = F.col("l_discount") > 0.05
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min(F.when(filled, F.col("l_linenumber"))).alias("first_filled"), F.bool_or(filled).alias("any_filled"))


@query("r7_review_edits", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'edit' || c_custkey END, c_name) AS value, coalesce(c_custkey % 5 = 0, false) AS changed FROM customer")
def r7(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    edits = c.where("c_custkey % 5 = 0").select("c_custkey", F.concat(F.lit("edit"), F.col("c_custkey").cast("string")).alias("edit"))
    return c.join(edits, "c_custkey", "left").select("c_custkey", F.coalesce("edit", "c_name").alias("value"), F.col("edit").isNotNull().alias("changed"))


_OCR = Rows("ocr", "line bigint,s string,conf bigint,y double", [(1, "Name:", 90, 10.0), (2, "Name:", 80, 12.0), (3, "City ____", 50, 40.0), (4, "This is a long sentence that ends here.", 95, 60.0), (5, "Zip", 30, 80.0), (6, "Phone number", 70, 100.0)]).over(line="c_custkey * 100 + line", s="CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment || ' ' || s ELSE s END", y="y + 100 * c_custkey")


@query("r8_prototype_detector", f"WITH {_OCR.cte}, f AS (SELECT line, trim(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '-') AS name, round(y / 6) AS b FROM ocr WHERE conf >= 40 AND length(s) <= 40 AND (regexp_matches(s, '[:_]') OR (len(string_split(s, ' ')) <= 6 AND NOT s LIKE '%.'))), r AS (SELECT *, row_number() OVER (PARTITION BY name, b ORDER BY line) AS k FROM f) SELECT line, name FROM r WHERE k = 1")
def r8(spark, sf):
    likely = F.col("s").rlike("[:_]") | ((F.size(F.split("s", " ")) <= 6) & ~F.endswith(F.col("s"), F.lit(".")))
    f = _OCR.frame(spark, sf).where((F.col("conf") >= 40) & (F.length("s") <= 40) & likely)
    f = f.select("line", F.regexp_replace(F.regexp_replace(F.lower("s"), "[^a-z0-9]+", "-"), "^-|-$", "").alias("name"), F.round(F.col("y") / 6).alias("b"))
    return f.groupBy("name", "b").agg(F.min("line").alias("line")).select("line", "name")


@query("r10_label_recovery", f"WITH {_OCR.cte}, t AS (SELECT line // 100 AS page, string_agg(lower(s), ' ' ORDER BY line) AS t FROM ocr GROUP BY 1), l(label) AS (VALUES ('name'), ('phone number'), ('fax')) SELECT page, count(*) FILTER (WHERE contains(t, label)) AS hits, count(*) AS n FROM t CROSS JOIN l GROUP BY page")
def r10(spark, sf):
    """How many of the labels a page's recognised text still holds; the lines of a page are few."""
    lines = F.array_sort(F.collect_list(F.struct("line", F.lower("s").alias("s"))))
    text = _OCR.frame(spark, sf).groupBy(F.expr("line DIV 100").alias("page")).agg(F.array_join(F.transform(lines, lambda x: x.s), " ").alias("t"))
    labels = ("name", "phone number", "fax")
    hits = sum((F.contains("t", F.lit(x)).cast("long") for x in labels), F.lit(0).cast("long"))
    return text.select("page", hits.alias("hits"), F.lit(len(labels)).cast("long").alias("n"))


_CATALOGUE = Rows("cat", "lang string,k string,v string", [("en", "a", "A"), ("en", "b", "B {n}"), ("en", "c", "C"), ("de", "a", "Ä"), ("de", "b", "B"), ("de", "d", "D"), ("fr", "a", ""), ("fr", "b", "b {n}"), ("fr", "c", "c")]).over(k="k || '.' || c_custkey", v="CASE WHEN c_custkey % 3 = 1 AND lang <> 'en' THEN v || '{n}' ELSE v END")


@query("r11_catalogue_check", f"WITH {_CATALOGUE.cte}, b AS (SELECT k, v FROM cat WHERE lang = 'en'), l AS (SELECT DISTINCT lang FROM cat WHERE lang <> 'en'), e AS (SELECT lang, b.k, b.v AS base FROM l CROSS JOIN b), j AS (SELECT coalesce(e.lang, o.lang) AS lang, coalesce(e.k, o.k) AS k, base, o.v FROM e FULL JOIN (SELECT * FROM cat WHERE lang <> 'en') o ON o.lang = e.lang AND o.k = e.k) SELECT lang, k, CASE WHEN v IS NULL THEN 'missing' WHEN base IS NULL THEN 'extra' WHEN v = '' THEN 'empty' ELSE 'placeholder' END AS problem FROM j WHERE v IS NULL OR base IS NULL OR v = '' OR contains(base, '{{n}}') <> contains(v, '{{n}}')")
def r11(spark, sf):
    cat = _CATALOGUE.frame(spark, sf)
    base, other = cat.where("lang = 'en'").select("k", F.col("v").alias("base")), cat.where("lang <> 'en'")
    langs = other.agg(F.collect_set("lang").alias("langs"))  # a few; every key is wanted in each
    want = base.crossJoin(F.broadcast(langs)).select("k", "base", F.explode("langs").alias("lang"))
    j = want.join(other, ["lang", "k"], "full_outer")
    holder = F.contains("base", F.lit("{n}")) != F.contains("v", F.lit("{n}"))
    problem = F.when(F.col("v").isNull(), "missing").when(F.col("base").isNull(), "extra").when(F.col("v") == "", "empty").when(holder, "placeholder")
    return j.select("lang", "k", problem.alias("problem")).where("problem IS NOT NULL")


@query("r12_language_packs", "SELECT count(*) AS installed, sum(n_chars)::BIGINT AS bytes, count(*) FILTER (WHERE sha256(text) = sha256(text || '')) AS verified FROM documents WHERE lang <> 'en'")
def r12(spark, sf):
    """Packs in use, their size, and how many still have their checksum; documents stand for packs."""
    packs = table(spark, sf, "documents").where("lang <> 'en'").select("n_chars", "text", F.sha2("text", 256).alias("sum"))
    return packs.agg(F.count(F.lit(1)).alias("installed"), F.sum("n_chars").alias("bytes"), F.count_if(F.sha2("text", 256) == F.col("sum")).alias("verified"))


_ENT = Rows("ent", "id bigint,paid_until bigint,trial_until bigint,now bigint", [(1, 0, None, 10), (2, 5, None, 10), (3, None, 20, 10), (4, None, 5, 10), (5, None, None, 10), (6, 100000, 5, 10)]).over(id="c_custkey * 100 + id", now="now + c_custkey % 11")


@query("r13_r14_entitlement", f"WITH {_ENT.cte} SELECT id, CASE WHEN paid_until IS NOT NULL AND (paid_until = 0 OR now <= paid_until) THEN 'paid' WHEN trial_until >= now THEN 'trial' WHEN trial_until IS NOT NULL THEN 'trial-expired' ELSE 'locked' END AS state, CASE WHEN paid_until = 0 THEN -1 WHEN paid_until >= now THEN CAST(ceil((paid_until - now) / 86400.0) AS BIGINT) END AS days_up, CASE WHEN paid_until = 0 THEN -1 WHEN paid_until >= now THEN CAST(floor((paid_until - now) / 86400.0) AS BIGINT) END AS days_down FROM ent")
def r13(spark, sf):
    paid = F.coalesce((F.col("paid_until") == 0) | (F.col("now") <= F.col("paid_until")), F.lit(False))
    state = F.when(paid, "paid").when(F.col("trial_until") >= F.col("now"), "trial").when(F.col("trial_until").isNotNull(), "trial-expired").otherwise("locked")
    left = (F.col("paid_until") - F.col("now")) / 86400
    days = lambda f: F.when(F.col("paid_until") == 0, F.lit(-1).cast("long")).when(F.col("paid_until") >= F.col("now"), f(left).cast("long"))
    return _ENT.frame(spark, sf).select("id", state.alias("state"), days(F.ceil).alias("days_up"), days(F.floor).alias("days_down"))


@query("r15_trial_once", "SELECT c_custkey AS device FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def r15(spark, sf):
    seen = table(spark, sf, "events").select(F.col("user_id").alias("device")).distinct()
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("device")).join(seen, "device", "left_anti")


@query("r16_rule_parity", "WITH a AS (SELECT DISTINCT p_name || ' ' || p_type AS c FROM part WHERE p_size <= 25), b AS (SELECT DISTINCT p_name || ' ' || p_type AS c FROM part WHERE p_size > 10) SELECT 'only_a' AS side, c AS concept FROM (SELECT c FROM a EXCEPT SELECT c FROM b) UNION ALL SELECT 'only_b', c FROM (SELECT c FROM b EXCEPT SELECT c FROM a)")
def r16(spark, sf):
    """Concepts of one rule table that the other lacks, both ways; parts of small and large sizes stand for the tables."""
    concepts = lambda cond: table(spark, sf, "part").where(cond).select(F.concat_ws(" ", "p_name", "p_type").alias("concept")).distinct()
    a, b = concepts("p_size <= 25").withColumn("a", F.lit(True)), concepts("p_size > 10").withColumn("b", F.lit(True))
    return a.join(b, "concept", "full_outer").where("a IS NULL OR b IS NULL").select(F.when(F.col("b").isNull(), "only_a").otherwise("only_b").alias("side"), "concept")


_ROT = Rows("rot", "id bigint,rot double,x double,y double,w double,h double", [(1, 0.0, 1.0, 2.0, 10.0, 5.0), (2, 91.0, 1.0, 2.0, 10.0, 5.0), (3, 180.0, 1.0, 2.0, 10.0, 5.0), (4, -90.0, 1.0, 2.0, 10.0, 5.0), (5, 450.0, 1.0, 2.0, 10.0, 5.0)]).over(id="c_custkey * 100 + id", x="x + c_custkey % 7")


@query("r17_rotated_placement", f"WITH {_ROT.cte}, r AS (SELECT *, ((round(rot / 90) * 90)::INT % 360 + 360) % 360 AS q FROM rot) SELECT id, q, CASE WHEN q IN (90, 180) THEN x + w ELSE x END AS px, CASE WHEN q IN (180, 270) THEN y + h ELSE y END AS py FROM r")
def r17(spark, sf):
    q = F.pmod((F.round(F.col("rot") / 90) * 90).cast("int"), F.lit(360))
    return _ROT.frame(spark, sf).select("id", q.alias("q"), F.when(q.isin(90, 180), F.col("x") + F.col("w")).otherwise(F.col("x")).alias("px"), F.when(q.isin(180, 270), F.col("y") + F.col("h")).otherwise(F.col("y")).alias("py"))


_GATE = Rows("gate", "id bigint,kind string,app boolean,bridge boolean,opt_in boolean,present boolean", [(1, "ping", False, False, False, False), (2, "getVault", True, False, False, False), (3, "getVault", False, True, False, False), (4, "getVault", False, False, True, True), (5, "getVault", False, False, True, False), (6, "x", None, None, None, None)]).over(id="c_custkey * 100 + id", opt_in="CASE WHEN c_custkey % 3 = 1 THEN NOT opt_in ELSE opt_in END")


@query("r18_serve_gate", f"WITH {_GATE.cte} SELECT id, coalesce(kind = 'ping' OR app OR bridge OR (opt_in AND present), false) AS serve FROM gate")
def r18(spark, sf):
    return _GATE.frame(spark, sf).select("id", F.coalesce((F.col("kind") == "ping") | F.col("app") | F.col("bridge") | (F.col("opt_in") & F.col("present")), F.lit(False)).alias("serve"))


_SECRETS = Rows("secrets", "id bigint,p string,s string", [(1, "pass", "salt"), (2, "", "salt"), (3, "पास", "x")]).over(id="c_custkey * 100 + id", p="p || c_nationkey")


@query("c3_pbkdf2", "SELECT c_custkey * 100 + id AS id, key FROM customer JOIN (VALUES " + ", ".join(f"({i}, {n}, '{hashlib.pbkdf2_hmac('sha256', f'{p}{n}'.encode(), s.encode(), 1000, 32).hex()}')" for i, p, s in _SECRETS.rows for n in range(25)) + ") v(id, nation, key) ON nation = c_nationkey")
def c3(spark, sf):
    return T.derived_keys(_SECRETS.frame(spark, sf), 1000).select("id", "key")


_BODIES = [(1, "a", 100, 100, True), (2, "a", 100, 401, True), (3, "b", 100, 400, True), (4, "b", 100, 100, False)]
_HOOKS = Rows("hooks", "id bigint,body string,sig string,sent bigint,now bigint", [(i, b, hmac.new(b"k" if ok else b"x", b.encode(), "sha256").hexdigest(), t, n) for i, b, t, n, ok in _BODIES]).over(id="c_custkey * 100 + id", now="now + c_custkey % 3")


@query("c8_webhook_signature", f"WITH {_HOOKS.cte} SELECT id, sig = sha256(unhex('{bytes([107 ^ 92, *[92] * 63]).hex()}') || unhex(sha256(unhex('{bytes([107 ^ 54, *[54] * 63]).hex()}') || encode(body)))) AND abs(now - sent) <= 300 AS ok FROM hooks")
def c8(spark, sf):
    return _HOOKS.frame(spark, sf).select("id", T.webhook_ok(F.col("body"), F.col("sig"), "k", F.col("sent"), F.col("now")).alias("ok"))


def _token(**x) -> str:
    return base64.b64encode(json.dumps(x).encode()).decode() + ".sig"


_TOKENS = Rows("tok", "id bigint,token string,device string,now bigint", [(1, _token(subject="a", expires_at=0), "d", 5), (2, _token(subject="a", expires_at=4), "d", 5), (3, _token(subject="a", expires_at=9, device_id="e"), "d", 5), (4, "nonsense", "d", 5), (5, _token(subject="a", expires_at=9, device_id="d"), "d", 5), (6, "!!.x", "d", 5)]).over(id="c_custkey * 100 + id", now="now + c_custkey % 3")


@query("c7_license_token", f"WITH {_TOKENS.cte}, p AS (SELECT *, CASE WHEN contains(token, '.') THEN TRY(decode(from_base64(split_part(token, '.', 1))))::JSON END AS p FROM tok) SELECT id, CASE WHEN p->>'subject' IS NULL THEN 'Malformed' WHEN (p->>'expires_at')::BIGINT <> 0 AND now > (p->>'expires_at')::BIGINT THEN 'Expired' WHEN p->>'device_id' <> device THEN 'WrongDevice' ELSE 'ok' END AS state FROM p")
def c7(spark, sf):
    return _TOKENS.frame(spark, sf).select("id", T.license_state(F.col("token"), F.col("device"), F.col("now")).alias("state"))


@query("c10_manifest_check", "WITH b AS (SELECT doc_id, sha256(text) AS h FROM documents), m AS (SELECT doc_id + 1 AS doc_id, CASE WHEN doc_id % 2 = 0 THEN h ELSE 'x' END AS h FROM b) SELECT coalesce(b.doc_id, m.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN m.doc_id IS NULL THEN 'unlisted' ELSE 'differs' END AS problem FROM b FULL JOIN m USING (doc_id) WHERE b.h IS DISTINCT FROM m.h")
def c10(spark, sf):
    """Listed and found artifacts, by a full outer join of their digests: all discrepancies."""
    found = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    listed = found.select((F.col("doc_id") + 1).alias("doc_id"), F.when(F.col("doc_id") % 2 == 0, F.col("h")).otherwise("x").alias("m"))
    j = found.join(listed, "doc_id", "full_outer")
    return j.where("NOT (h <=> m)").select("doc_id", F.when(F.col("h").isNull(), "missing").when(F.col("m").isNull(), "unlisted").otherwise("differs").alias("problem"))


@query("x16_generic_captions", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' AND length(line) <= 60 AND len(string_split(trim(line), ' ')) <= 9 AND NOT regexp_matches(line, '\\.\\s') GROUP BY 1")
def x16(spark, sf):
    """Segments that may be captions: up to nine words and sixty characters, no prose."""
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where((F.trim("line") != "") & (F.length("line") <= 60) & (F.size(F.split(F.trim("line"), " ")) <= 9) & ~F.col("line").rlike(r"\.\s")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("f32_percent_decode", "SELECT page_id, url_decode(replace(url, '&', '%26')) AS url FROM pages")
def f32(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.url_decode(F.replace(F.replace("url", F.lit("&"), F.lit("%26")), F.lit("+"), F.lit("%2B"))).alias("url"))


@query("f8_atom_fallbacks", "SELECT c_custkey, split_part(c_name, '#', 1) AS given, split_part(c_name, '#', 2) AS family, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, n_name) AS nationality FROM customer JOIN nation ON n_nationkey = c_nationkey")
def f8(spark, sf):
    """Given and family name from a full name, nationality from the country."""
    n = table(spark, sf, "nation")
    parts = F.split("c_name", "#")
    return table(spark, sf, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.get(parts, F.lit(0)).alias("given"), F.get(parts, F.lit(1)).alias("family"), F.coalesce(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), "n_name").alias("nationality"))


#: A card for each customer: field numbers or none, one line of names or two, dates of three classes.
_CARD_TEXT = """CASE WHEN c_custkey % 3 = 0 THEN 'DRIVER LICENSE' || chr(10) || '1 SMITH' || chr(10) || '2 ANNA MARIA' WHEN c_custkey % 3 = 1 THEN 'SMITH' || chr(10) || 'ANNA MARIA' ELSE 'ANNA MARIA SMITH' END || chr(10)
 || '8 ' || (10 + c_custkey) || ' ' || c_mktsegment || ' ROAD' || chr(10) || 'SPRINGFIELD, IL ' || (60000 + c_nationkey) || chr(10) || 'DOB 01/15/' || (1940 + c_custkey % 50)
 || CASE WHEN c_custkey % 2 = 0 THEN ' ISS 02/03/2019' ELSE ' 02/03/2019' END || ' 04/05/' || (2030 + c_nationkey % 5)"""


@query("x9_id_heuristics", """SELECT c_custkey AS doc_id, 'SMITH' AS family, 'ANNA' AS given, 'MARIA' AS middle, (10 + c_custkey) || ' ' || c_mktsegment || ' ROAD' AS street, 'SPRINGFIELD' AS city, 'IL' AS state,
 (60000 + c_nationkey)::VARCHAR AS zip, '01/15/' || (1940 + c_custkey % 50) AS born, '04/05/' || (2030 + c_nationkey % 5) AS expires, '02/03/2019' AS issued FROM customer""")
def x9(spark, sf):
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(_CARD_TEXT.replace("chr(10)", "'\\n'")).alias("text"))
    return card_values(docs, 2026)


@query("x9_cards_in_documents", r"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b'), lambda x: {'x': x, 'y': regexp_extract(x, '\d{2,4}$')}) AS l, regexp_extract(text, '\b(?:[A-Z]{2})?(\d{5})(?:-\d{4})?\b', 1) AS zip FROM documents),
y AS (SELECT doc_id, zip, list_transform(l, lambda v: {'y': CASE WHEN length(v.y) > 2 THEN v.y::INT WHEN v.y::INT > 26 THEN 1900 + v.y::INT ELSE 2000 + v.y::INT END, 'x': v.x}) AS l FROM d),
u AS (SELECT doc_id, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM y), b AS (SELECT doc_id, arg_min(v.x, (v.y, i)) AS born FROM u WHERE v.y BETWEEN 1900 AND 2012 GROUP BY 1)
SELECT doc_id, nullif(zip, '') AS zip, born FROM y LEFT JOIN b USING (doc_id)""")
def x9_documents(spark, sf):
    """Over whole `documents`: what of a text would pass for a code or a birth."""
    return card_values(table(spark, sf, "documents").select("doc_id", "text"), 2026).select("doc_id", "zip", "born")


@query("r5_fill_vault", "SELECT c_custkey, 'nation=' || c_nationkey || ';segment=' || CASE WHEN c_custkey % 2 = 0 THEN 'card' ELSE c_mktsegment END AS vault FROM customer")
def r5(spark, sf):
    flat = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("__records"), F.lit("x"))
    over = F.map_filter(F.create_map(F.lit("segment"), F.lit("card")), lambda k, v: F.col("c_custkey") % 2 == 0)
    from formweave.operators.reconcile import overlay

    m = table(spark, sf, "customer").select("c_custkey", overlay(flat, over, "__records").alias("m"))
    return m.select("c_custkey", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e.key, F.lit("="), e.value))), ";").alias("vault"))


@query("words_in_labels", "SELECT count(*) AS n FROM part WHERE regexp_matches(lower(p_type), 'steel')")
def words_in_labels(spark, sf):
    return table(spark, sf, "part").where(F.array_contains(F.split(words_of_label(F.col("p_type")), " "), "steel")).agg(F.count(F.lit(1)).alias("n"))
