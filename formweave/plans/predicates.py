"""Predicates over pages, documents and literal rows."""

from pyspark.sql import functions as F

from formweave.functions import predicates as P
from formweave.functions import text as X
from formweave.plans.fixtures import Rows, part_sql, phrase_sql, table
from formweave.plans.registry import query

_URLS = Rows("urls", "url string", [("http://172.16.0.1/x",), ("https://172.32.0.1/x",), ("ftp://x/y",), ("https://localhost:8080/",), ("http://10.example.com/",), ("https://a.internal",), ("https://u:p@example.com/a?b#c",), ("http://[::1]/",), ("nonsense",), ("https://ok.example.org",), ("https://169.254.1.1",), ("HTTP://127.0.0.1",)]).over(url="CASE WHEN c_custkey % 2 = 0 THEN url ELSE url || '?c=' || c_custkey END")
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1))"
_STATE = rf"""CASE WHEN NOT regexp_matches(url, '^(?i:https?)://[^/?#\s]+') OR {_HOST} = '' THEN 'InvalidUrl'
  WHEN trim({_HOST}, '[]') IN ('localhost', '0.0.0.0', '::1') OR regexp_matches({_HOST}, '^(127|10|192\.168|169\.254)\.|^172\.0*(1[6-9]|2[0-9]|3[01])\.|\.(internal|local)$') THEN 'Blocked' ELSE 'ok' END"""


@query("p12_url_state", f"WITH {_URLS.cte} SELECT url, {_STATE} AS state FROM urls")
def p12(spark, sf):
    return _URLS.frame(spark, sf).select("url", P.url_state(F.col("url")).alias("state"))


@query("p11_blocked_pages", f"SELECT {_STATE} AS state, count(*) AS n FROM pages GROUP BY 1")
def p11(spark, sf):
    return table(spark, sf, "pages").groupBy(P.url_state(F.col("url")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("p13_safe_issuer", f"WITH {_URLS.cte} SELECT url, regexp_matches(url, '^(?i:https)://[^/?#@\\s]+([/?#]|$)') AND {_STATE} = 'ok' AS safe FROM urls")
def p13(spark, sf):
    return _URLS.frame(spark, sf).select("url", P.safe_issuer(F.col("url")).alias("safe"))


_ROLES = Rows("roles", "id bigint,role string", [(1, "owner"), (2, "agent"), (3, "viewer"), (4, "ghost")]).over(id="c_custkey * 100 + id", role="CASE WHEN c_nationkey % 5 = 0 THEN 'viewer' ELSE role END")
_CAPS = Rows("caps", "role string,capability string", [("owner", "fill"), ("owner", "sign"), ("owner", "share"), ("agent", "fill"), ("agent", "share"), ("viewer", "view")])


@query("p14_capabilities", f"WITH {_ROLES.cte}, {_CAPS.cte}, k AS (SELECT DISTINCT capability FROM caps) SELECT id, k.capability, caps.role IS NOT NULL AS allowed FROM roles CROSS JOIN k LEFT JOIN caps ON caps.role = roles.role AND caps.capability = k.capability")
def p14(spark, sf):
    """Role times capability; an unknown role may do nothing."""
    caps = _CAPS.frame(spark, sf)
    kinds = F.broadcast(caps.select("capability").distinct())
    asked = _ROLES.frame(spark, sf).crossJoin(kinds)
    return asked.join(F.broadcast(caps.withColumn("ok", F.lit(True))), ["role", "capability"], "left").select("id", "capability", F.coalesce("ok", F.lit(False)).alias("allowed"))


_LABELS = Rows(
    "labels_", "id bigint,label string,name string",
    [(1, "Last Digit", "HKIDCheckingDigit"), (2, "Family Name", "familyName"), (3, "For Official Use", None), (4, "Employer's Name", "EmployerName"), (5, "Other Names You Have Used Since Birth", "x"), (6, "Mother Name", "motherName"), (7, "Spouse’s Date of Birth", "P4_Line2_Dob[1]"),
     (8, "Your Applicant's phone", None), (9, "Please describe why?", None), (10, "Comments", "c1"), (11, "Next of kin", "nok"), (12, "", None), (13, "12 34", None), (14, "Select", None), (15, "पूरा नाम", "full"), (16, "Date of expiry (dd/mm)", "doe"), (17, "Approved by", None), (18, "Schools attended", "row 3"),
     (19, "metadata-form-0__group__vets100ADisability", None), (20, "Please check one of the boxes below", None), (21, "Select one", None), (22, "homePhoneNumberOfApplicant", None), (23, "form1[0].subform", None), (24, "Selection of goods", None),
     (25, "Interpreter’s Name", "interp"), (26, "Friend or witness", "w"), (27, "Name of deceased", "d"), (28, "Notes", "notes2"), (29, "Noteworthy", "n"), (30, "Do not write here", None), (31, "How often do they travel", None)],
).over(id="c_custkey * 100 + id", label="CASE WHEN c_custkey % 3 = 0 THEN label || ' ' || lower(c_mktsegment) WHEN c_custkey % 3 = 1 THEN c_mktsegment || ' ' || label ELSE label END")
_CAP = lambda c: rf"trim(regexp_replace(lower(regexp_replace(coalesce({c}, ''), '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_NORM = lambda c: rf"trim(regexp_replace(lower(regexp_replace(regexp_replace(coalesce({c}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g'))"


@query("p15_office_use", f"WITH {_LABELS.cte} SELECT id, {part_sql(_NORM('label'), P.CHECK_DIGITS)} OR {part_sql(_NORM('name'), P.CHECK_DIGITS)} OR {phrase_sql(_NORM('label'), P.OFFICE_USE)} OR {phrase_sql(_NORM('name'), P.OFFICE_USE)} AS office FROM labels_")
def p15(spark, sf):
    return _LABELS.frame(spark, sf).select("id", P.office_use(F.col("label"), F.col("name")).alias("office"))


@query("p16_other_entity", f"WITH {_LABELS.cte} SELECT id, len(list_intersect(list_transform(string_split({_CAP('label')}, ' '), lambda w: regexp_replace(w, 's$', '')), [{', '.join(repr(e.removesuffix('s')) for e in P.ENTITIES)}])) > 0 OR contains({_CAP('label')}, 'next of kin') AS entity FROM labels_")
def p16(spark, sf):
    return _LABELS.frame(spark, sf).select("id", P.other_entity(F.col("label")).alias("entity"))


@query("p17_other_name", f"WITH {_LABELS.cte}, w(p) AS (VALUES {', '.join(f'({e!r})' for e in P.OTHER_NAMES)}) SELECT id, bool_or(contains(' ' || {_CAP('label')} || ' ', ' ' || p || ' ')) AS other FROM labels_ CROSS JOIN w GROUP BY id")
def p17(spark, sf):
    return _LABELS.frame(spark, sf).select("id", P.other_name(F.col("label")).alias("other"))


@query("p18_other_subject", f"WITH {_LABELS.cte} SELECT id, len(list_filter(regexp_extract_all(coalesce(label, ''), '\\b([A-Za-z]{{3,}})[''’]s', 1), lambda o: lower(o) NOT IN {P.SELF})) > 0 AS other FROM labels_")
def p18(spark, sf):
    return _LABELS.frame(spark, sf).select("id", P.other_subject(F.col("label"), F.lit(None).cast("string"), F.lit("")).alias("other"))


_FIELDS = Rows("fields", "id string,tip string", [("form1[0].#sub[2].P4_Line1_StreetName[0]", "list all addresses"), ("f[0].CityTown3[0]", "List every place"), ("f[0].CityTown3[0]", "your city"), ("a.Name 2", "information about your children"), ("a.b[1].x", "list all"), ("a.Row[2][0]", "during the last 5 years")]).over(tip="CASE WHEN c_custkey % 2 = 0 THEN tip ELSE tip || ' ' || c_mktsegment END", id="CASE WHEN c_custkey % 2 = 0 THEN id ELSE 'c' || c_custkey || '.' || id END")


@query("p19_repeating_row", f"WITH {_FIELDS.cte}, l AS (SELECT id, tip, string_split(regexp_replace(id, '\\[[0-9]+\\]$', ''), '.')[-1] AS leaf FROM fields) SELECT id, tip, (regexp_matches(leaf, '[A-Za-z][0-9]$') OR regexp_matches(leaf, '(?i)(name|line|row|entry)\\s*[2-9]') OR regexp_matches(leaf, '\\[[1-9]\\]')) AND regexp_matches(tip, '(?i)list (all|every|where)|during the (last|past)\\s*[0-9]|information about your (children|employment|marital)') AS repeats FROM l")
def p19(spark, sf):
    return _FIELDS.frame(spark, sf).select("id", "tip", P.repeating_row(F.col("id"), F.col("tip"), F.lit("")).alias("repeats"))


@query("p20_capturable_label", f"WITH {_LABELS.cte}, k AS (SELECT id, regexp_replace(regexp_replace(lower(regexp_replace(coalesce(label, ''), '\\([^)]*\\)', ' ', 'g')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '_', 'g'), '^_+|_+$', '', 'g') AS key FROM labels_) SELECT id, key, key <> '' AND NOT regexp_matches(key, '^[\\p{{N}}_]+$') AS capturable FROM k")
def p20(spark, sf):
    return _LABELS.frame(spark, sf).select("id", X.key_of_label(F.col("label")).alias("key"), X.capturable(F.col("label")).alias("capturable"))


@query("p21_junk_label", f"WITH {_LABELS.cte}, t AS (SELECT id, coalesce(label, '') AS t FROM labels_) SELECT id, t = '' OR {part_sql('lower(t)', P.MACHINE_PARTS)} OR regexp_matches(lower(t), '\\bmetadata[-_]') OR regexp_matches(lower(t), 'form-?[0-9]') OR (length(t) > 18 AND NOT contains(t, ' ') AND (regexp_matches(t, '[A-Z][a-z].*[A-Z]') OR regexp_matches(t, '[a-z][0-9]') OR contains(t, '_'))) OR len(list_filter([{', '.join(map(repr, P.INSTRUCTIONS))}], lambda p: starts_with(regexp_replace(lower(trim(t)), '[^a-z]+', ' ', 'g') || ' ', p || ' '))) > 0 AS junk FROM t")
def p21(spark, sf):
    return _LABELS.frame(spark, sf).select("id", P.junk_label(F.col("label")).alias("junk"))


@query("p24_screening_prompt", f"WITH {_LABELS.cte} SELECT id, contains(coalesce(label, ''), '?') OR {phrase_sql(_NORM('label'), P.PROMPTS)} AS prompt FROM labels_")
def p24(spark, sf):
    return _LABELS.frame(spark, sf).select("id", P.screening_prompt(F.col("label")).alias("prompt"))


_TRANS = r"""trim(text) <> '' AND NOT regexp_matches(text, '@|(?i:https?:)|(?i:www\.)') AND NOT regexp_matches(trim(text), '^[0-9\s.,:/+()#-]+$') AND NOT regexp_matches(trim(text), '^[A-Z0-9][A-Z0-9\s.,''’&/-]*$')
 AND NOT (len(regexp_split_to_array(trim(text), '\s+')) <= 4 AND len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: NOT regexp_matches(w, '^[A-Z][a-z0-9’''.-]*$'))) = 0)"""


@query("p22_translatable", f"SELECT doc_id, {_TRANS} AS translatable FROM documents")
def p22(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.translatable(F.col("text")).alias("translatable"))


@query("p23_bad_text_layer", r"""WITH t AS (SELECT doc_id, trim(text) AS t, regexp_replace(text, '\s', '', 'g') AS s, list_filter(regexp_split_to_array(lower(trim(text)), '[^a-zà-ɏ]+'), lambda w: length(w) >= 2) AS w FROM documents)
SELECT doc_id, length(regexp_replace(t, '\P{L}', '', 'g')) < 8 OR length(regexp_replace(s, '[\p{L}\p{N}]', '', 'g')) / greatest(length(s), 1) > 0.18 OR len(list_filter(w, lambda x: regexp_matches(x, '[aeiou]'))) / greatest(len(w), 1) < 0.45 AS bad FROM t""")
def p23(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.bad_text_layer(F.col("text")).alias("bad"))


_FLAGS = Rows("flags", "id bigint,ts bigint,now bigint", [(1, None, 100), (2, 100, 220), (3, 100, 221), (4, 300, 220), (5, 220, 220)]).over(id="c_custkey * 100 + id", ts="ts + c_custkey % 3")


@query("p25_fresh_session", f"WITH {_FLAGS.cte} SELECT id, coalesce(now >= ts AND now - ts <= 120, false) AS fresh FROM flags")
def p25(spark, sf):
    return _FLAGS.frame(spark, sf).select("id", P.fresh(F.col("ts"), F.col("now"), F.lit(120)).alias("fresh"))


_LICENSES = Rows("licenses", "id bigint,expires_at bigint,now bigint,features string", [(1, 0, 5, "fill,sign"), (2, 5, 5, "fill"), (3, 4, 5, "sign"), (4, 9, 5, "")]).over(id="c_custkey * 100 + id", expires_at="CASE WHEN expires_at = 0 THEN 0 ELSE expires_at + c_custkey % 3 END")


@query("p26_license_current", f"WITH {_LICENSES.cte} SELECT id, expires_at = 0 OR now <= expires_at AS is_current, (expires_at = 0 OR now <= expires_at) AND list_contains(string_split(features, ','), 'sign') AS may_sign FROM licenses")
def p26(spark, sf):
    now = P.license_current(F.col("expires_at"), F.col("now"))
    return _LICENSES.frame(spark, sf).select("id", now.alias("is_current"), (now & F.array_contains(F.split("features", ","), "sign")).alias("may_sign"))


@query("p27_confidence_filter", "SELECT count(*) FILTER (WHERE l_quantity >= 40) AS detected, count(*) FILTER (WHERE l_quantity >= 45) AS segmented FROM lineitem")
def p27(spark, sf):
    """Recognised words under 40 (detection) and under 45 (segments) are dropped; quantity stands for confidence."""
    return table(spark, sf, "lineitem").agg(F.count_if(F.col("l_quantity") >= 40).alias("detected"), F.count_if(F.col("l_quantity") >= 45).alias("segmented"))


@query("p28_starter_values", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END, ''), n_name) AS value FROM customer JOIN nation ON n_nationkey = c_nationkey")
def p28(spark, sf):
    """A blank value is filled from a dimension; a stored one stays."""
    held = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("")
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.select("c_custkey", F.coalesce(F.nullif(held, F.lit("")), "n_name").alias("value"))
