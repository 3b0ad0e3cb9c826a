"""Scored joins: concepts, own keys, qualifiers, prompts, options, intents."""

from pyspark.sql import functions as F

from formweave.functions import predicates as P
from formweave.functions import text as X
from formweave.operators import matching as M
from formweave.plans.fixtures import Rows, part_sql, phrase_sql, table
from formweave.plans.predicates import _NORM
from formweave.plans.registry import query
from formweave.plans.scalars import _ASKED, _OPTIONS, _PHRASES

_SCORES = f"s AS (SELECT id, ord, concept, len(list_filter(string_split(phrase, ' '), lambda w: list_contains(string_split({_NORM('label')}, ' '), w))) AS h, len(string_split(phrase, ' ')) AS n FROM asked CROSS JOIN phrases), x AS (SELECT id, ord, concept, max(h * h / n * CASE WHEN h = n THEN 1.6 ELSE 1.0 END) AS score FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS k FROM x)"


@query("j7_label_resolve", f"WITH {_PHRASES.cte}, {_ASKED.cte}, {_SCORES} SELECT id, concept, round(score, 6)::DOUBLE AS score FROM r WHERE k = 1 AND score >= 1.5")
def j7(spark, sf):
    return M.best_concept(_ASKED.frame(spark, sf), _PHRASES.frame(spark, sf)).select("id", "concept", F.round("score", 6).cast("double").alias("score"))


@query("j7_part_names", """WITH a AS (SELECT p_partkey AS id, string_split(lower(p_name), ' ') AS w FROM part), c AS (SELECT DISTINCT p_brand, lower(p_brand) AS b FROM part), x AS (SELECT p_partkey AS id, row_number() OVER (PARTITION BY p_partkey ORDER BY length(t) DESC, t) AS k, t FROM part, unnest(string_split(lower(p_name), ' ')) u(t)) SELECT id, t AS concept FROM x WHERE k = 1""")
def j7_parts(spark, sf):
    """Top-1 with an ordinal tie-break at table scale: the longest word of each part's name."""
    words = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(F.split(F.lower("p_name"), " ")).alias("t"))
    return words.groupBy("id").agg(F.min_by("t", F.struct(-F.length("t"), F.col("t"))).alias("concept"))


_VAULT = Rows("vault", "ord bigint,key string,value string", [(1, "पूरा_नाम", "आशा"), (2, "full", "Asha Rao"), (3, "given", "Asha"), (4, "permanent_address", "1 Old Rd"), (5, "mailing_address", "PO 7"), (6, "linkedin_profile", "in/asha"), (7, "birth", "01/02/1990"), (8, "phone", " "), (9, "first name", "Own"), (10, "work authorization status", "citizen"), (11, "notice period", "30 days")])
_LABELS = Rows("asked", "id bigint,label string", [(1, "पूरा नाम"), (2, "Name"), (3, "First name"), (4, "Mailing address"), (5, "Office address"), (6, "Please provide an active link to your LinkedIn profile?"), (7, "Date of birth"), (8, "Phone"), (9, "For office use only name"), (10, "What is your work authorization status?"), (11, "How long is your notice period?")]).over(id="c_custkey * 100 + id", label="CASE WHEN c_custkey % 4 = 1 THEN c_mktsegment || ' ' || label ELSE label END")
_KEY = lambda c: f"regexp_replace(regexp_replace(lower(regexp_replace({c}, '\\([^)]*\\)', ' ', 'g')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '_', 'g'), '^_+|_+$', '', 'g')"
_OWN = f"o AS (SELECT id, arg_min(value, ord) AS value FROM asked JOIN vault ON {_KEY('label')} = {_KEY('key')} WHERE trim(value) <> '' GROUP BY id)"


@query("j8_own_key", f"WITH {_VAULT.cte}, {_LABELS.cte}, {_OWN} SELECT id, value FROM o")
def j8(spark, sf):
    return M.own_values(_LABELS.frame(spark, sf), _VAULT.frame(spark, sf))


@query("resolve_labels", f"WITH {_VAULT.cte}, {_LABELS.cte}, {_PHRASES.cte}, {_OWN}, {_SCORES}, c AS (SELECT r.id, vault.value FROM r JOIN vault ON key = concept JOIN asked USING (id) WHERE k = 1 AND score >= 1.5 AND trim(value) <> '' AND NOT ({part_sql(_NORM('label'), P.CHECK_DIGITS)} OR {phrase_sql(_NORM('label'), P.OFFICE_USE)}) AND NOT (contains(label, '?') OR {phrase_sql(_NORM('label'), P.PROMPTS)})) SELECT asked.id, coalesce(o.value, c.value) AS value, CASE WHEN o.value IS NOT NULL THEN 'own' WHEN c.value IS NOT NULL THEN 'concept' END AS source FROM asked LEFT JOIN o USING (id) LEFT JOIN c ON c.id = asked.id")
def resolve_labels(spark, sf):
    """The chain of precedence for a form: blocked boxes stay empty, an own key beats a concept."""
    blocked = P.office_use(F.col("label"), F.lit(None).cast("string")) | P.screening_prompt(F.col("label"))
    return M.resolve(_LABELS.frame(spark, sf), _PHRASES.frame(spark, sf), _VAULT.frame(spark, sf), blocked)


_QUAL = Rows("q", "id bigint,qualifier string", [(1, "mailing"), (2, "permanent"), (3, "office")]).over(id="c_custkey * 100 + id", qualifier="CASE WHEN c_custkey % 4 = 1 THEN 'permanent' ELSE qualifier END")


@query("j9_qualified_keys", f"WITH {_VAULT.cte}, {_QUAL.cte}, k AS (SELECT ord, value, string_split({_NORM('key')}, ' ') AS w FROM vault) SELECT id, arg_min(value, ord) AS value FROM q JOIN k ON list_contains(w, qualifier) AND list_contains(w, 'address') GROUP BY id")
def j9(spark, sf):
    return M.qualified_values(_QUAL.frame(spark, sf), _VAULT.frame(spark, sf), "address")


@query("j10_prompt_keys", f"WITH {_VAULT.cte}, {_LABELS.cte}, k AS (SELECT ord, value, list_filter(string_split({_NORM('key')}, ' '), lambda w: length(w) > 2) AS w FROM vault), m AS (SELECT id, value, row_number() OVER (PARTITION BY id ORDER BY len(w) DESC, ord) AS r FROM asked JOIN k ON (len(w) >= 2 OR len(list_filter(w, lambda x: length(x) >= 6)) > 0) AND len(list_filter(w, lambda x: NOT list_contains(string_split({_NORM('label')}, ' '), x))) = 0) SELECT id, value FROM m WHERE r = 1")
def j10(spark, sf):
    return M.prompt_values(_LABELS.frame(spark, sf), _VAULT.frame(spark, sf))


_STOP = ["what", "is", "your", "how", "long", "please", "the", "of", "to", "an", ""]


@query("j11_fuzzy_question", f"WITH {_VAULT.cte}, {_LABELS.cte}, w AS (SELECT id, list_filter(list_distinct(string_split({_NORM('label')}, ' ')), lambda x: NOT list_contains({_STOP}, x)) AS q FROM asked), k AS (SELECT ord, value, list_filter(list_distinct(string_split({_NORM('key')}, ' ')), lambda x: NOT list_contains({_STOP}, x)) AS k FROM vault), m AS (SELECT id, value, ord, len(list_intersect(q, k)) AS h, len(k) AS n FROM w CROSS JOIN k), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY h DESC, ord) AS p FROM m WHERE h > 0 AND n - h <= floor(n * 0.34)) SELECT id, value FROM r WHERE p = 1")
def j11(spark, sf):
    return M.answers(_LABELS.frame(spark, sf), _VAULT.frame(spark, sf), _STOP)


_CHOICES = Rows("choices", "q bigint,pos bigint,option string,value string", [(1, 1, "Master of Science", "Master Science"), (1, 2, "Master of Arts", "Master Science"), (2, 1, "Yes, citizen", "citizen"), (2, 2, "No citizen", "citizen"), (3, 1, "Green card", "green"), (3, 2, "Other", "green"), (4, 1, "a b", "c d e")]).over(q="c_custkey * 100 + q", option="CASE WHEN c_custkey % 4 = 1 THEN option || ' ' || c_mktsegment ELSE option END")


@query("j12_unique_best", f"WITH {_CHOICES.cte}, s AS (SELECT q, pos, len(list_intersect(string_split({_NORM('option')}, ' '), string_split({_NORM('value')}, ' '))) AS h, len(string_split({_NORM('value')}, ' ')) AS n FROM choices), t AS (SELECT *, max(h) OVER (PARTITION BY q) AS top FROM s), u AS (SELECT *, count(*) FILTER (WHERE h = top) OVER (PARTITION BY q) AS ties FROM t) SELECT q, pos FROM u WHERE h = top AND ties = 1 AND (h >= 2 OR (h > 0 AND n <= 2 AND h = n))")
def j12(spark, sf):
    return M.unique_best(_CHOICES.frame(spark, sf))


@query("j13_acronym_option", "SELECT r_regionkey, string_agg(substr(w, 1, 1), '' ORDER BY i) AS short FROM (SELECT r_regionkey, unnest(string_split(r_name, ' ')) AS w, generate_subscripts(string_split(r_name, ' '), 1) AS i FROM region) GROUP BY 1")
def j13(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", M.acronym(F.col("r_name")).alias("short"))


_COUNTRY = Rows("countries", "name string,code string,dial string", [("India", "IN", "+91"), ("Indonesia", "ID", "+62"), ("United States", "US", "+1"), ("Canada", "CA", "+1")])
_WANT = Rows("want", "id bigint,value string,own string", [(1, "india", "IN"), (2, "Indo", "IN"), (3, "US", "US"), (4, "+1", "CA"), (5, "+62", "IN")]).over(id="c_custkey * 100 + id", value="CASE WHEN c_custkey % 7 = 1 THEN 'canada' ELSE value END")


@query("j15_country_option", f"WITH {_COUNTRY.cte}, {_WANT.cte}, m AS (SELECT id, code, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN own = code THEN 0 ELSE 1 END, code) AS k FROM want JOIN countries ON lower(value) IN (lower(name), lower(code), dial)) SELECT id, code FROM m WHERE k = 1")
def j15(spark, sf):
    """Exact only: a prefix would pick a wrong country; of equal dial codes the own country's comes first."""
    c = _COUNTRY.frame(spark, sf).select("code", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("code"), F.col("dial")))).alias("k"))
    met = _WANT.frame(spark, sf).withColumn("k", F.lower("value")).join(F.broadcast(c), "k")
    return met.groupBy("id").agg(F.min_by("code", F.struct(F.when(F.col("own") == F.col("code"), 0).otherwise(1), F.col("code"))).alias("code"))


@query("f23_canonical_country", f"WITH {_COUNTRY.cte}, {_WANT.cte} SELECT id, coalesce(code, value) AS country FROM want LEFT JOIN countries ON lower(value) IN (lower(name), lower(code))")
def f23(spark, sf):
    c = _COUNTRY.frame(spark, sf).select("code", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("code")))).alias("k"))
    return _WANT.frame(spark, sf).withColumn("k", F.lower("value")).join(F.broadcast(c), "k", "left").select("id", F.coalesce("code", "value").alias("country"))


@query("f24_dial_code", f"WITH {_COUNTRY.cte}, {_WANT.cte} SELECT id, coalesce(CASE WHEN regexp_matches(value, '^\\+\\d{{1,3}}') THEN regexp_extract(value, '^\\+\\d{{1,3}}') END, dial) AS dial FROM want LEFT JOIN countries ON own = code")
def f24(spark, sf):
    """A stored international prefix, else the country's."""
    held = F.nullif(F.regexp_extract("value", r"^\+[0-9]{1,3}", 0), F.lit(""))
    return _WANT.frame(spark, sf).join(F.broadcast(_COUNTRY.frame(spark, sf)), F.col("own") == F.col("code"), "left").select("id", F.coalesce(held, "dial").alias("dial"))


_NATIONS_SQL = "n AS (SELECT n_name || ' of ' || r_name AS name, 'N' || n_nationkey AS code, '+' || (n_nationkey + 30) AS dial FROM nation JOIN region ON r_regionkey = n_regionkey)"


def nations(spark, sf):
    """Nations with a short code and a dial code made from their keys."""
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.concat_ws(" of ", "n_name", "r_name").alias("name"), F.concat(F.lit("N"), "n_nationkey").alias("code"), F.concat(F.lit("+"), F.col("n_nationkey") + 30).alias("dial"))


@query("f21_candidates", f"WITH {_NATIONS_SQL} SELECT name, unnest([name, code, dial]) AS candidate FROM n")
def f21(spark, sf):
    return nations(spark, sf).select("name", F.explode(F.array("name", "code", "dial")).alias("candidate"))


@query("f22_abbreviate", f"WITH {_NATIONS_SQL}, l(n) AS (VALUES (2), (3), (7), (20)), m AS (SELECT name, l.n, c, row_number() OVER (PARTITION BY name, l.n ORDER BY length(c) DESC, c) AS k FROM n CROSS JOIN l, unnest([name, code, dial]) u(c) WHERE length(c) <= l.n) SELECT name, n, c AS fits FROM m WHERE k = 1")
def f22(spark, sf):
    """The longest form that fits a box."""
    forms = nations(spark, sf).select("name", F.explode(F.array("name", "code", "dial")).alias("c"))
    fitting = forms.select("name", "c", F.explode(F.array(*map(F.lit, (2, 3, 7, 20)))).alias("n")).where(F.length("c") <= F.col("n"))
    return fitting.groupBy("name", "n").agg(F.min_by("c", F.struct(-F.length("c"), F.col("c"))).alias("fits"))


@query("f20_choice_decision", f"WITH {_OPTIONS.cte}, w AS (SELECT q, pos, regexp_replace(lower(option), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(value), '[^a-z0-9]', '', 'g') AS b FROM options) SELECT q, bool_or(a <> '' AND (a = b OR (length(a) >= 3 AND starts_with(b, a)))) AS chosen FROM w GROUP BY q")
def f20(spark, sf):
    a, b = X.option_key(F.col("option")), X.option_key(F.col("value"))
    hit = (a != "") & ((a == b) | ((F.length(a) >= 3) & F.startswith(b, a)))
    return _OPTIONS.frame(spark, sf).groupBy("q").agg(F.bool_or(hit).alias("chosen"))


_INTENTS = Rows("intents", "ord bigint,intent string,pattern string", [(1, "notice", "notice period|how soon"), (2, "work_auth", "authori[sz]ation|right to work"), (3, "link", "linkedin|github"), (4, "birth", "birth")])


@query("j26_question_intent", f"WITH {_INTENTS.cte}, {_LABELS.cte} SELECT id, arg_min(intent, ord) AS intent FROM asked JOIN intents ON regexp_matches(lower(label), pattern) GROUP BY id")
def j26(spark, sf):
    return M.first_intent(_LABELS.frame(spark, sf), _INTENTS.frame(spark, sf))


_CITIZENS = Rows("citizens", "id bigint,status string", [(1, "US citizen"), (2, "Canadian citizen"), (3, "Permanent resident"), (4, "H-1B visa"), (5, "")]).over(id="c_custkey * 100 + id", status="CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment || ' ' || status ELSE status END")


@query("j27_eligibility", f"WITH {_CITIZENS.cte} SELECT id, CASE WHEN regexp_matches(status, '(?i)citizen|permanent resident') THEN 'yes' END AS eligible, CASE WHEN regexp_matches(status, '(?i)citizen|permanent resident') THEN 'no' WHEN regexp_matches(status, '(?i)visa') THEN 'yes' END AS sponsorship FROM citizens")
def j27(spark, sf):
    settled = F.col("status").rlike("(?i)citizen|permanent resident")
    return _CITIZENS.frame(spark, sf).select("id", F.when(settled, "yes").alias("eligible"), F.when(settled, "no").when(F.col("status").rlike("(?i)visa"), "yes").alias("sponsorship"))


@query("j28_value_in_caption", f"WITH {_CHOICES.cte} SELECT q, pos, len(list_filter(string_split({_NORM('value')}, ' '), lambda w: NOT list_contains(string_split({_NORM('option')}, ' '), w))) = 0 AS holds FROM choices")
def j28(spark, sf):
    words = lambda c: F.split(X.words_of_label(F.col(c)), " ")
    return _CHOICES.frame(spark, sf).select("q", "pos", (F.size(F.array_except(words("value"), words("option"))) == 0).alias("holds"))


@query("f25_keyword_key", "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'steel|copper') THEN 'metal' WHEN regexp_matches(lower(p_type), 'brass') THEN 'alloy' END AS key FROM part")
def f25(spark, sf):
    """The first keyword rule that is found names the key; parts' types stand for labels."""
    return table(spark, sf, "part").select("p_partkey", X.first_rule(F.lower("p_type"), (("metal", "steel|copper"), ("alloy", "brass"))).alias("key"))


@query("f26_identify_form", "WITH r(form, pattern, ord) AS (VALUES ('license', 'licen[sc]e', 1), ('mail', '@', 2), ('symbols', '[#$%]{3}', 3)) SELECT doc_id, arg_min(form, ord) AS form FROM documents JOIN r ON regexp_matches(lower(text), pattern) GROUP BY doc_id")
def f26(spark, sf):
    forms = (("license", "licen[sc]e"), ("mail", "@"), ("symbols", "[#$%]{3}"))
    return table(spark, sf, "documents").select("doc_id", X.first_rule(F.lower("text"), forms).alias("form")).where("form IS NOT NULL")


_SIDES = Rows("sides", "id bigint,t string", [(1, "P<UTOERIKSSON<<ANNA"), (2, "DRIVER LICENSE front"), (3, "ANSI 6360 DAQ123"), (4, "VISA debit 4111"), (5, "hello")]).over(id="c_custkey * 100 + id", t="CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment || ' ' || t ELSE t END")


@query("f27_document_side", f"WITH {_SIDES.cte} SELECT id, CASE WHEN regexp_matches(t, '^[PIA][A-Z<][A-Z]{{3}}') THEN 'passport' WHEN regexp_matches(t, '(?i)ansi |@\\n') THEN 'license_back' WHEN regexp_matches(t, '(?i)licen[sc]e') THEN 'license_front' WHEN regexp_matches(t, '(?i)visa|debit|credit') THEN 'card' ELSE 'document' END AS side FROM sides")
def f27(spark, sf):
    kinds = (("passport", "^[PIA][A-Z<][A-Z]{3}"), ("license_back", "(?i)ansi |@\\n"), ("license_front", "(?i)licen[sc]e"), ("card", "(?i)visa|debit|credit"))
    return _SIDES.frame(spark, sf).select("id", X.first_rule(F.col("t"), kinds, "document").alias("side"))
