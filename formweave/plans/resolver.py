"""The form resolver over whole tables: orders are forms of customers, their lines are fields."""

from pyspark.sql import functions as F

from formweave.functions import predicates as P
from formweave.operators import resolver as R
from formweave.plans.fixtures import Rows, part_sql, phrase_sql, table
from formweave.plans.matching import _KEY
from formweave.plans.predicates import _NORM
from formweave.plans.registry import query

#: Phrases of concepts, in order of precedence.
CONCEPTS = (
    ("given", ("given name", "given", "first name", "first", "forename", "fname", "christian name")),
    ("middle", ("middle name", "middle", "mname", "middle names", "middle initial", "mi", "m i")),
    ("family", ("family name", "last name", "last", "surname", "lname", "family")),
    ("street1", ("address line 1", "address 1", "address1", "street address", "house number")),
    ("street2", ("address line 2", "address 2", "address2", "apartment", "apt", "suite", "unit")),
    ("city", ("city", "town", "city town", "village")),
    ("state", ("state", "province", "region", "state province")),
    ("zip", ("zip", "zip code", "postal code", "pincode", "pin code", "postcode", "post code")),
    ("country", ("country", "nation")),
    ("nationality", ("nationality", "citizenship")),
    ("email", ("email", "e mail", "mail", "email address")),
    ("fax", ("fax", "fax number", "fax no", "facsimile")),
    ("phone_ext", ("phone extension", "telephone extension", "phone ext", "extension", "ext", "ext no")),
    ("cellphone", ("cell phone", "cell", "mobile", "mobile number", "mobile phone", "cell number", "cellphone")),
    ("homephone", ("home phone", "landline", "home number", "residence phone", "home telephone")),
    ("phone", ("phone", "telephone", "tel", "contact number", "phone number", "phone no", "contact no")),
    ("occupation", ("occupation", "profession", "current profession", "job title", "designation")),
    ("dob", ("date of birth", "dob", "d o b", "birth date", "birthday", "born", "birthdate")),
    ("appdate", ("date of application", "application date", "date of submission", "date signed", "dated")),
    ("passport", ("passport", "passport no", "passport number")),
    ("organization", ("company", "company name", "organization", "organisation", "employer", "business name")),
    ("age", ("age", "your age", "current age", "age in years", "age yrs")),
    ("givenmiddle", ("given and middle names", "given and middle name", "first and middle name", "first and middle names")),
    ("full", ("full name", "name", "complete name", "legal name", "applicant name", "your name")),
    ("address", ("address", "mailing address", "residential address", "postal address", "full address", "current address")),
)
PHRASES = Rows("phrases", "ord bigint,concept string,phrase string", [(i, c, p) for i, (c, p) in enumerate((c, p) for c, ps in CONCEPTS for p in ps)])
KINDS = Rows("kinds", "ord bigint,concept string,phrase string", [(1, "degree", "degree"), (2, "degree", "qualification"), (3, "school", "university"), (4, "school", "college"), (5, "year", "graduation year"), (6, "year", "year of passing")])
_CAPTIONS = (
    "Full Name", "First name", "Middle Initial", "Surname", "Preferred first name", "Maiden name", "Name in Chinese characters",
    "Address", "Mailing address", "Office Address", "Address line 2", "City / Town", "State", "ZIP code", "Country", "Nationality",
    "E-mail", "Phone", "Mobile phone", "Fax no", "Phone extension", "Date of Birth", "Age (years)", "Date of application",
    "Passport No.", "For office use only", "HKIDCheckingDigit", "Please provide a link to your LinkedIn profile?", "Comments",
    "Employee ID", "Company name", "Given and middle names", "Master degree", "University", "Graduation year", "Text 17", "",
)
_NAMES = ("date_of_birth", "txtField", "full_name", "employeeId", "cell", None)
_TODAY = "2024-06-30"
#: Stored keys of a customer (c), each held by those whose number leaves no rest by the divisor; DuckDB and Spark read them alike.
_HELD = (
    (1, "full name", "'Ann ' || c_mktsegment || ' No' || c_custkey", 2),
    (2, "First name", "'Ann'", 3),
    (3, "middle_name", "'bea'", 4),
    (4, "surname", "'No' || c_custkey", 3),
    (5, "preferredName", "'Annie'", 5),
    (6, "name in chinese", "'安'", 7),
    (7, "address line 1", "c_custkey || ' High St'", 1),
    (8, "address_2", "'Apt ' || c_nationkey", 4),
    (9, "city", "'Town ' || c_nationkey", 1),
    (10, "zip", "'' || (10000 + c_custkey % 90000)", 2),
    (11, "country", "'Country ' || c_nationkey", 1),
    (12, "mailing address", "'PO Box ' || c_custkey", 3),
    (13, "mobile", "'555-' || c_custkey", 3),
    (14, "phone", "'556-' || c_custkey", 2),
    (15, "dob", "lpad('' || (1 + c_custkey % 12), 2, '0') || '/' || lpad('' || (1 + c_custkey % 28), 2, '0') || '/' || (1950 + c_custkey % 60)", 2),
    (16, "linkedin_profile", "'in/' || c_custkey", 2),
    (17, "employee_id", "'E' || c_custkey", 3),
    (18, "email", "''", 1),
    (19, "Fax", "'557'", 6),
)


def _array(values, quote) -> str:
    return ", ".join("NULL" if v is None else quote(v) for v in values)


def fields(spark, sf):
    quoted = lambda v: "'" + v.replace("'", "\\'") + "'"
    lines = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS form",
        "l_linenumber * 100000 + l_partkey AS pos",
        f"element_at(array({_array(_CAPTIONS, quoted)}), cast(1 + (l_partkey * 7 + l_suppkey) % {len(_CAPTIONS)} AS int)) AS label",
        f"element_at(array({_array(_NAMES, quoted)}), cast(1 + l_suppkey % {len(_NAMES)} AS int)) AS name",
        "cast(l_partkey % 4 AS int) AS max_length",
    )
    return table(spark, sf, "orders").selectExpr("o_custkey AS owner", "o_orderkey AS form").join(lines, "form")


def vault(spark, sf):
    c = table(spark, sf, "customer")
    each = F.explode(F.array(*(F.struct(F.lit(o).cast("long").alias("ord"), F.lit(k).alias("key"), F.when(F.col("c_custkey") % d == 0, F.expr(v)).alias("value")) for o, k, v, d in _HELD)))
    return c.select(F.col("c_custkey").alias("owner"), each.alias("x")).select("owner", "x.*").where("value IS NOT NULL")


def education(spark, sf):
    """Every third customer's qualifications."""
    c = table(spark, sf, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey AS owner", "explode(array('master', 'bachelor')) AS level")
    c = c.where("level = 'bachelor' OR owner % 2 = 0").withColumn("rank", F.when(F.col("level") == "master", 4).otherwise(3))
    kinds = F.explode(F.map_from_arrays(F.array(F.lit("degree"), F.lit("school")), F.array(F.upper("level"), F.concat(F.lit("College "), F.col("owner"))))).alias("kind", "value")
    return c.select("owner", "level", "rank", kinds)


_Q = lambda v: "'" + v.replace("'", "''") + "'"
_LIST = lambda values: "[" + _array(values, _Q) + "]"
_FIND = lambda values: f"list_filter(w, lambda x: list_contains({_LIST(values)}, x))[1]"
_FULL = "list_filter(string_split_regex(coalesce(a['full'], ''), '\\s+'), lambda x: x <> '')"
_GIVEN, _FAMILY = f"coalesce(a['given'], {_FULL}[1])", f"coalesce(a['family'], {_FULL}[-1])"
_SHORT = f"(({phrase_sql('said', ('initial', 'init'))} OR max_length = 1) AND concept IN ('given', 'middle', 'family', 'givenmiddle', 'full'))"
_CUT = lambda v: f"CASE WHEN {_SHORT} THEN nullif(upper(regexp_extract({v}, '\\p{{L}}')), '') ELSE {v} END"
_PART = lambda c, v: f"CASE WHEN NOT list_contains(claimed, '{c}') THEN nullif({v}, '') END"
_SCORED = lambda texts, rules: f"""SELECT text, arg_min(concept, (-score, ord)) AS concept FROM (
    SELECT text, ord, concept, hits * hits / n * CASE WHEN hits = n THEN 1.6::DOUBLE ELSE 1 END AS score FROM (
        SELECT text, ord, concept, len(list_filter(string_split(phrase, ' '), lambda x: list_contains(string_split(text, ' '), x)))::DOUBLE AS hits, len(string_split(phrase, ' ')) AS n
        FROM {texts} CROSS JOIN {rules} WHERE text <> '') WHERE hits > 0) WHERE score >= 1.5 GROUP BY text"""  # noqa: E731
_RAW = f"""SELECT o_custkey AS owner, o_orderkey AS form, l_linenumber * 100000 + l_partkey AS pos, ({_LIST(_CAPTIONS)})[1 + (l_partkey * 7 + l_suppkey) % {len(_CAPTIONS)}] AS label,
    ({_LIST(_NAMES)})[1 + l_suppkey % {len(_NAMES)}] AS name, l_partkey % 4 AS max_length FROM orders JOIN lineitem ON l_orderkey = o_orderkey"""


def resolver_sql(raw: str) -> str:
    """SQL of the resolver for the fields that `raw` selects: owner, form, pos, label, name, max_length; without WITH."""
    return f"""
{PHRASES.cte}, {KINDS.cte},
vault AS (SELECT c_custkey AS owner, ord, key, value FROM ({' UNION ALL '.join(f"SELECT c_custkey, {o} AS ord, {_Q(k)} AS key, {v} AS value FROM customer WHERE c_custkey % {d} = 0" for o, k, v, d in _HELD)})),
keys AS (SELECT owner, {_NORM('key')} AS key, min(ord) AS ord, arg_max(value, ord) AS value FROM vault GROUP BY ALL),
own AS (SELECT owner, {_KEY('key')} AS own_key, arg_min(value, ord) AS own FROM vault GROUP BY ALL HAVING own <> ''),
words AS (SELECT owner, ord, value, string_split(key, ' ') AS w, unnest(list_distinct(string_split(key, ' '))) AS q FROM keys),
qualified AS (SELECT owner, route, q, arg_min(value, ord) AS held FROM (
    SELECT owner, 'alternate' AS route, q, ord, value FROM words WHERE list_contains({_LIST(R.ALTERNATE)}, q) AND (list_contains(w, 'name') OR list_contains({_LIST(R.ALTERNATE_ALONE)}, q))
    UNION ALL SELECT owner, 'qualified', q, ord, value FROM words WHERE list_contains({_LIST(R.ADDRESSES)}, q) AND list_contains(w, 'address')
    UNION ALL SELECT owner, 'script', q, ord, value FROM words WHERE list_contains({_LIST(R.SCRIPTS)}, q) AND list_contains(w, 'name')
    UNION ALL SELECT owner, 'second_line', '', list_position({_LIST(R.SECOND_LINE_KEYS)}, key), value FROM keys WHERE list_contains({_LIST(R.SECOND_LINE_KEYS)}, key) AND value <> '') GROUP BY ALL),
atoms AS (SELECT owner, map_from_entries(list((concept, value))) AS a FROM (SELECT owner, concept, arg_min(value, ord) AS value FROM keys JOIN (SELECT DISTINCT concept, phrase FROM phrases) ON key = phrase GROUP BY ALL) WHERE value <> '' GROUP BY owner),
raw AS ({raw}),
said AS (SELECT *, {_NORM('label')} AS said, {_NORM('name')} AS named, string_split({_NORM('label')}, ' ') AS w FROM raw),
forms AS (SELECT *, bool_or(list_contains(w, 'address') AND {_FIND(R.ADDRESSES)} IS NULL) OVER (PARTITION BY owner, form) AS asks_plain FROM said),
routed AS (SELECT *, CASE
    WHEN {part_sql('said', P.CHECK_DIGITS)} OR {part_sql('named', P.CHECK_DIGITS)} OR {phrase_sql('said', P.OFFICE_USE)} OR {phrase_sql('named', P.OFFICE_USE)} THEN 'office'
    WHEN list_has_any(w, {_LIST(R.ALTERNATE_NOUNS)}) AND {_FIND(R.ALTERNATE)} IS NOT NULL THEN 'alternate'
    WHEN {phrase_sql('said', R.SECOND_LINE)} AND NOT ({phrase_sql('said', R.NOT_SECOND_LINE)}) THEN 'second_line'
    WHEN contains(coalesce(label, ''), '?') OR {phrase_sql('said', P.PROMPTS)} THEN 'prompt'
    WHEN list_contains(w, 'address') AND asks_plain AND {_FIND(R.ADDRESSES)} IS NOT NULL THEN 'qualified'
    WHEN list_contains(w, 'name') AND {_FIND(R.SCRIPTS)} IS NOT NULL THEN 'script' END AS route FROM forms),
asked AS (SELECT *, CASE route WHEN 'alternate' THEN {_FIND(R.ALTERNATE)} WHEN 'qualified' THEN {_FIND(R.ADDRESSES)} WHEN 'script' THEN {_FIND(R.SCRIPTS)} WHEN 'second_line' THEN '' END AS q FROM routed),
texts AS (SELECT DISTINCT said AS text FROM asked WHERE route IS NULL UNION SELECT DISTINCT named FROM asked WHERE route IS NULL),
found AS ({_SCORED('texts', 'phrases')}), parts AS ({_SCORED('texts', 'kinds')}),
picked AS (SELECT asked.*, CASE WHEN route IS NULL THEN coalesce(l.concept, n.concept) END AS concept, CASE WHEN route IS NULL THEN k.concept END AS kind
    FROM asked LEFT JOIN found l ON said = l.text LEFT JOIN found n ON named = n.text LEFT JOIN parts k ON said = k.text),
claims AS (SELECT owner, form, list(DISTINCT concept) AS claimed FROM picked WHERE concept IS NOT NULL AND concept NOT IN ('full', 'givenmiddle', 'address') GROUP BY ALL),
candidates AS (SELECT owner, ord, value, list_filter(string_split(key, ' '), lambda x: length(x) > 2) AS p FROM keys),
answers AS (SELECT owner, said, arg_max(value, (len(p), -ord)) AS answer FROM (SELECT DISTINCT owner, said, w FROM picked WHERE route = 'prompt') JOIN candidates USING (owner)
    WHERE len(p) > 0 AND (len(p) >= 2 OR len(list_filter(p, lambda x: length(x) >= 6)) > 0) AND len(list_filter(p, lambda x: NOT (list_contains(w, x) OR contains(replace(said, ' ', ''), x)))) = 0 GROUP BY ALL),
ways AS (SELECT p.owner, p.form, pos, p.route, p.said, p.named, max_length, concept, kind, coalesce(claimed, []) AS claimed, held, answer, coalesce(ol.own, ow.own) AS mine, coalesce(a, MAP {{}}) AS a,
        p.owner % 3 = 0 AND kind IS NOT NULL AS taught,
        CASE WHEN p.owner % 2 = 0 AND NOT ({phrase_sql("(p.said || ' ' || p.named)", R.Rules().levels[2][1])} AND NOT ({phrase_sql("(p.said || ' ' || p.named)", R.Rules().levels[1][1])})) THEN 'master' ELSE 'bachelor' END AS level
    FROM picked p LEFT JOIN claims c ON c.owner = p.owner AND c.form = p.form LEFT JOIN qualified u ON u.owner = p.owner AND u.route = p.route AND u.q = p.q
    LEFT JOIN answers s ON s.owner = p.owner AND s.said = p.said AND p.route = 'prompt'
    LEFT JOIN own ol ON ol.owner = p.owner AND ol.own_key = {_KEY("coalesce(label, '')")} AND ol.own_key <> '' AND (p.route IS NULL OR p.route = 'script')
    LEFT JOIN own ow ON ow.owner = p.owner AND ow.own_key = {_KEY("coalesce(name, '')")} AND ow.own_key <> '' AND (p.route IS NULL OR p.route = 'script')
    LEFT JOIN atoms t ON t.owner = p.owner),
values_ AS (SELECT *, CASE concept
    WHEN 'full' THEN coalesce(a['full'], nullif(array_to_string(list_filter([{_PART('given', _GIVEN)}, {_PART('middle', "a['middle']")}, {_PART('family', _FAMILY)}], lambda x: x IS NOT NULL), ' '), ''))
    WHEN 'givenmiddle' THEN coalesce(nullif(array_to_string(list_filter([{_PART('given', _GIVEN)}, {_PART('middle', "a['middle']")}], lambda x: x IS NOT NULL), ' '), ''), a['given'])
    WHEN 'address' THEN nullif(array_to_string(list_filter([{', '.join(_PART(c, f"a['{c}']") for c in ('street1', 'street2', 'city', 'state', 'zip', 'country'))}], lambda x: x IS NOT NULL), ', '), '')
    WHEN 'given' THEN {_GIVEN} WHEN 'family' THEN {_FAMILY} WHEN 'nationality' THEN coalesce(a['nationality'], a['country']) WHEN 'phone' THEN coalesce(a['cellphone'], a['phone'], a['homephone'])
    WHEN 'age' THEN coalesce(a['age'], CAST(date_sub('year', strptime(a['dob'], '%m/%d/%Y')::DATE, DATE '{_TODAY}') AS VARCHAR)) WHEN 'appdate' THEN coalesce(a['appdate'], strftime(DATE '{_TODAY}', '%m/%d/%Y'))
    ELSE a[concept] END AS v FROM ways)
SELECT owner, form, pos, CASE WHEN route = 'prompt' THEN nullif(answer, '') WHEN route = 'script' THEN coalesce(nullif(held, ''), mine) WHEN route IS NOT NULL THEN nullif(held, '')
    WHEN mine IS NOT NULL THEN {_CUT('mine')} WHEN taught THEN CASE kind WHEN 'degree' THEN upper(level) WHEN 'school' THEN 'College ' || owner END ELSE {_CUT("nullif(v, '')")} END AS value,
    coalesce(route, CASE WHEN mine IS NOT NULL THEN 'own' WHEN taught THEN 'education' WHEN concept IN ('full', 'givenmiddle', 'address') THEN 'composite' WHEN concept IS NOT NULL THEN 'atom' ELSE 'none' END) AS source
FROM values_
"""


@query("e2_resolve_forms", "WITH " + resolver_sql(_RAW))
def resolve_forms(spark, sf):
    """Every line of every order as a field, resolved from its customer's stored values in the dealt order of ways."""
    return R.resolve_forms(fields(spark, sf), vault(spark, sf), PHRASES.frame(spark, sf), F.lit(_TODAY).cast("date"), education=education(spark, sf), kinds=KINDS.frame(spark, sf))
