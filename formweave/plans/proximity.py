"""The proximity plan over whole tables: a customer's order lines are the texts of a page, every third one a box as well."""

from pyspark.sql import functions as F

from formweave.functions import predicates as P
from formweave.operators import proximity as X
from formweave.plans.fixtures import phrase_sql, table
from formweave.plans.predicates import _CAP, _NORM
from formweave.plans.registry import query
from formweave.plans.resolver import _TODAY, PHRASES, resolver_sql, vault

_SAID = (
    "Given Name", "Family Name", "Full name", "Employer Name", "Other names used", "Spouse’s name", "Street Number and Name", "In Care Of Name",
    "Date of Birth (Day/Month/Year)", "City", "ZIP code", "Country", "Phone", "Age", "Page 2",
)
_QUOTED = ", ".join(f"'{s}'" for s in _SAID)
_TEXT = {"form": "o_custkey", "page": "1", "tx": "DBL(l_partkey * 3 % 6 * 80)", "ty": "DBL(l_suppkey * 5 % 90 * 4 + l_linenumber)", "tw": "DBL(40)", "th": "DBL(10)", "s": f"AT({_QUOTED})"}
_BOX = {
    "owner": "o_custkey", "form": "o_custkey", "page": "1", "x": "DBL(l_partkey % 6 * 80 + 60)", "y": "DBL(l_suppkey * 7 % 90 * 4)", "w": "DBL(60)", "h": "DBL(12)",
    "id": "CASE WHEN l_partkey % 9 = 0 THEN 'row' ELSE 'f_' || l_returnflag || '_' END || row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)",
    "tooltip": "CASE WHEN l_suppkey % 11 = 0 THEN 'Names you have used' END",
}


def _spark(e: str) -> str:
    return e.replace("DBL(", "double(").replace("AT(", "element_at(array(").replace(f"{_QUOTED})", f"{_QUOTED}), cast(1 + (l_partkey + l_suppkey) % {len(_SAID)} AS int))")


def _duck(e: str) -> str:
    return e.replace("DBL(", "to_double(").replace(f"AT({_QUOTED})", f"([{_QUOTED}])[1 + (l_partkey + l_suppkey) % {len(_SAID)}]")


def lines(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))


def texts(spark, sf):
    return lines(spark, sf).selectExpr(*(f"{_spark(e)} AS {n}" for n, e in _TEXT.items()))


def fields(spark, sf):
    rows = lines(spark, sf).where("l_partkey % 3 = 0")
    options = F.when(F.col("l_partkey") % 7 == 0, F.array(F.lit("Town 1"), F.concat(F.lit("country "), F.col("l_suppkey") % 25), F.lit("Ann"), F.lit("")))
    return rows.select(*(F.expr(_spark(e)).alias(n) for n, e in _BOX.items()), options.alias("options"))


_ENTITY = f"len(list_intersect(list_transform(string_split({_CAP('context')}, ' '), lambda w: regexp_replace(w, 's$', '')), [{', '.join(repr(e.removesuffix('s')) for e in P.ENTITIES)}])) > 0 OR contains({_CAP('context')}, 'next of kin')"
_SUBJECT = f"len(list_filter(regexp_extract_all(caption || ' . ' || coalesce(tooltip, '') || ' . ' || header, '\\b([A-Za-z]{{3,}})[''’]s', 1), lambda o: lower(o) NOT IN {P.SELF})) > 0"
_OPTION = f"CASE WHEN {_CAP('o')} = '' OR {_CAP('value')} = '' THEN 0 WHEN {_CAP('o')} = {_CAP('value')} THEN 3 WHEN starts_with({_CAP('o')}, {_CAP('value')}) OR starts_with({_CAP('value')}, {_CAP('o')}) THEN 2 WHEN contains({_CAP('o')}, {_CAP('value')}) OR contains({_CAP('value')}, {_CAP('o')}) THEN 1 ELSE 0 END"
_ASKED = "SELECT owner, form || '/' || id AS form, 0 AS pos, caption AS label, id AS name, NULL::INT AS max_length FROM sk WHERE NOT skip UNION ALL SELECT owner, '#' || label, 0, label, NULL, NULL FROM (SELECT DISTINCT owner FROM sk), (VALUES " + ", ".join(f"('{n}')" for n in (*X.NAMES, "street address")) + ") v(label)"
_SQL = f"""WITH lines AS (SELECT * FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
t AS (SELECT {', '.join(f'{_duck(e)} AS {n}' for n, e in _TEXT.items())} FROM lines),
b AS (SELECT {', '.join(f'{_duck(e)} AS {n}' for n, e in _BOX.items())}, CASE WHEN l_partkey % 7 = 0 THEN ['Town 1', 'country ' || (l_suppkey % 25), 'Ann', ''] END AS options FROM lines WHERE l_partkey % 3 = 0),
m AS (SELECT *, y + h / 2 AS cy, ty + th / 2 AS tcy FROM b JOIN t USING (form, page)),
l AS (SELECT form, id, arg_max(s, (tx, s)) AS s FROM m WHERE abs(tcy - cy) <= 7 AND tx <= x - 2 GROUP BY ALL),
o AS (SELECT form, id, arg_min(s, (ty, tx, s)) AS s FROM m WHERE ty > cy AND ty - (y + h) <= 26 AND tx < x + w AND tx + tw > x GROUP BY ALL),
hd AS (SELECT form, id, arg_min(s, (ty, tx, s)) AS s FROM m WHERE tx <= 80 AND ty > cy AND length(trim(s)) >= 3 GROUP BY ALL),
cap AS (SELECT b.*, coalesce(l.s, o.s, '') AS caption, coalesce(hd.s, '') AS header FROM b LEFT JOIN l ON l.form = b.form AND l.id = b.id LEFT JOIN o ON o.form = b.form AND o.id = b.id LEFT JOIN hd ON hd.form = b.form AND hd.id = b.id),
base AS (SELECT form, id, x, regexp_replace(id, '[0-9]+$', '') AS base FROM b),
rep AS (SELECT g.form, g.id, count(*) >= 2 AS repeats FROM base g JOIN base u ON g.form = u.form AND g.base = u.base AND abs(g.x - u.x) <= 12 GROUP BY ALL),
ctx AS (SELECT cap.*, caption || ' ' || header || ' ' || cap.id AS context, repeats FROM cap JOIN rep ON rep.form = cap.form AND rep.id = cap.id),
sk AS (SELECT *, {_ENTITY} OR {phrase_sql(_CAP('context'), P.OTHER_NAMES)} OR {phrase_sql(_CAP("coalesce(tooltip, '')"), P.OTHER_NAMES)} OR {_SUBJECT} OR repeats AS skip FROM ctx),
resolved AS (WITH {resolver_sql(_ASKED)}),
own AS (SELECT owner, list(DISTINCT {_NORM('value')}) FILTER (WHERE form <> '#street address' AND value IS NOT NULL) AS names, max(value) FILTER (WHERE form = '#street address') AS street FROM resolved WHERE form LIKE '#%' GROUP BY owner),
v AS (SELECT sk.*, r.value AS found, coalesce(list_contains(names, {_NORM('r.value')}), false) AS is_name, CASE WHEN NOT list_contains(coalesce(names, []), {_NORM('street')}) THEN street END AS street FROM sk LEFT JOIN resolved r ON r.form = sk.form || '/' || sk.id LEFT JOIN own ON own.owner = sk.owner),
w AS (SELECT *, is_name AND (regexp_matches(lower(caption), '\\b({X.ADDRESS})\\b') OR regexp_matches(lower(coalesce(tooltip, '')), '\\b({X.ADDRESS})\\b')) AS misplaced, CASE WHEN regexp_matches(lower(caption), '\\b({X.STREET_LINE})\\b') AND NOT regexp_matches(lower(caption), '\\b({X.COURTESY})\\b') THEN street END AS st FROM v),
dm AS (SELECT DISTINCT form, id FROM m WHERE regexp_matches(s, '(?is)day.*month.*year') AND abs(ty - y) < 22 AND abs(tx - x) < 260),
p AS (SELECT w.form, w.id, caption, skip OR (misplaced AND st IS NULL) AS skip, CASE WHEN misplaced THEN st ELSE found END AS value, options, dm.id IS NOT NULL AS dmy FROM w LEFT JOIN dm ON dm.form = w.form AND dm.id = w.id),
q AS (SELECT *, list_filter(list_transform(options, lambda o: {{'o': o, 'k': {_OPTION}}}), lambda z: z.k >= 2) AS fit FROM p),
z AS (SELECT *, list_filter(fit, lambda a: a.k = list_max(list_transform(fit, lambda c: c.k)))[1].o AS best FROM q)
SELECT form, id, caption, skip, CASE WHEN skip THEN NULL WHEN options IS NULL AND dmy AND regexp_matches(value, '^\\d{{1,2}}[/.-]\\d{{1,2}}[/.-]\\d{{2,4}}$') THEN split_part(value, '/', 2) || '/' || split_part(value, '/', 1) || '/' || split_part(value, '/', 3)
 WHEN options IS NULL OR best IS NOT NULL THEN value END AS value, CASE WHEN NOT skip AND value IS NOT NULL THEN best END AS option FROM z"""


@query("x19_proximity_plan", _SQL.replace("to_double(", "CAST(0.0 AS DOUBLE) + ("))
def x19(spark, sf):
    return X.plan(fields(spark, sf), texts(spark, sf), vault(spark, sf), PHRASES.frame(spark), F.lit(_TODAY).cast("date"))
