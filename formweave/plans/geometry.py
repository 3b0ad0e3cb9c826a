"""Geometry joins over literal pages and over orders read as pages of boxes and texts."""

from pyspark.sql import functions as F

from formweave.operators import geometry as G
from formweave.plans.fixtures import table
from formweave.plans.registry import query

# orders as pages: every line of an order is a text, every third one a box; coordinates come from the keys
_TEXTS_SQL = "t AS (SELECT l_orderkey AS form, 1 AS page, (l_partkey % 300)::DOUBLE AS tx, (l_suppkey * 7 % 700)::DOUBLE AS ty, 40.0::DOUBLE AS tw, 10.0::DOUBLE AS th, 't' || l_partkey || '-' || l_suppkey AS s FROM lineitem)"
_BOXES_SQL = "b AS (SELECT l_orderkey AS form, 1 AS page, 'b' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice) AS id, (l_partkey * 3 % 300)::DOUBLE AS x, (l_suppkey * 5 % 700)::DOUBLE AS y, 60.0::DOUBLE AS w, 12.0::DOUBLE AS h FROM lineitem WHERE l_partkey % 3 = 0)"
_M = f"WITH {_TEXTS_SQL}, {_BOXES_SQL}, m AS (SELECT *, y + h / 2 AS cy, ty + th / 2 AS tcy FROM b JOIN t USING (form, page))"


def texts(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_orderkey AS form", "1 AS page", "double(l_partkey % 300) AS tx", "double(l_suppkey * 7 % 700) AS ty", "40.0D AS tw", "10.0D AS th", "concat('t', l_partkey, '-', l_suppkey) AS s")


def boxes(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_partkey % 3 = 0")
    return rows.selectExpr("l_orderkey AS form", "1 AS page", "concat('b', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice)) AS id", "double(l_partkey * 3 % 300) AS x", "double(l_suppkey * 5 % 700) AS y", "60.0D AS w", "12.0D AS h")


@query("j17_captions", f"{_M}, l AS (SELECT form, id, s, row_number() OVER (PARTITION BY form, id ORDER BY tx DESC, s DESC) AS k FROM m WHERE abs(tcy - cy) <= 7 AND tx <= x - 2), a AS (SELECT form, id, s, row_number() OVER (PARTITION BY form, id ORDER BY ty, tx, s) AS k FROM m WHERE ty > cy AND ty - (y + h) <= 26 AND tx < x + w AND tx + tw > x) SELECT b.form, b.id, coalesce(l.s, a.s) AS caption FROM b LEFT JOIN l ON l.form = b.form AND l.id = b.id AND l.k = 1 LEFT JOIN a ON a.form = b.form AND a.id = b.id AND a.k = 1")
def j17(spark, sf):
    return G.captions(boxes(spark, sf), texts(spark, sf))


@query("j18_headers", f"{_M}, r AS (SELECT form, id, s, row_number() OVER (PARTITION BY form, id ORDER BY ty, tx, s) AS k FROM m WHERE tx <= 80 AND ty > cy) SELECT form, id, s AS header FROM r WHERE k = 1")
def j18(spark, sf):
    return G.headers(boxes(spark, sf), texts(spark, sf))


@query("j19_instructions", f"{_M} SELECT form, id, string_agg(s, ' ' ORDER BY ty DESC, tx, s) AS text FROM m WHERE ty >= y AND ty <= y + 540 GROUP BY form, id")
def j19(spark, sf):
    return G.instructions(boxes(spark, sf), texts(spark, sf))


@query("j20_section_kind", f"{_M}, r AS (SELECT form, id, s, row_number() OVER (PARTITION BY form, id ORDER BY ty, tx, s) AS k FROM m WHERE ty > cy AND (s LIKE '%7-%' OR s LIKE '%3-%')) SELECT form, id, CASE WHEN s LIKE '%7-%' THEN 'other' ELSE 'current' END AS kind FROM r WHERE k = 1")
def j20(spark, sf):
    """The nearest heading above that names a section tells its kind; texts of part 7 and 3 stand for headings."""
    return G.section_kinds(boxes(spark, sf), texts(spark, sf).where("s LIKE '%7-%' OR s LIKE '%3-%'"), F.when(F.col("s").like("%7-%"), "other").otherwise("current"))


@query("j21_option_labels", f"{_M}, d AS (SELECT form, id, s, x + w / 2 - (tx + tw / 2) AS dx FROM m WHERE abs(tcy - cy) <= 8), r AS (SELECT form, id, s, row_number() OVER (PARTITION BY form, id ORDER BY CASE WHEN dx BETWEEN 0 AND 70 THEN 0 ELSE 1 END, abs(dx), s) AS k FROM d) SELECT form, id, s AS label FROM r WHERE k = 1")
def j21(spark, sf):
    return G.option_labels(boxes(spark, sf), texts(spark, sf))


_FIELDS = (
    "l_orderkey AS form",
    "1 AS page",
    "concat(l_returnflag, '_', l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice)) AS id",
    "l_partkey * 3 % 300 AS x",
)


@query("a17_repeating_columns", f"WITH b AS (SELECT {', '.join(_FIELDS)} FROM lineitem), g AS (SELECT *, regexp_replace(id, '[0-9]+$', '') AS base FROM b) SELECT g.form, g.id, count(*) >= 2 AS repeats FROM g JOIN g o ON g.form = o.form AND g.page = o.page AND g.base = o.base AND abs(g.x - o.x) <= 12 GROUP BY 1, 2")
def a17(spark, sf):
    """Every line of an order is a field, named by its flags and a number."""
    return G.repeating_columns(table(spark, sf, "lineitem").selectExpr(*_FIELDS), F.regexp_replace("id", "[0-9]+$", ""))


@query("r9_overlap_recall", f"WITH {_BOXES_SQL}, f AS (SELECT form, page, tx AS fx, ty AS fy, tw AS fw, th AS fh FROM (WITH {_TEXTS_SQL} SELECT * FROM t)) SELECT count(*) AS n_truth, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM f WHERE f.form = b.form AND least(b.y + b.h, fy + fh) - greatest(b.y, fy) > 8 AND fx < b.x + b.w AND fx + fw > b.x)) AS n_hit FROM b")
def r9(spark, sf):
    truth = boxes(spark, sf)
    fields = texts(spark, sf).selectExpr("form", "page", "tx AS x", "ty AS y", "tw AS w", "th AS h")
    hits = G.overlap_hits(truth, fields).agg(F.count(F.lit(1)).alias("n_hit"))
    return truth.agg(F.count(F.lit(1)).alias("n_truth")).crossJoin(hits)


@query("a14_widget_groups", f"WITH {_BOXES_SQL}, g AS (SELECT form, l, id, x, y, row_number() OVER (PARTITION BY form ORDER BY length(id), id) AS k FROM (SELECT *, 'b' AS l FROM b)) SELECT form, count(*) AS n_widgets, arg_min(x, k) AS x, arg_min(y, k) AS y FROM g GROUP BY form")
def a14(spark, sf):
    """Widgets of one name are one field; the first widget gives its place."""
    b = boxes(spark, sf)
    return b.groupBy("form").agg(F.count(F.lit(1)).alias("n_widgets"), F.min_by("x", F.struct(F.length("id"), F.col("id"))).alias("x"), F.min_by("y", F.struct(F.length("id"), F.col("id"))).alias("y"))
