"""Geometry on one page of very many boxes and texts: equal to all pairs, while the pairs that meet grow with the page."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from formweave.operators import geometry as G

N = 12_000


@pytest.fixture(scope="module")
def page(spark):
    """A single tall page: a box for every third text; places repeat, so that there are ties."""
    rows = [(1, 1, float(i * 37 % 560), float(i * 131 % (2 * N)), 40.0, 10.0, f"t{i * 7 % N}") for i in range(N)]
    texts = pd.DataFrame(rows, columns=["form", "page", "tx", "ty", "tw", "th", "s"])
    boxes = pd.DataFrame([(1, 1, f"b{i % 5}_{i}", float(i * 53 % 560), float(i * 89 % (2 * N)), 60.0, 4.0 + i % 30) for i in range(N // 3)], columns=["form", "page", "id", "x", "y", "w", "h"])
    con = duckdb.connect()
    con.register("t", texts)
    con.register("b", boxes)
    con.execute("CREATE VIEW m AS SELECT *, y + h / 2 AS cy, ty + th / 2 AS tcy FROM b JOIN t USING (form, page)")
    return spark.createDataFrame(boxes).cache(), spark.createDataFrame(texts).cache(), con


def same(df, con, sql):
    assert sorted(map(tuple, df.collect()), key=str) == sorted(con.execute(sql).fetchall(), key=str)


def test_captions(page):
    boxes, texts, con = page
    left = "SELECT id, arg_max(s, (tx, s)) AS s FROM m WHERE abs(tcy - cy) <= 7 AND tx <= x - 2 GROUP BY id"
    over = "SELECT id, arg_min(s, (ty, tx, s)) AS s FROM m WHERE ty > cy AND ty - (y + h) <= 26 AND tx < x + w AND tx + tw > x GROUP BY id"
    same(G.captions(boxes, texts), con, f"SELECT 1, b.id, coalesce(l.s, a.s) FROM b LEFT JOIN ({left}) l ON b.id = l.id LEFT JOIN ({over}) a ON b.id = a.id")


def test_headers_and_sections(page):
    boxes, texts, con = page
    nearest = "SELECT 1, id, arg_min(s, (ty, tx, s)) FROM m WHERE ty > cy AND {} GROUP BY id"
    same(G.headers(boxes, texts), con, nearest.format("tx <= 80 AND length(trim(s)) >= 3"))
    same(G.section_kinds(boxes, texts.where("s LIKE '%99'"), F.col("s")), con, nearest.format("s LIKE '%99'"))


def test_options_columns_and_overlaps(page):
    boxes, texts, con = page
    same(G.option_labels(boxes, texts), con, "SELECT 1, id, arg_min(s, (CASE WHEN dx BETWEEN 0 AND 70 THEN 0 ELSE 1 END, abs(dx), s)) FROM (SELECT *, x + w / 2 - (tx + tw / 2) AS dx FROM m WHERE abs(tcy - cy) <= 8) GROUP BY id")
    few = boxes.where("y < 300")
    con.execute("CREATE OR REPLACE VIEW few AS SELECT *, substr(id, 1, 2) AS base FROM b WHERE y < 300")
    same(G.repeating_columns(few, F.substring("id", 1, 2)), con, "SELECT 1, g.id, count(*) >= 2 FROM few g JOIN few o ON g.base = o.base AND abs(g.x - o.x) <= 12 GROUP BY g.id")
    fields = texts.selectExpr("form", "page", "tx AS x", "ty AS y", "tw AS w", "th AS h")
    same(G.overlap_hits(boxes, fields).select("form", "id"), con, "SELECT DISTINCT 1, id FROM m WHERE least(y + h, ty + th) - greatest(y, ty) > 8 AND tx < x + w AND tx + tw > x")


def test_pairs_grow_with_the_page(page):
    boxes, texts, _ = page
    cy = F.col("y") + F.col("h") / 2
    met = G._met(boxes, texts, cy - G.ROW, cy + G.ROW, "tcy")
    every = [texts.withColumn("ty", F.col("ty") + 2 * N * k) for k in range(4)]
    more = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])
    tall = boxes.withColumns({"k": F.explode(F.array(*map(F.lit, range(4))))}).withColumn("y", F.col("y") + F.col("k") * 2 * N)
    n = met.count()
    assert n < 20 * N and G._met(tall, more, cy - G.ROW, cy + G.ROW, "tcy").count() < 4.1 * n


def test_empty(page):
    boxes, texts, _ = page
    for f in (G.captions, G.headers, G.instructions, G.option_labels):
        assert f(boxes.limit(0), texts).collect() == f(boxes.limit(3), texts.limit(0)).collect() == []
