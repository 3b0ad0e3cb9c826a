"""Captions, headers and options by geometry: equal page and band first, then exact ranges, then a ranked first.

Boxes and texts of a page are dealt into bands of its height (y grows upwards). A text stands in one band, a box in all that
its reach meets, so a box meets the texts of its neighbourhood only, and a page with very many texts is spread over many
groups. What is nearest at any distance is found in the box's own band, else taken from the next band above that has any:
one row a band, not one a text. Overlaps meet in the cells of a grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW, ABOVE, LEFT, HEADER_X, INSTRUCTIONS, OPTION_ROW, OPTION_X, COLUMN_X, OVERLAP_Y = 7, 26, 2, 80, 540, 8, 70, 12, 8
#: Heights of bands, and the side of a grid's cells. They change cost, not results.
BAND, CELL = 32, 64
_PLACE = ("form", "page")


def _bands(low: Column, high: Column, height: int) -> Column:
    """Numbers of all bands that a range meets."""
    return F.sequence(F.floor(low / height).cast("long"), F.floor(high / height).cast("long"))


def _met(boxes: DataFrame, texts: DataFrame, low: Column, high: Column, at: str, height: int = BAND) -> DataFrame:
    """Boxes with the texts of their page whose `at` (ty, or the middle tcy) is from `low` to `high`, each pair once."""
    t = texts.select(*_PLACE, F.struct("tx", "ty", "tw", "th", "s").alias("t"), (F.col("ty") + F.col("th") / 2).alias("tcy"), F.col("ty").alias("_ty"))
    t = t.withColumn("band", F.floor(F.col("tcy" if at == "tcy" else "_ty") / height).cast("long")).drop("_ty")
    b = boxes.withColumn("cy", F.col("y") + F.col("h") / 2).withColumn("band", F.explode(_bands(low, high, height)))
    at_text = F.col("tcy") if at == "tcy" else F.col("t.ty")
    return b.join(t, [*_PLACE, "band"]).where((at_text >= low) & (at_text <= high))


def captions(boxes: DataFrame, texts: DataFrame) -> DataFrame:
    """(form, id, caption): the nearest text to the left on the row, else the nearest above that overlaps in x."""
    cy, top = F.col("y") + F.col("h") / 2, F.col("y") + F.col("h") + ABOVE
    row = _met(boxes, texts, cy - ROW, cy + ROW, "tcy").where(F.col("t.tx") <= F.col("x") - LEFT)
    above = _met(boxes, texts, F.least(cy, top), top, "ty").where("t.ty > cy AND t.tx < x + w AND t.tx + t.tw > x")
    near = row.select("form", "id", F.struct("t.tx", "t.s").alias("l"), F.lit(None).cast("struct<ty:double,tx:double,s:string>").alias("a"))
    over = above.select("form", "id", F.lit(None).cast("struct<tx:double,s:string>").alias("l"), F.struct("t.ty", "t.tx", "t.s").alias("a"))
    found = near.unionByName(over).groupBy("form", "id").agg(F.max("l").alias("l"), F.min("a").alias("a"))
    all_boxes = boxes.join(texts.select(*_PLACE).distinct(), list(_PLACE), "left_semi").select("form", "id")
    return all_boxes.join(found, ["form", "id"], "left").select("form", "id", F.coalesce("l.s", "a.s").alias("caption"))


def nearest_above(boxes: DataFrame, texts: DataFrame) -> DataFrame:
    """`boxes` with t, the text (tx, ty, tw, th, s) of the least ty above the box's middle, by tx and s of equals; null where
    there is none.

    Each band is ordered on its own: a page's texts are never all in one group, only a row for each of its bands."""
    t = texts.select(*_PLACE, F.col("ty").alias("k"), F.lit(1).alias("kind"), F.struct("ty", "tx", "s", "tw", "th").alias("t"), F.lit(None).cast("long").alias("n"))
    b = boxes.withColumn("n", F.monotonically_increasing_id())
    b = b.withColumn("b", F.struct(*boxes.columns))
    asks = b.select(*_PLACE, (F.col("y") + F.col("h") / 2).alias("k"), F.lit(0).alias("kind"), F.lit(None).cast(t.schema["t"].dataType).alias("t"), "n", "b")
    rows = asks.unionByName(t.withColumn("b", F.lit(None).cast(asks.schema["b"].dataType))).withColumn("band", F.floor(F.col("k") / BAND).cast("long"))
    # downwards, boxes before texts of the same height, of texts of one height the first comes last
    order = [F.desc("k"), "kind", F.desc("t.tx"), F.desc("t.s")]
    within = Window.partitionBy(*_PLACE, "band").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("in_band", F.last("t", True).over(within)).where("kind = 0")
    lowest = rows.groupBy(*_PLACE, "band").agg(F.min("t").alias("lowest"))
    above = Window.partitionBy(*_PLACE).orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    carried = lowest.select(*_PLACE, "band", F.last("lowest", True).over(above).alias("carried"))
    return placed.join(carried, [*_PLACE, "band"]).select("b.*", F.coalesce("in_band", "carried").alias("t"))


def headers(boxes: DataFrame, texts: DataFrame) -> DataFrame:
    """(form, id, header): the nearest text above at the left margin, of three characters or more."""
    margin = texts.where(f"tx <= {HEADER_X} AND length(trim(s)) >= 3")
    return nearest_above(boxes, margin).where("t IS NOT NULL").select("form", "id", F.col("t.s").alias("header"))


def section_kinds(boxes: DataFrame, headings: DataFrame, kind: Column) -> DataFrame:
    """(form, id, kind): what the nearest heading above tells; `kind` is an expression of the heading's text s."""
    found = nearest_above(boxes, headings).where("t IS NOT NULL").select("form", "id", F.col("t.s").alias("s"))
    return found.select("form", "id", kind.alias("kind"))


def instructions(boxes: DataFrame, texts: DataFrame) -> DataFrame:
    """(form, id, text): all texts of the band above, from the top, left to right. The pairs are those of the result."""
    m = _met(boxes, texts, F.col("y"), F.col("y") + INSTRUCTIONS, "ty", INSTRUCTIONS)
    parts = F.array_sort(F.collect_list(F.struct((-F.col("t.ty")).alias("k"), F.col("t.tx").alias("x"), F.col("t.s").alias("s"))))
    return m.groupBy("form", "id").agg(F.array_join(F.transform(parts, lambda p: p.s), " ").alias("text"))


def option_labels(boxes: DataFrame, texts: DataFrame) -> DataFrame:
    """(form, id, label): on the row, the text with its middle within reach to the left, else the nearest middle."""
    middle, cy = F.col("t.tx") + F.col("t.tw") / 2, F.col("y") + F.col("h") / 2
    m = _met(boxes, texts, cy - OPTION_ROW, cy + OPTION_ROW, "tcy").withColumn("dx", F.col("x") + F.col("w") / 2 - middle)
    left = F.min_by("t.s", F.when((F.col("dx") >= 0) & (F.col("dx") <= OPTION_X), F.struct("dx", "t.s")))
    near = F.min_by("t.s", F.struct(F.abs("dx"), F.col("t.s")))
    return m.groupBy("form", "id").agg(F.coalesce(left, near).alias("label"))


def repeating_columns(boxes: DataFrame, base: Column) -> DataFrame:
    """(form, id, repeats): another field of the same base name on the page, no more than COLUMN_X aside.

    Two boxes of one strip of that width repeat each other; else the nearest of the two neighbouring strips decide. So a
    strip gives one row with its count and ends, and no box meets another."""
    b = boxes.select("form", "page", "id", "x", base.alias("base")).withColumn("strip", F.floor(F.col("x") / COLUMN_X).cast("long"))
    strips = b.groupBy("form", "page", "base", "strip").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    ends = strips.select("form", "page", "base", F.explode(F.array(*(F.struct((F.col("strip") - d).alias("strip"), F.when(F.lit(d == 0), F.col("n")).alias("n"), F.when(F.lit(d == 1), F.col("lo")).alias("next"), F.when(F.lit(d == -1), F.col("hi")).alias("last")) for d in (-1, 0, 1)))).alias("e"))
    known = ends.groupBy("form", "page", "base", "e.strip").agg(F.max("e.n").alias("n"), F.max("e.next").alias("next"), F.max("e.last").alias("last"))
    near = (F.col("n") >= 2) | F.coalesce(F.col("next") - F.col("x") <= COLUMN_X, F.lit(False)) | F.coalesce(F.col("x") - F.col("last") <= COLUMN_X, F.lit(False))
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("form", "page", "base", "strip")]
    return b.alias("b").join(known.alias("k"), same).groupBy("b.form", "b.id").agg(F.bool_or(near).alias("repeats"))


def overlap_hits(truth: DataFrame, fields: DataFrame) -> DataFrame:
    """Truth boxes (form, page, id, x, y, w, h), each once, with a field that overlaps by more than OVERLAP_Y in y and at all
    in x. Both are dealt into the cells of a grid that they touch, and meet in equal cells (a semi join)."""

    def cells(df: DataFrame, x: str, y: str, w: str, h: str) -> DataFrame:
        across = df.withColumn("cx", F.explode(_bands(F.col(x), F.col(x) + F.greatest(w, F.lit(0.0)), CELL)))
        return across.withColumn("cy", F.explode(_bands(F.col(y), F.col(y) + F.greatest(h, F.lit(0.0)), CELL)))

    f = cells(fields.select(*_PLACE, F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("w").alias("fw"), F.col("h").alias("fh")), "fx", "fy", "fw", "fh").alias("f")
    t = cells(truth, "x", "y", "w", "h").alias("t")
    near = F.least(F.col("y") + F.col("h"), F.col("fy") + F.col("fh")) - F.greatest("y", "fy") > OVERLAP_Y
    same = [F.col(f"t.{c}") == F.col(f"f.{c}") for c in (*_PLACE, "cx", "cy")]
    hits = t.join(f, [*same, near, F.col("fx") < F.col("x") + F.col("w"), F.col("fx") + F.col("fw") > F.col("x")], "left_semi")
    return hits.drop("cx", "cy").dropDuplicates(["form", "page", "id"])
