"""Plan the filling of forms whose boxes have no labels: captions by geometry, skip rules, values, options, dates.

Every box is resolved on its own, by its caption. Boxes of other people and other names, and rows of repeating columns, are
skipped. A name that was found for a box of an address is replaced by the street, or the box is skipped. Choices take the
option that fits best; dates turn day first where the page says so nearby. All of it joins on page and band, or on the
owner; nothing is gathered by page.

Input: fields (owner, form, page, id, x, y, w, h, tooltip, options: an array, null for texts), texts (form, page, tx, ty, tw,
th, s), the vault and phrases of the resolver. Null tooltips say nothing; boxes on pages without texts have no caption and stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.functions import predicates as P
from formweave.functions.text import option_score, words_of_label
from formweave.operators import geometry as G
from formweave.operators.resolver import resolve_forms
from formweave.sources.shared import written

#: Words of an address, of a line for a street, of a courtesy line; labels whose values are the owner's names.
ADDRESS = "street|address|city|town|state|province|zip|postal|country|apt|suite|floor|care of"
STREET_LINE, COURTESY = "street|address line|residence address|mailing address|home address", "care of|in care"
NAMES = ("full name", "first name", "last name", "given and middle names")
DAY_FIRST_Y, DAY_FIRST_X, LEAST_OPTION = 22, 260, 2
DAY_FIRST = r"(?is)day.*month.*year"


def _word(c: Column, words: str) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).rlike(rf"\b({words})\b")


def captioned(fields: DataFrame, texts: DataFrame) -> DataFrame:
    """`fields` with caption and header, empty where there is none."""
    place = ["form", "id"]
    said = fields.join(G.captions(fields, texts), place, "left").join(G.headers(fields, texts), place, "left")
    return said.withColumns({c: F.coalesce(c, F.lit("")) for c in ("caption", "header")})


def skipped(captioned_fields: DataFrame) -> DataFrame:
    """`captioned_fields` with `skip`: boxes of others, of other names, of repeating columns."""
    columns = G.repeating_columns(captioned_fields.where(r"id RLIKE '[0-9]$'"), F.regexp_replace("id", "[0-9]+$", ""))
    f = captioned_fields.join(columns, ["form", "id"], "left")
    context = F.concat_ws(" ", "caption", "header", "id")
    other = P.other_entity(context) | P.other_name(context) | P.other_name(F.col("tooltip")) | P.other_subject(F.col("caption"), F.col("tooltip"), F.col("header"))
    return f.withColumn("skip", other | F.coalesce("repeats", F.lit(False))).drop("repeats")


def day_first_boxes(fields: DataFrame, texts: DataFrame) -> DataFrame:
    """(form, id) of boxes near a text that asks for day, month and year in this order."""
    asks = texts.where(F.regexp_replace("s", r"[()/]", " ").rlike(DAY_FIRST))
    near = G._met(fields, asks, F.col("y") - DAY_FIRST_Y, F.col("y") + DAY_FIRST_Y, "ty").where(f"abs(t.ty - y) < {DAY_FIRST_Y} AND abs(t.tx - x) < {DAY_FIRST_X}")
    return near.select("form", "id").distinct()


def day_first(value: Column) -> Column:
    parts = [F.regexp_extract(value, r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})$", i) for i in (1, 2, 3)]
    turned = F.concat_ws("/", F.lpad(parts[1], 2, "0"), F.lpad(parts[0], 2, "0"), parts[2])
    return F.when(parts[2] != "", turned).otherwise(value)


def plan(fields: DataFrame, texts: DataFrame, vault: DataFrame, phrases: DataFrame, today: Column) -> DataFrame:
    """(form, id, caption, skip, value, option) of every box; a null value leaves it empty."""
    f = written(skipped(written(captioned(fields, texts), "captioned")), "boxes")
    alone = f.where("NOT skip").select("owner", F.concat_ws("/", "form", "id").alias("form"), F.lit(0).alias("pos"), F.col("caption").alias("label"), F.col("id").alias("name"), F.lit(None).cast("int").alias("max_length"))
    # each owner's names and street, asked for like a box's
    kinds = F.explode(F.array(*(F.lit(n) for n in (*NAMES, "street address"))))
    asked = f.select("owner").distinct().select("owner", kinds.alias("label"))
    asked = asked.select("owner", F.concat(F.lit("#"), "label").alias("form"), F.lit(0).alias("pos"), "label", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("max_length"))
    found = written(resolve_forms(alone.unionByName(asked), vault, phrases, today).select("owner", "form", "value"), "values")
    own = found.where("form LIKE '#%' AND value IS NOT NULL")
    names = own.groupBy("owner").agg(F.collect_set(F.when(F.col("form") != "#street address", words_of_label(F.col("value")))).alias("names"), F.max(F.when(F.col("form") == "#street address", F.col("value"))).alias("street"))
    values = found.where("form NOT LIKE '#%'").withColumnRenamed("form", "box").drop("owner")
    f = f.withColumn("box", F.concat_ws("/", "form", "id")).join(values.hint("merge"), "box", "left").join(names.hint("merge"), "owner", "left")
    is_name = F.coalesce(F.array_contains("names", words_of_label(F.col("value"))), F.lit(False))
    misplaced = is_name & (_word(F.col("caption"), ADDRESS) | _word(F.col("tooltip"), ADDRESS))
    is_street = _word(F.col("caption"), STREET_LINE) & ~_word(F.col("caption"), COURTESY)
    street = F.when(is_street & ~F.coalesce(F.array_contains("names", words_of_label(F.col("street"))), F.lit(False)), F.col("street"))
    f = f.withColumn("skip", F.col("skip") | (misplaced & street.isNull())).withColumn("value", F.when(misplaced, street).otherwise(F.col("value")))
    turned = day_first_boxes(fields, texts).withColumn("day_first", F.lit(True))
    f = f.join(turned.hint("merge"), ["form", "id"], "left")
    scores = F.transform("options", lambda o, i: F.struct(option_score(o, F.col("value")).alias("score"), (-i).alias("i"), o.alias("o")))
    best = F.array_max(F.filter(scores, lambda s: s.score >= LEAST_OPTION))
    value = F.when(F.col("skip"), None).when(F.col("options").isNull() & F.col("day_first"), day_first(F.col("value"))).when(F.col("options").isNull() | best.isNotNull(), F.col("value"))
    return f.select("form", "id", "caption", "skip", value.alias("value"), F.when(value.isNotNull(), best.o).alias("option"))
