"""Tables of the test data, and literal rows that Spark and SQL read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"


class Rows:
    """Rows with typed columns: `columns` as 'a bigint, b string'. Rule tables as they are; specimens `over` a table of the
    test data: every row of the table has each of them, with its own keys and values woven in."""

    def __init__(self, name: str, columns: str, rows: list[tuple]) -> None:
        self.name, self.columns, self.rows = name, [c.split() for c in columns.split(",")], rows
        self.source, self.woven = "", {}

    def over(self, source: str = "customer", **woven: str) -> Rows:
        """`woven`: for a column its expression, of its specimen value and the table's columns, in SQL that both engines read."""
        self.source, self.woven = source, woven
        return self

    def specimens(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, ", ".join(f"{n} {t}" for n, t in self.columns))

    def frame(self, spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
        if not self.source:
            return self.specimens(spark)
        each = (F.struct(*(F.lit(v).cast(t).alias(f"_{n}") for v, (n, t) in zip(r, self.columns, strict=True))) for r in self.rows)
        rows = table(spark, sf_dir, self.source).withColumn("_row", F.explode(F.array(*each))).select("*", "_row.*")
        return rows.selectExpr(*(f"{self._expression(n)} AS {n}" for n, _ in self.columns))

    def _expression(self, column: str) -> str:
        """The column's expression, its own name standing for the specimen value."""
        return re.sub("|".join(rf"\b{n}\b" for n, _ in self.columns), lambda m: f"_{m[0]}", self.woven.get(column, column))

    @property
    def cte(self) -> str:
        """`name AS (SELECT ...)` for a WITH list."""
        kinds = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        names = ", ".join(f"_{n}" for n, _ in self.columns)
        casts = ", ".join(f"CAST(_{n} AS {kinds[t]}) AS _{n}" for n, t in self.columns)
        specimens = f"SELECT {casts} FROM (VALUES {values}) v({names})"
        columns = ", ".join(f"{self._expression(n)} AS {n}" for n, _ in self.columns)
        return f"{self.name} AS (SELECT {columns} FROM ({specimens}){f' CROSS JOIN {self.source}' if self.source else ''})"


def phrase_sql(words: str, phrases: tuple[str, ...]) -> str:
    """SQL: whether normalised words hold one of the phrases, word by word."""
    return f"len(list_filter([{', '.join(map(repr, phrases))}], lambda p: contains(' ' || {words} || ' ', ' ' || p || ' '))) > 0"


def part_sql(text: str, parts: tuple[str, ...]) -> str:
    return f"len(list_filter([{', '.join(map(repr, parts))}], lambda p: contains({text}, p))) > 0"
