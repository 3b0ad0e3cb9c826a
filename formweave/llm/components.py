"""Distributed union-find: connected components by alternating large and small stars, in DataFrame operations.

Each round replaces every node's neighbours by stars around the least of them until the edges are stars around each
component's least node. Rounds are written to the shared folder, so lineage stays short and lost executors cost one
round. Minima are combined before the shuffle; they are written before they are joined back, so that adaptive execution
can split the neighbours of a node that has very many. They take as many files as their edges need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formweave.llm.common import forget, written


def _stars(edges: DataFrame, large: bool, label: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """`edges` (u, v) with u > v. Large: each neighbour above u moves to u's least neighbour; small: those below do. Also
    the table that the result reads."""
    sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    least = written(least, label, rows=rows)
    joined = sides.join(least, F.col("u") == F.col("c"))
    if large:
        return joined.where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct(), least


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node either has a single lesser neighbour that has none, or none."""
    up, down = edges.select(F.col("u").alias("node"), "v"), edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v"))
    ends = up.unionByName(down).groupBy("node").agg(F.count("v").alias("n"), F.count(F.lit(1)).alias("all"))
    return ends.where("n > 1 OR (n = 1 AND all > 1)").isEmpty()


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component) of all nodes of `edges` (a, b): the component's least node. Loops and repeated edges do nothing.
    `edges` is counted first, so it should be a table."""
    rows = 2 * edges.count()
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(now, label, rows=rows)
    while not _all_stars(now):
        large, reads = _stars(now, True, label, rows)
        large = written(large, label, rows=rows)
        small, also = _stars(large, False, label, rows)
        after = written(small, label, rows=rows)
        for t in (now, reads, large, also):
            forget(t)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merge_components(found: DataFrame, edges: DataFrame, label: str = "cc") -> DataFrame:
    """`found` (node, component) after further `edges` (a, b): the components are joined, their nodes are not visited again."""
    a, b = (found.select(F.col("node").alias(s), F.col("component").alias(f"c{s}")) for s in "ab")
    links = edges.join(a, "a", "left").join(b, "b", "left")
    links = written(links.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), label, rows=edges.count())
    over = connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), label)
    over = over.select(F.col("component").alias("to"), F.col("node").alias("component"))
    ends = (links.select(F.col(s).alias("node"), F.col(f"c{s}").alias("component")) for s in "ab")
    nodes = found.unionByName(next(ends)).unionByName(next(ends)).distinct()
    return nodes.join(over, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
