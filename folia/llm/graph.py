"""Connected components by alternating large and small stars; all state stays in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def _toward_least(edges: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """edges (u, v): for each u the least of itself and its neighbours as m; and the small table, which is written, so the join can split hot nodes."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), tag)
    return edges.join(least, "u"), least


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs to (node, component): component is the least node reachable. Nodes without edges are absent.

    Each pass sends a node's larger neighbours, then its smaller ones, to the least of them, until all components are stars; passes
    grow with the logarithm of a component's diameter. A node of any degree costs sums and a splittable join, never a list.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialize(links, "cc")
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near, least_of_all = _toward_least(both, "cc-m")
        large = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "cc-l")
        small, least_of_small = _toward_least(large, "cc-m")
        small = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = materialize(small, "cc")
        for table in (links, large, least_of_all, least_of_small):
            drop_table(table)
        links = new
        # done when all are stars: every node has one edge, to a node without any
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("edges"), F.lit(0).alias("least")).union(links.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("edges").alias("edges"), F.max("least").alias("least")).where("edges + least > 1").isEmpty():
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
