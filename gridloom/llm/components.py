"""Connected components of a graph in a table, by alternating large-star and small-star steps.

Each round is two grouped minimums joined back; edges shrink to stars around the smallest node. A
node with very many neighbours is a large join key with one row on the other side, which adaptive
execution splits (splittable_join). The edges of each round are staged in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import splittable_join, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): each u's larger (large) or other (small) neighbours are tied to its smallest one."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = splittable_join(both, least, "u")
    out = tied.filter("v > u").select("v", "m") if large else tied.select("v", "m").union(least.select(F.col("u").alias("v"), "m"))
    return out.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for the nodes of edges u, v (integers); roots included."""
    now, mark = staged(edges.select("u", "v").filter("u <> v").distinct(), "edges", ids_only=True), None
    while True:
        now = staged(_star(_star(now, True), False), "edges", ids_only=True)
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == mark:
            break
        mark = (seen.n, seen.h)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
