"""Connected components of an undirected graph by alternating large-star and small-star steps.

Each step is an aggregation of the edges (the least neighbour of every node) and
a join with it, so no task holds a node's neighbours; the number of steps grows
with the logarithm of the longest path.  Every step is written to the shared
folder, so a lost executor costs no earlier step, and the step before is then
deleted.  Edges with a null end are ignored, as are loops; repeated edges count
once; no edges give no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connects every node's larger (or all smaller) neighbours with the smallest of its neighbourhood."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    root = F.least("u", "least")
    if large:
        spread = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), root.alias("v"))
    else:
        spread = both.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
    return spread.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node of an edge with the smallest node of its component."""
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    last = None
    while True:
        step = materialise(_star(_star(now, large=True), large=False))
        release(now)
        now = step
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
