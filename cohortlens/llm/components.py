"""Connected components of a link table, by alternating large and small stars.

Each round is two aggregations and two joins on Spark; nothing but the two
convergence figures (row count and a checksum) reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def _hook(edges: DataFrame, small: bool) -> DataFrame:
    """One star step.  ``edges`` holds (u, v) with u > v.

    Large star: every larger neighbour of a node goes to the node's least neighbour.
    Small star: every smaller neighbour, and the node, goes to the least of them.
    """
    if small:
        both = edges
    else:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star")
    moved = both.join(least, "u")
    if small:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    else:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.where("m < u").select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; component is the least node reachable.

    Null ends and self links count for nothing.  The number of rounds grows with
    the logarithm of the longest path.
    """
    edges = links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = stage(edges, "edges")
    mark = None
    while True:
        edges = stage(_hook(_hook(edges, small=False), small=True), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    # every edge now leads to its component's least node
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
