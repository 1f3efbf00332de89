"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u moves to the least of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours move to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of edges (u, v) but the least of its component, which names it.

    Each round shuffles links, never whole components; the number of rounds grows with the logarithm
    of the longest chain."""
    now = scratch.save(_small_star(edges).distinct())
    state = None
    while True:
        step = scratch.save(_small_star(_large_star(now)).distinct())
        scratch.drop(now)
        now = step
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == (seen["n"], seen["s"]):
            return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
        state = seen["n"], seen["s"]
