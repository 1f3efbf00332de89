"""Components by least-label passing with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """(g, n, label) from nodes (g, n) and edges (g, n, m). Labels and edges are checkpointed between
    rounds where the session has a checkpoint folder, so plans don't grow."""
    spark = nodes.sparkSession
    keep = (lambda df: df.checkpoint()) if spark.sparkContext.getCheckpointDir() else (lambda df: df.persist())
    both = keep(edges.select("g", "n", "m").union(edges.select("g", F.col("m").alias("n"), F.col("n").alias("m"))))
    now = keep(nodes.distinct().withColumn("label", F.col("n")))
    for _ in range(rounds):
        heard = both.join(now.select("g", F.col("n").alias("m"), "label"), ["g", "m"]).groupBy("g", "n").agg(F.min("label").alias("heard"))
        step = now.join(heard, ["g", "n"], "left").select("g", "n", "label", F.least("label", F.coalesce("heard", "label")).alias("next"))
        jump = step.select("g", F.col("n").alias("next"), F.col("next").alias("far"))
        step = keep(step.join(jump, ["g", "next"], "left").select("g", "n", "label", F.least("next", F.coalesce("far", "next")).alias("new")))
        changed = step.where("new <> label").limit(1).count()
        now = step.select("g", "n", F.col("new").alias("label"))
        if not changed:
            break
    return now
