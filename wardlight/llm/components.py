"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a minimum per node and a join back, so a node that a third of all edges share is
pre-aggregated, and its join side can be split. The edges are checkpointed after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.session import checkpoint_root


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) -> one row per node that has an edge: node, component (the
    smallest node it reaches). Loops and repeated edges are fine."""
    checkpoint_root(edges.sparkSession)

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    now = (edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
           .distinct().checkpoint())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        root = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(root, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = least(large)
        small = (large.join(root, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(root.select("u", F.col("m").alias("v"))).distinct())
        now = small.checkpoint()
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
