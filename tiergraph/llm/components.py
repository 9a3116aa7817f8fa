"""Connected components over an edge table, by alternating large-star and small-star rounds.

Each round is written to the shared folder. Nothing but a yes or no a round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, remove, shuffled


def components(edges: DataFrame, scratch: Scratch | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the smallest node of its component.

    The result is a table of scratch; the rounds before it are deleted here.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = scratch.keep(edges, "cc")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(shuffled(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(shuffled(least), "u")
        star = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.keep(star, "cc")
        remove(scratch.spark, scratch.paths.pop(-2))
        if edges.join(shuffled(edges.select(F.col("v").alias("u"))), "u", "left_semi").isEmpty():  # all point to a root
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components didn't settle")
