"""Connected components of a large graph by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours (the larger ones, or the smaller ones and the node itself) on the smallest neighbour."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # The same number by an expression, so that the minima are dealt for the join by an exchange of their own. Then both sides of
    # the join are exchanges, and adaptive execution can split the rows of a node that very many links share.
    met = around.join(least.withColumn("w", F.bitwise_not(F.bitwise_not("u"))).drop("u"), F.col("u") == F.col("w")).drop("w")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) for every node of the edges (u, v); loops are ignored.

    Neither links nor nodes come to the driver; each round writes its edges to the shared folder.
    """
    now = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = None
    while True:
        following = stored(_step(_step(now, True), False), "edges")
        new_mark = following.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(now)
        now = following
        if new_mark == mark:
            break
        mark = new_mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
