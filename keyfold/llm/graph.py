"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a join with a per-node minimum, written as a table before the next one, so nothing is collected and a
lost executor costs a reread. The loop ends when the links are stars: no hub is a leaf and every leaf has one hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("hub")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("hub")))
    return roles.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("hub").alias("hub")).where("leaf > 1 or leaf = 1 and hub = 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with a link, component being the smallest node that links reach."""
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = scratch.write(down, f"{name}-0")
    for k in range(1, rounds + 1):
        if _stars(now):
            break
        now = scratch.write(_small_star(_large_star(now)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
