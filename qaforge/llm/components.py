"""Connected components over an edge table: alternating large-star and small-star steps, joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node of edges (u, v) that is not its own root.

    Loops and null ends are left out. No step gathers the neighbours of a node in one row, so a node may have any number.
    """
    now = written(edges.where("u <> v").select("u", "v").distinct(), "edges")
    state = None
    while True:
        following = written(_small_star(_large_star(now)), "edges")
        drop(now)
        now = following
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = mark
