"""Connected components by alternating large and small stars, on written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of each vertex (larger ones, or smaller ones and itself) to its least neighbour.

    The least neighbour is an aggregate joined back, not a window: a vertex with a third of all
    edges is summed in parts and its join is split.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = both.join(least, "u")
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(v, component)`` for every vertex of ``edges (u, v)``: the least vertex that it reaches.

    Loops and repeated edges are allowed; without edges the result is empty.
    """
    now = written(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter(F.col("u") != F.col("v")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        new = written(_star(_star(now, True), False), "edges")
        drop_written(now)
        now = new
    leaves = now.select(F.col("u").alias("v"), F.col("v").alias("component"))
    return leaves.union(now.select(F.col("v"), F.col("v").alias("component")).distinct())
