"""Connected components by alternating large-star and small-star steps over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm import scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node's neighbours (all, or the smaller ones) are tied to the least of them and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    side = both if large else both.where("u > v")
    least = side.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = side.join(least, "u")
    tied = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return tied.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); a component is named by its least node."""
    now = scratch.table(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = None
    while True:
        new = scratch.table(_stars(_stars(now, True), False), "edges")
        seen = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        scratch.done_with(now)
        now = new
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    ends = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return scratch.table(ends.unionByName(roots).groupBy("node").agg(F.min("component").alias("component")), "components")
