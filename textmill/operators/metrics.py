"""Retrieval quality and latency figures. ranked: (query_id, item, rank from 1); relevance: (query_id, item, gain)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators.order import numbered


def recall(ranked: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """Share of relevant items in the top k; nothing relevant: 1."""
    top = ranked.where(F.col("rank") <= k).select("query_id", "item", F.lit(1).alias("hit"))
    return relevance.join(top, ["query_id", "item"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def mrr(ranked: DataFrame, relevance: DataFrame) -> DataFrame:
    """One over the rank of the first relevant item, else 0."""
    first = ranked.join(relevance.select("query_id", "item"), ["query_id", "item"]).groupBy("query_id").agg(F.min("rank").alias("r"))
    return relevance.select("query_id").distinct().join(first, "query_id", "left").select("query_id", F.coalesce(1.0 / F.col("r"), F.lit(0.0)).alias("mrr"))


def ndcg(ranked: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """Gain 2^g - 1 over log2(rank + 1), relative to the best order; no gain at all: 1."""
    worth = lambda g, r: F.when(F.col(g) > 0, (F.pow(F.lit(2.0), F.col(g)) - 1) / F.log2(F.col(r) + 1.0)).otherwise(0.0)
    got = ranked.where(F.col("rank") <= k).join(relevance, ["query_id", "item"]).groupBy("query_id").agg(F.sum(worth("gain", "rank")).alias("dcg"))
    best = relevance.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("gain").desc(), "item"))).where(F.col("place") <= k)
    ideal = best.groupBy("query_id").agg(F.sum(worth("gain", "place")).alias("ideal"))
    both = relevance.select("query_id").distinct().join(ideal, "query_id", "left").join(got, "query_id", "left")
    return both.select("query_id", F.when(F.coalesce("ideal", F.lit(0.0)) == 0, 1.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def mean(per_query: DataFrame) -> DataFrame:
    """Means of recall, mrr and ndcg; without queries all are 1."""
    return per_query.agg(*[F.coalesce(F.avg(c), F.lit(1.0)).alias(c) for c in ("recall", "mrr", "ndcg")])


def latency(samples: DataFrame, group: str, value: str) -> DataFrame:
    """Median and the 95th percentile as the element at int(0.95 n) - 1 (the first for few samples)."""
    placed = numbered(samples.select(group, value), group, [F.col(value)], "i", "n")  # equal values may take each other's places
    at = F.greatest(F.lit(1), F.floor(F.col("n") * 0.95))
    middle = F.col("i").isin(F.floor((F.col("n") + 1) / 2)) | (F.col("i") == F.floor((F.col("n") + 2) / 2))
    return placed.groupBy(group).agg(F.avg(F.when(middle, F.col(value))).alias("p50"), F.max(F.when(F.col("i") == at, F.col(value))).alias("p95"))
