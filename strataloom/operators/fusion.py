"""Fusion of ranked lists: reciprocal ranks, deduplication, comparison of rankings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.lexical import top

RRF_K = 60


def rrf(lists: DataFrame, query_key: str, key: str, weights: Mapping[str, float] | None = None, k: int | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """(query_key, key, score, rank) of ``lists(query_key, list_id, key, rank)``: the sum of weight / (rrf_k + rank).

    Lists without a weight have 1. Scores are rounded to 6 digits before ranking, ties go to the smaller key. An item
    that a list holds twice counts once there, at its better rank.
    """
    weight: Column = F.lit(1.0)
    if weights:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        weight = F.coalesce(F.try_element_at(table, F.col("list_id").cast("string")), F.lit(1.0))
    once = lists.groupBy(query_key, "list_id", key).agg(F.min("rank").alias("rank"))
    fused = once.groupBy(query_key, key).agg(F.round(F.sum(weight / (F.lit(rrf_k) + F.col("rank"))), 6).alias("score"))
    return top(fused, [query_key], "score", key, k or 2**31 - 1)


def dedup_best(lists: DataFrame, query_key: str, key: str, score: str = "score") -> DataFrame:
    """One row per query and key: the first by list and rank; ranked by score, ties by key."""
    w = Window.partitionBy(query_key, key).orderBy("list_id", "rank")
    first = lists.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "rank")
    return top(first, [query_key], score, key, 2**31 - 1)


def overlap(a: DataFrame, b: DataFrame, query_key: str, key: str) -> DataFrame:
    """(query_key, n_a, n_b, n_both, n_any): sizes of two lists and of what they share."""
    both = a.select(query_key, key, F.lit(1).alias("a")).distinct().join(b.select(query_key, key, F.lit(1).alias("b")).distinct(), [query_key, key], "full_outer")
    return both.groupBy(query_key).agg(
        F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count("*").alias("n_any")
    )


def rank_change(before: DataFrame, after: DataFrame, query_key: str, key: str) -> DataFrame:
    """(query_key, key, rank_before, rank_after, change): moves of the items of ``after``; a new one has a star."""
    j = after.select(query_key, key, F.col("rank").alias("rank_after")).join(before.select(query_key, key, F.col("rank").alias("rank_before")), [query_key, key], "left")
    up = F.col("rank_before") - F.col("rank_after")
    label = (
        F.when(F.col("rank_before").isNull(), "★").when(up > 0, F.concat(F.lit("▲"), up.cast("string"))).when(up < 0, F.concat(F.lit("▼"), (-up).cast("string"))).otherwise("—")
    )
    return j.select(query_key, key, "rank_before", "rank_after", label.alias("change"))


def score_stats(lists: DataFrame, stage: str = "list_id") -> DataFrame:
    return lists.groupBy(stage).agg(F.count("*").alias("n"), F.min("score").alias("lowest"), F.round(F.avg("score"), 6).alias("mean"), F.max("score").alias("highest"))


def score_bucket(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.5, "middle").otherwise("low")


def candidate_k(top_k: int, fetch_k: int | None = None) -> int:
    return fetch_k or max(3 * top_k, 20)
