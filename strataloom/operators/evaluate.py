"""Retrieval quality and latency figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judge(ranked: DataFrame, labels: DataFrame, query: str = "query_id", key: str = "key") -> DataFrame:
    """Ranked rows with ``rel`` 1 where (query, key) is labelled."""
    return ranked.join(labels.select(query, key, F.lit(1).alias("rel")).distinct(), [query, key], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def metrics(ranked: DataFrame, labels: DataFrame, k: int = 5, query: str = "query_id", key: str = "key") -> DataFrame:
    """(query, recall, mrr, ndcg) of every labelled query; one without a ranked row has zeros.

    Recall is hits in the first k over labels; the ideal gain has the hits of the first k in front.
    """
    n = labels.select(query, key).distinct().groupBy(query).agg(F.count("*").alias("n"))
    j = judge(ranked, labels, query, key)
    hit = F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)
    per = j.groupBy(query).agg(
        F.sum(hit).alias("hits"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(hit / F.log2(F.col("rank") + 1)).alias("gain"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("hits").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = n.join(per, query, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.select(
        query,
        F.round(F.col("hits") / F.col("n"), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.when(F.col("hits") > 0, F.col("gain") / ideal).otherwise(0.0), 6).alias("ndcg"),
    )


def averages(by_query: DataFrame, mode: str) -> DataFrame:
    return by_query.groupBy(mode).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")])


def lower_p95(df: DataFrame, group: str, value: str, share: float = 0.95) -> DataFrame:
    """(group, n, p95): the sample at place int((n - 1) * share) of each group, negative ones as 0; no interpolation.

    Equal values are counted first, then a running count finds the place: no group is gathered into one array.
    """
    v = df.where(F.col(value).isNotNull()).select(group, F.greatest(F.col(value), F.lit(0.0)).alias("v")).groupBy(group, "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    run = v.withColumns({"upto": F.sum("c").over(w.orderBy("v")), "n": F.sum("c").over(w)})
    return run.where(F.col("upto") > F.floor((F.col("n") - 1) * share)).groupBy(group).agg(F.max("n").alias("n"), F.min("v").alias("p95"))


def last_samples(df: DataFrame, group: str, order: Column, n: int = 300) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order.desc())
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def by_mode(modes: dict[str, Callable[[], DataFrame]], labels: DataFrame, k: int = 5, query: str = "query_id", key: str = "key") -> DataFrame:
    """(mode, query, recall, mrr, ndcg) of every way to search, its lists cut to k; one that can't be planned counts as finding nothing."""
    out = None
    for name, find in modes.items():
        try:
            ranked = find().where(F.col("rank") <= k).select(query, key, "rank")
        except Exception:  # noqa: BLE001  one mode's failure is not the others'
            ranked = labels.select(query, key, F.lit(1).alias("rank")).limit(0)
        part = metrics(ranked, labels, k, query, key).select(F.lit(name).alias("mode"), query, "recall", "mrr", "ndcg")
        out = part if out is None else out.unionByName(part)
    return out


def overlap_rate(overlaps: Column, total: Column) -> Column:
    """Hidden nodes over visible ones, from 0 to 1; 0 without any."""
    return F.when(total > 0, F.greatest(F.lit(0), F.least(overlaps, total)) / total).otherwise(0.0)


#: The parts of the share of hidden nodes by layout and by relations, and its bounds.
LAYOUT_PART = {"cose": 0.045, "breadthfirst": 0.015}
OTHER_LAYOUT, RELATIONS_PART, PLAIN_PART = 0.03, 0.06, 0.015
NODES_AT_ONCE, FREE_DENSITY, DENSITY_STEP, EDGE_STEP, MOST_HIDDEN = 85.0, 0.35, 0.14, 0.08, 0.45


def readability(nodes: Column, edges: Column, layout: Column, relations: Column) -> Column:
    """(readable, hidden): an estimate of the nodes that can be read in a drawn graph."""
    part = F.when(layout == "cose", LAYOUT_PART["cose"]).when(layout == "breadthfirst", LAYOUT_PART["breadthfirst"]).otherwise(OTHER_LAYOUT)
    crowd = F.greatest(F.lit(0.0), (nodes / NODES_AT_ONCE - FREE_DENSITY) * DENSITY_STEP + edges / F.greatest(F.lit(1.0), nodes * 2.0) * EDGE_STEP + part + F.when(relations, RELATIONS_PART).otherwise(PLAIN_PART))
    hidden = F.when(nodes > 0, F.bround(nodes * F.least(F.lit(MOST_HIDDEN), crowd))).otherwise(0).cast("bigint")
    return F.struct((F.greatest(nodes, F.lit(0)) - hidden).cast("bigint").alias("readable"), hidden.alias("hidden"))
