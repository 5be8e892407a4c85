"""Joins with a unique side whose other side may hold a third of all rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 50_000  # rows of one key that one task takes
MOST_HOT = 1_000  # keys that are spread; any other holds less than a thousandth of all rows


def lookup(left: DataFrame, right: DataFrame, key: str, by: str, hot_rows: int = HOT_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined with the one row ``right`` has of each ``key``; rows without one, or with a null key, disappear.

    The counts of keys combine before their shuffle. The rows of a key that has more than ``hot_rows`` are dealt by the
    hash of ``by`` to as many tasks as that takes, and its one row of ``right`` goes to each of these; the rows
    added to ``right`` are fewer than those of ``left`` by the factor ``hot_rows``, but for MOST_HOT. ``counts(key, n)`` saves
    counting where the numbers are known.
    """
    left = left.where(F.col(key).isNotNull())
    known = left.groupBy(key).agg(F.count("*").alias("__n")) if counts is None else counts.select(key, F.col("n").alias("__n"))
    hot = known.where(F.col("__n") > hot_rows).orderBy(F.desc("__n"), key).limit(MOST_HOT).select(key, F.ceil(F.col("__n") / hot_rows).cast("int").alias("__s")).collect()
    if not hot:
        return left.join(right.hint("merge"), key)
    split = F.broadcast(left.sparkSession.createDataFrame(hot, left.select(key, F.lit(1).alias("__s")).schema))  # at most MOST_HOT rows
    parts = F.coalesce("__s", F.lit(1))
    dealt = left.join(split, key, "left").withColumn("__p", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__s")
    each = right.join(split, key, "left").withColumn("__p", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__s")
    return dealt.join(each.hint("merge"), [key, "__p"]).drop("__p")
