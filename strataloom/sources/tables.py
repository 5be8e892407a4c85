"""Parquet tables of a data directory, and the state of a key that is in force."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """``directory/name.parquet``; timestamps without zone are read as UTC wall time."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def in_force(df: DataFrame, key: str, stamp: str, columns: Sequence[str]) -> DataFrame:
    """One row per ``key``: the one with the greatest ``stamp``; a null stamp loses.

    Rows with a null key are dropped, since they belong to no record. Only ``columns``
    are read and moved. The aggregate combines before the shuffle, so a key that
    was sent very often does not make a large partition.
    """
    rest = [c for c in dict.fromkeys(columns) if c != key]
    order = F.coalesce(F.unix_micros(F.col(f"`{stamp}`").cast("timestamp")), F.lit(-(2**62)))
    picked = (
        df.where(F.col(f"`{key}`").isNotNull())
        .select(F.col(f"`{key}`").alias("__k"), order.alias("__o"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__r"))
        .groupBy("__k")
        .agg(F.max_by("__r", "__o").alias("__r"))
    )
    return picked.select(F.col("__k").alias(key), *[F.col(f"__r.`{c}`").alias(c) for c in rest])


def pages_in_force(spark: SparkSession, directory: str, *columns: str) -> DataFrame:
    return in_force(table(spark, directory, "pages"), "id", "updated_time", columns)


def chunks_in_force(spark: SparkSession, directory: str, *columns: str) -> DataFrame:
    return in_force(table(spark, directory, "chunks"), "chunk_uid", "indexed_at", columns)
