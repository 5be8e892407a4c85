"""Listings and facets of a collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import list_of


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """(value): filled values, each once."""
    return df.select(F.trim(F.col(column).cast("string")).alias("value")).where("value != ''").distinct()


def list_values(df: DataFrame, column: str) -> DataFrame:
    """(value, n): values of a comma-separated column and the rows that hold them."""
    return df.select(F.explode(F.array_distinct(list_of(F.col(column)))).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def titles(df: DataFrame, doc: str, title: str, order: str) -> DataFrame:
    """(doc, title): the first filled title of each document, its id where there is none."""
    filled = F.nullif(F.trim(F.coalesce(title, F.lit(""))), F.lit(""))
    first = df.where(F.col(doc).isNotNull()).groupBy(doc).agg(F.min_by(filled, F.when(filled.isNotNull(), F.struct(order, filled.alias("t")))).alias("title"))
    return first.withColumn("title", F.coalesce("title", F.col(doc).cast("string")))


def doc_info(df: DataFrame, doc: str, order: str, fields: Sequence[str]) -> DataFrame:
    """(doc, n_chunks, fields): number of chunks and the fields of the first one."""
    return df.groupBy(doc).agg(F.count("*").alias("n_chunks"), F.min_by(F.struct(*fields), order).alias("x")).select(doc, "n_chunks", *[F.col(f"x.{f}") for f in fields])


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def browse(df: DataFrame, key: str, text: str, keep: Column | None = None, limit: int = 500) -> DataFrame:
    """The first ``limit`` rows by key that are kept and have text."""
    rows = df.where(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0)
    return (rows.where(keep) if keep is not None else rows).orderBy(key).limit(limit)


def browse_first(tables: Sequence[DataFrame], keep: Column, order: str, limit: int, after: Column | None = None) -> DataFrame:
    """Rows of the first table that has any; ``after`` filters what the limit left."""
    out = None
    for i, df in enumerate(tables):
        part = df.where(keep).withColumn("__p", F.lit(i))
        out = part if out is None else out.unionByName(part)
    first = out.join(F.broadcast(out.agg(F.min("__p").alias("__m"))), F.col("__p") == F.col("__m"))
    rows = first.drop("__p", "__m").orderBy(order).limit(limit)
    return rows.where(after) if after is not None else rows


def page_of(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """The rows of a page of a listing, numbered from 0."""
    return df.orderBy(*order).offset(page * size).limit(size)
