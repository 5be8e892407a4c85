"""Point lookups, listings and small roll-ups of symbols, edges, snapshots, pages and stored chunks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as X
from strataloom.operators.index import latest

#: Kinds of blocks that are headings, and those that carry text of their own.
HEADINGS = ("heading_1", "heading_2", "heading_3")
TEXT_BEARING = (*HEADINGS, "paragraph", "bulleted_list_item", "numbered_list_item", "to_do", "toggle", "quote", "callout", "code", "table_row")
#: Events that a graph view may send.
GRAPH_EVENTS = ("node_click", "edge_click", "canvas_click", "expand_neighbors", "focus_node")


def by_values(df: DataFrame, **wanted: Any) -> DataFrame:
    """Rows that have every given value: a list means one of its values, None and an empty string don't restrict."""
    for name, value in wanted.items():
        if isinstance(value, (list, tuple, set)):
            df = df.where(F.col(name).isin(list(value)))
        elif value is not None and value != "":
            df = df.where(F.col(name) == value)
    return df


def by_ids(df: DataFrame, key: str, ids: DataFrame | Sequence[Any]) -> DataFrame:
    """Rows with the given ids: those of a short list reach the scan, those of a table meet in a semi-join."""
    return df.join(ids.select(key), key, "left_semi") if isinstance(ids, DataFrame) else df.where(F.col(key).isin(list(ids)))


def find_symbols(symbols: DataFrame, name: str, exact: bool = False) -> DataFrame:
    """Symbols of a name: equal to it, or holding it in any case."""
    col = F.col("symbol_name")
    return symbols.where(col == name if exact else F.lower(col).contains(name.lower()))


def children_of(symbols: DataFrame, symbol_id: str | None = None) -> DataFrame:
    """Symbols below one, or with None all that have a parent."""
    return symbols.where(F.col("parent_symbol") == symbol_id if symbol_id is not None else F.coalesce("parent_symbol", F.lit("")) != "")


def by_language(files: DataFrame, language: str) -> DataFrame:
    return files.where(F.lower("language") == language.lower())


def is_test(path: Column, flag: Column | None = None) -> Column:
    """Whether a row is of a test: by its flag or by its path."""
    found = X.is_test_path(path)
    return found if flag is None else F.coalesce(flag, F.lit(False)) | found


def code_blocks(blocks: DataFrame, repo_id: str = "", file_path: str = "", text: str = "", limit: int = 500) -> DataFrame:
    """Blocks of a repository and file whose content, name, path, kind or repository holds a text in any case; the first by id."""
    df = by_values(blocks, repo_id=repo_id, file_path=file_path)
    if text:
        df = df.where(reduce(lambda a, b: a | b, [F.lower(X.text_of(F.col(c))).contains(text.lower()) for c in ("content", "name", "file_path", "chunk_type", "repo_id")]))
    return df.orderBy("chunk_id").limit(limit)


def alive(evolutions: DataFrame) -> DataFrame:
    """Symbols that no commit deleted."""
    return evolutions.where(F.coalesce("deleted_in", F.lit("")) == "")


def snapshot_history(snapshots: DataFrame, order: str, file_path: str | None = None) -> DataFrame:
    """Snapshots with their position in their file's history, from 0; of one file or of all."""
    df = by_values(snapshots, file_path=file_path)
    w = Window.partitionBy("file_path").orderBy(order, "snapshot_id")
    return df.withColumn("position", (F.row_number().over(w) - 1).cast("bigint"))


def merge_stores(first: DataFrame, *others: DataFrame, key: str) -> DataFrame:
    """Rows of all tables by key; of a key in several the last table's counts."""
    every = reduce(DataFrame.unionByName, [df.withColumn("__t", F.lit(i)) for i, df in enumerate((first, *others))])
    return latest(every, [key], [F.desc("__t")]).drop("__t")


def distinct_over(tables: Mapping[str, DataFrame], column: str) -> DataFrame:
    """(value): filled values of a column over several tables, each once."""
    parts = [df.select(F.trim(F.col(column)).alias("value")).where("value != ''").distinct() for df in tables.values()]
    return reduce(DataFrame.unionByName, parts).distinct()


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def page_count(df: DataFrame, size: int) -> DataFrame:
    """One row (n, pages): rows of a listing and the pages they fill; an empty one has no page."""
    return df.agg(F.count("*").alias("n")).select("n", F.ceil(F.col("n") / size).cast("bigint").alias("pages"))


def listing(df: DataFrame, group: str, order: Sequence[Column], size: int) -> DataFrame:
    """Rows with their place within their group from 1 and the page of it from 0."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w).cast("bigint")).withColumn("page", F.floor((F.col("place") - 1) / size).cast("bigint"))


def rate(events: DataFrame, who: str, time: str, seconds: int = 60) -> DataFrame:
    """Events with ``recent``, the number of events of the same ``who`` in the seconds up to each, itself and equal times included."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(who).orderBy(us).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(w))


def artifact(chunks: DataFrame, key: str) -> DataFrame:
    """(key, summary, keywords, questions, entities, importance): what extraction stored, lists as arrays, missing columns empty."""
    have = set(chunks.columns)
    text = lambda c: X.text_of(F.col(c)) if c in have else F.lit("")
    lists = [X.list_of(text(f"ka_{c}")).alias(c) for c in ("keywords", "questions", "entities")]
    return chunks.select(key, text("ka_summary").alias("summary"), *lists, text("ka_importance").alias("importance"))


def metadata(chunks: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Stored fields under their canonical names as strings: times in ISO form, null as the empty string."""
    kinds = dict(chunks.dtypes)
    show = lambda c: X.iso(F.col(c)) if kinds[c].startswith("timestamp") else F.col(c).cast("string")
    return chunks.select(*[F.coalesce(show(c), F.lit("")).alias(name) for name, c in fields.items()])


def is_heading(block_type: Column) -> Column:
    return F.coalesce(block_type.isin(list(HEADINGS)), F.lit(False))


def is_text_bearing(block_type: Column) -> Column:
    return F.coalesce(block_type.isin(list(TEXT_BEARING)), F.lit(False))


def normalized_events(events: DataFrame, event: str, strict: bool = True, allowed: Sequence[str] = GRAPH_EVENTS) -> DataFrame:
    """Events with trimmed kinds; one that isn't allowed raises, or with ``strict`` off is left out."""
    kind = F.trim(X.text_of(F.col(event)))
    ok = kind.isin(list(allowed))
    if not strict:
        return events.withColumn(event, kind).where(ok)
    return events.withColumn(event, F.when(ok, kind).otherwise(F.raise_error(F.concat(F.lit("unsupported event: "), kind)).cast("string")))
