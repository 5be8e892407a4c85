"""Streams of turns, events and pages: the stateful operators of memory and synchronisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataloom.operators import chunking, index


def table_stream(spark: SparkSession, path: str, schema_of: DataFrame, files_per_trigger: int = 1000, latest_first: bool = False) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema_of.schema).option("maxFilesPerTrigger", files_per_trigger).option("latestFirst", latest_first).parquet(path)


def _round(x: float) -> float:
    """To four digits, halves up, as the batch query rounds."""
    return float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def interest_stream(seen: DataFrame, topic: str, time: str) -> DataFrame:
    """(topic, n, weight): each topic's interest after every micro-batch, kept as state; emits changed topics.

    The fold depends on the number of occurrences only, so the order within a batch and late rows don't matter.
    """
    kind = seen.schema[topic].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, weight = state.get if state.exists else (0, 0.0)
        before = n
        n += sum(map(len, batches))
        for _ in range(before, min(n, 400)):  # the fixed point lies well before
            weight = _round(weight * 0.9 + 1)
        state.update((n, weight))
        yield pd.DataFrame({topic: [key[0]], "n": [n], "weight": [weight]})

    return (
        seen.select(topic, time)
        .groupBy(topic)
        .applyInPandasWithState(step, f"{topic} {kind}, n bigint, weight double", "n bigint, weight double", "update", GroupStateTimeout.NoTimeout)
    )


def timeline_stream(events: DataFrame, time: str, late: str = "400 days") -> DataFrame:
    """(date, n): turns a day, updated as rows come; a day accepts rows as late as the watermark."""
    days = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w")).agg(F.count("*").alias("n"))
    return days.select(F.to_date("w.start").alias("date"), "n")


def session_stream(turns: DataFrame, session: str, order: str, topics: str, most: int = 10) -> DataFrame:
    """(session, n, topics): each session's rolling topics, latest first, one of each lower-cased form."""
    kind = turns.schema[session].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, held = state.get if state.exists else (0, [])
        held = list(held)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        for new in rows[topics]:
            n += 1
            merged: dict[str, str] = {}
            for t in [*(new if new is not None else []), *held]:
                if t and t.strip():
                    merged.setdefault(t.strip().lower(), t)
            held = list(merged.values())[:most]
        state.update((n, held))
        yield pd.DataFrame({session: [key[0]], "n": [n], "topics": [held]})

    return (
        turns.select(session, order, topics)
        .groupBy(session)
        .applyInPandasWithState(step, f"{session} {kind}, n bigint, topics array<string>", "n bigint, topics array<string>", "update", GroupStateTimeout.NoTimeout)
    )


def sync_pages(pages: DataFrame, store: index.Store, name: str, checkpoint: str, key: str = "id", stamp: str = "updated_time", hash_col: str = "content_hash") -> StreamingQuery:
    """Upserts of a stream of pages into a table: within a batch the latest state of a page, skipped where its hash is known.

    The checkpoint is the cursor. A batch that is replayed changes nothing, as its hashes are then known.
    """

    def write(batch: DataFrame, _: int) -> None:
        new = index.latest(batch, [key], [F.desc_nulls_last(stamp), F.desc(hash_col)])
        if store.exists(name):
            old = store.read(name).select(F.col(key).alias("__k"), F.col(stamp).alias("__s"))
            older = new.join(old, F.col(key) == F.col("__k"), "left").where(F.col("__s").isNotNull() & (F.col(stamp) < F.col("__s")))
            new = new.join(older.select(key), key, "left_anti")
        store.sync(name, new, key, hash_col)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed_pages(pages: DataFrame, store: index.Store, name: str, checkpoint: str, embed: Callable[[Column], Column], key: str = "id", text: str = "content") -> StreamingQuery:
    """The second stage of a synchronisation: the pages of each micro-batch as embedded chunks in a table, unchanged ones skipped.

    Each batch adds a row (batch, pages, status, added, modified, skipped) to the table ``name``_stats; a batch that fails is noted
    there as failed and doesn't stop the next.
    """

    def write(batch: DataFrame, number: int) -> None:
        n, got, status = batch.count(), {}, "ok"
        try:
            parts = chunking.recursive(batch, key, text)
            rows = parts.select(F.concat_ws("::", F.col(key).cast("string"), F.col("chunk_id").cast("string")).alias("id"), F.col(key).alias("page_id"), "chunk_id", "content")
            got = store.sync(name, rows.withColumns({"content_hash": F.sha2("content", 256), "embedding": embed(F.col("content"))}), "id", "content_hash")
        except Exception as problem:  # noqa: BLE001  one batch's failure is not the others'
            status = f"failed: {problem}"[:200]
        line = batch.sparkSession.createDataFrame([(number, n, status, *(got.get(k, 0) for k in ("added", "modified", "skipped")))], "batch bigint, pages bigint, status string, added bigint, modified bigint, skipped bigint")
        stats = f"{name}_stats"
        store.replace(stats, index.upsert(store.read(stats), line, "batch") if store.exists(stats) else line)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fan_out(turns: DataFrame, checkpoint: str, **sinks: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Each micro-batch of turns to every sink; a sink that fails is reported and doesn't stop the others."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for name, sink in sinks.items():
                try:
                    sink(kept, number)
                except Exception as problem:  # noqa: BLE001  one step's failure is not the others'
                    print(f"batch {number}, {name}: {problem}")
        finally:
            kept.unpersist()

    return turns.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collected(stream: DataFrame, folder: str, mode: str = "update") -> DataFrame:
    """All rows a stream gives until its input is used up, from Parquet files: a folder a micro-batch, written again if it is replayed."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
