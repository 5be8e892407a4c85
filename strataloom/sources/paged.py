"""Sources that are read page by page: a Spark data source with a cursor and retries, and trees of blocks in reading order."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strataloom.operators import hierarchy
from strataloom.operators.skew import lookup

PAGE_SIZE, MOST_TRIES = 100, 5


class TooManyRequests(Exception):
    """The other side asks to wait so many seconds."""

    def __init__(self, seconds: float = 1.0):
        super().__init__(f"retry after {seconds} s")
        self.seconds = seconds


def with_retries(call: Callable[[], dict], tries: int = MOST_TRIES, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The answer of a call that may be told to wait; the last refusal is raised."""
    for left in range(tries - 1, -1, -1):
        try:
            return call()
        except TooManyRequests as refused:
            if not left:
                raise
            sleep(refused.seconds)
    raise ValueError("no try allowed")


def http_page(url: str, token: str, cursor: str | None) -> dict:
    """One page of a remote listing: a JSON object with results, has_more and next_cursor."""
    body = json.dumps({"page_size": PAGE_SIZE, **({"start_cursor": cursor} if cursor else {})}).encode()
    ask = urllib.request.Request(url, body, {"Authorization": f"Bearer {token}", "Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(ask) as got:
            return json.load(got)
    except urllib.error.HTTPError as e:
        if e.code == 429:
            raise TooManyRequests(float(e.headers.get("Retry-After", 1))) from e
        raise


def folder_page(folder: str, cursor: str | None) -> dict:
    """The same from files: a page's file is named by its cursor, the first one ``start.json``."""
    with open(os.path.join(folder, f"{cursor or 'start'}.json"), encoding="utf-8") as f:
        return json.load(f)


def pages(fetch: Callable[[str | None], dict], cursor: str | None = None, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[str | None, list]]:
    """(cursor, results) of every page from a cursor on; a page that has no next cursor is the last."""
    while True:
        got = with_retries(lambda c=cursor: fetch(c), sleep=sleep)
        yield cursor, got.get("results") or []
        if not got.get("has_more") or not got.get("next_cursor"):
            return
        cursor = got["next_cursor"]


class PagedSource(DataSource):
    """``spark.read.format("paged")``: (source, cursor, position, raw), a row a result, raw as JSON.

    Options: ``paths``, folders or URLs separated by blanks, read side by side, one task each; ``start_cursor`` resumes;
    ``token`` authorises URLs. Pages of one listing follow from each other, so a listing is one task.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "source string, cursor string, position bigint, raw string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.options.get("paths", "").split()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        where = partition.value
        remote = where.startswith(("http://", "https://"))
        fetch = (lambda c: http_page(where, self.options.get("token", ""), c)) if remote else (lambda c: folder_page(where, c))
        for cursor, results in pages(fetch, self.options.get("start_cursor") or self.options.get("startcursor")):
            for i, r in enumerate(results):
                yield where, cursor, i, json.dumps(r, ensure_ascii=False)


def tree_order(blocks: DataFrame, page: str, key: str, parent: str, position: str) -> DataFrame:
    """``blocks`` with ``depth`` and ``place``, their number from 0 in a depth-first walk of their page.

    Children follow their parent by position, then key. Blocks under a missing parent are tops; those of cycles are tops as well.
    """
    b = blocks.withColumn("__id", F.concat_ws("::", page, key)).withColumn("__up", F.concat_ws("::", page, parent))
    lines = hierarchy.paths(hierarchy.resolve_parents(b.withColumn("__up", F.when(F.col(parent).isNotNull(), F.col("__up"))), "__id", "__up"))
    step = b.select(F.col("__id").alias("a"), F.struct(F.col(position).alias("p"), F.col(key).alias("k")).alias("s"))
    each = lookup(lines.select(F.col("id").alias("__id"), F.posexplode("path").alias("d", "a")), step, "a", "__id")
    way = each.groupBy("__id").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "s"))), lambda x: x["s"]).alias("__way"))
    w = Window.partitionBy(page).orderBy("__way")
    out = b.join(way, "__id").withColumn("depth", (F.size("__way") - 1).cast("bigint")).withColumn("place", (F.row_number().over(w) - 1).cast("bigint"))
    return out.drop("__id", "__up", "__way")
