"""Incremental indexing: diffs by content hash, upserts, appends, deletes; tables as Parquet with atomic replacement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.session import cut


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def diff(existing: DataFrame, incoming: DataFrame, key: str, hash_col: str) -> DataFrame:
    """(key, old_hash, new_hash, change): added, modified, skipped or deleted; both sides have one row per key.

    A null or empty hash differs from every filled one. Both sides shuffle once, by key.
    """
    old = existing.select(F.col(key).alias(key), F.coalesce(hash_col, F.lit("")).alias("old_hash"), F.lit(True).alias("__o"))
    new = incoming.select(F.col(key).alias(key), F.coalesce(hash_col, F.lit("")).alias("new_hash"), F.lit(True).alias("__n"))
    change = (
        F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "deleted").when(F.col("old_hash") == F.col("new_hash"), "skipped").otherwise("modified")
    )
    return old.join(new, key, "full_outer").select(key, "old_hash", "new_hash", change.alias("change"))


def change_counts(changes: DataFrame) -> DataFrame:
    """One row with the number of keys of each kind of change."""
    return changes.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "skipped", "deleted")])


def upsert(existing: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str] | None = None, prune: bool = False, guard_empty: bool = True) -> DataFrame:
    """``existing`` after an upsert by key: new rows added, ``columns`` of known ones replaced, all by default.

    With ``prune``, keys that aren't incoming disappear, unless nothing is incoming and ``guard_empty``.
    """
    names = existing.columns
    taken = set(columns or [c for c in names if c != key])
    if prune and guard_empty and incoming.isEmpty():
        return existing
    o, n = existing.withColumn("__o", F.lit(True)).alias("o"), incoming.withColumn("__n", F.lit(True)).alias("n")
    j = o.join(n, key, "right" if prune else "full_outer")
    out = []
    for c in names:
        if c == key:
            out.append(F.col(key))
        elif c in taken:
            out.append(F.when(F.col("n.__n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.when(F.col("o.__o"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return j.select(*out)


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``existing`` and the incoming rows of keys it hasn't, one row per key."""
    return existing.unionByName(incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti"))


def merge_fields(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Fields of ``changes`` put over those of ``table`` where they are not null; the rest is untouched."""
    named = [c for c in changes.columns if c != key]
    j = table.alias("t").join(changes.alias("c"), key, "left")
    return j.select(key, *[F.coalesce(f"c.{c}", f"t.{c}").alias(c) if c in named else F.col(f"t.{c}") for c in table.columns if c != key])


def delete(table: DataFrame, condition: Column) -> DataFrame:
    return table.where(~F.coalesce(condition, F.lit(False)))


def append_versions(versions: DataFrame, incoming: DataFrame, page: str = "page_id", order: str = "created_at") -> DataFrame:
    """``incoming`` rows numbered on from each page's highest version; a hash equal to the page's last is left out.

    Both have (page, content_hash, order); ``versions`` has ``version`` too.
    """
    last = versions.groupBy(page).agg(F.max("version").alias("top"), F.max_by("content_hash", "version").alias("last"))
    fresh = incoming.join(last, page, "left")
    w = Window.partitionBy(page).orderBy(order, "content_hash")
    before = F.coalesce(F.lag("content_hash").over(w), F.col("last"))
    changed = fresh.withColumn("__before", before).where(F.col("__before").isNull() | (F.col("__before") != F.col("content_hash")))
    return changed.withColumn("version", (F.coalesce("top", F.lit(0)) + F.row_number().over(w)).cast("bigint")).drop("__before", "top", "last")


def block_hash(blocks: DataFrame, page: str, order: str, content: str) -> DataFrame:
    """(page, content_hash): SHA-256 of the page's blocks one after another."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(content, F.lit("")).alias("c")))), lambda x: x["c"]), "")
    return blocks.groupBy(page).agg(F.sha2(joined, 256).alias("content_hash"))


class Store:
    """Tables of a folder: read, replaced as a whole or by partition, never in place.

    A replacement is written beside the table and then takes its name, so readers see the old or the
    new table and a failed write leaves the old one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(self.path(name))
        return fs.exists(p)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def replace(self, name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> None:
        new, old = self.path(name) + "__new", self.path(name) + "__old"
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(new)
        fs, p = self._fs(self.path(name))
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path
        fs.delete(jpath(old), True)
        if fs.exists(p):
            fs.rename(p, jpath(old))
        fs.rename(jpath(new), p)
        fs.delete(jpath(old), True)

    def sync(self, name: str, incoming: DataFrame, key: str, hash_col: str, prune: bool = False) -> dict[str, int]:
        """Upsert by content hash; the numbers of each kind of change. Rows whose hash is known stay as they are."""
        if not self.exists(name):
            self.replace(name, incoming.dropDuplicates([key]))
            return {"added": self.read(name).count(), "modified": 0, "skipped": 0, "deleted": 0}
        old = self.read(name)
        changes = cut(diff(old, incoming, key, hash_col).select(key, "change"))
        counts = change_counts(changes).first().asDict()
        kept = ["skipped", "deleted"]
        if prune and not incoming.isEmpty():
            kept.remove("deleted")
        else:
            counts["deleted"] = 0
        if counts["added"] or counts["modified"] or counts["deleted"]:
            own = lambda df, kinds: df.join(changes.where(F.col("change").isin(kinds)).select(key), key, "left_semi").select(*old.columns)
            self.replace(name, own(old, kept).unionByName(own(incoming, ["added", "modified"])))
        return counts

    def delete(self, name: str, condition: Column) -> int:
        """Rows dropped; the table stays as it is when there are none."""
        if not self.exists(name):
            return 0
        df = self.read(name)
        n = df.where(condition).count()
        if n:
            self.replace(name, delete(df, condition))
        return n


def add_stats(*stats: Mapping[str, int]) -> dict[str, int]:
    out: dict[str, int] = {}
    for s in stats:
        for k, v in s.items():
            out[k] = out.get(k, 0) + v
    return out
