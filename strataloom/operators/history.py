"""History of files and symbols over ordered snapshots."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evolutions(snapshots: DataFrame) -> DataFrame:
    """(repo_id, file_path, symbol_name, introduced_in, modified_in, deleted_in) of every symbol ever seen.

    ``snapshots(repo_id, file_path, seq, commit_hash, symbols array, symbol_hashes map)``, ordered by seq within a file.
    A symbol is modified where its hash differs from the last filled one before; it is deleted in the first snapshot
    after its last, if there is one. ``modified_in`` lists commits in order. Windows per symbol, not per file.
    """
    file = ["repo_id", "file_path"]
    w = Window.partitionBy(*file).orderBy("seq")
    base = snapshots.withColumn("next_commit", F.lead("commit_hash").over(w))
    s = base.select(*file, "seq", "commit_hash", "next_commit", F.explode(F.array_distinct("symbols")).alias("symbol_name"), "symbol_hashes")
    s = s.withColumn("hash", F.nullif(F.try_element_at("symbol_hashes", F.col("symbol_name")), F.lit(""))).drop("symbol_hashes")
    sym = Window.partitionBy(*file, "symbol_name").orderBy("seq")
    last = F.last("hash", ignorenulls=True).over(sym.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("changed", F.coalesce(F.col("hash") != last, F.lit(False)))
    changes = F.sort_array(F.collect_list(F.when(F.col("changed"), F.struct("seq", "commit_hash"))))
    return s.groupBy(*file, "symbol_name").agg(
        F.min_by("commit_hash", "seq").alias("introduced_in"),
        F.transform(changes, lambda x: x["commit_hash"]).alias("modified_in"),
        F.coalesce(F.max_by("next_commit", "seq"), F.lit("")).alias("deleted_in"),
    )


def symbol_diff(snapshots: DataFrame) -> DataFrame:
    """(repo_id, file_path, seq, added, removed): symbols that came and went since the snapshot before."""
    w = Window.partitionBy("repo_id", "file_path").orderBy("seq")
    before = F.coalesce(F.lag("symbols").over(w), F.array().cast("array<string>"))
    return snapshots.withColumn("__b", before).select(
        "repo_id", "file_path", "seq", F.array_sort(F.array_except("symbols", "__b")).alias("added"), F.array_sort(F.array_except("__b", "symbols")).alias("removed")
    )


def churn(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("repo_id", "file_path").agg(F.countDistinct("snapshot_id").alias("snapshots"))


def affected_symbols(evolution: DataFrame) -> DataFrame:
    """(repo_id, commit_hash, symbols): what each commit introduced, modified or deleted, sorted."""
    commits = F.array_distinct(F.concat(F.array("introduced_in", "deleted_in"), "modified_in"))
    long = evolution.select("repo_id", "symbol_name", F.explode(commits).alias("commit_hash")).where("commit_hash != ''")
    return long.groupBy("repo_id", "commit_hash").agg(F.array_sort(F.collect_set("symbol_name")).alias("symbols"))


def commit_records(commits: DataFrame, affected: DataFrame, summary: str | None = None) -> DataFrame:
    """Commits with their affected symbols and the hash of their summary, or of the message where there is none."""
    j = commits.join(affected, ["repo_id", "commit_hash"], "left")
    said = F.nullif(F.coalesce(summary, F.lit("")), F.lit("")) if summary else F.lit(None).cast("string")
    return j.withColumns(
        {
            "commit_id": F.concat_ws("::", "repo_id", "commit_hash"),
            "symbols": F.coalesce("symbols", F.array().cast("array<string>")),
            "content_hash": F.sha2(F.coalesce(said, F.col("message")), 256),
        }
    )


def unified_diffs(df: DataFrame, key: str, path: str, before: str, after: str) -> DataFrame:
    """(key, diff): the unified diff of every file's contents, Arrow batches at a time; a null content is a file that isn't there, equal ones give an empty diff."""
    kind = df.schema[key].dataType.simpleString()

    def one(name: str, old: str | None, new: str | None) -> str:
        names = ("/dev/null" if old is None else f"a/{name}", "/dev/null" if new is None else f"b/{name}")
        return "\n".join(difflib.unified_diff((old or "").splitlines(), (new or "").splitlines(), *names, lineterm=""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf["k"], "diff": [one(p, a, b) for p, a, b in zip(pdf["p"], pdf["a"], pdf["b"])]})

    return df.select(F.col(key).alias("k"), F.col(path).alias("p"), F.col(before).alias("a"), F.col(after).alias("b")).mapInPandas(run, f"{key} {kind}, diff string")


def first_line(answer: Column) -> Column:
    """The first filled line of an answer without outer quotes; empty where there is none."""
    line = F.regexp_extract(F.coalesce(answer, F.lit("")), r"([^\r\n]*\S[^\r\n]*)", 1)
    return F.trim(F.regexp_replace(F.trim(line), "^[\"'`]+|[\"'`]+$", ""))
