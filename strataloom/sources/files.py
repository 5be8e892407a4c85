"""Files as tables: texts, repositories, exported histories and page exports."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions import text as X

#: Folders a scan leaves out.
EXCLUDED = (
    ".git",
    ".hg",
    ".svn",
    "__pycache__",
    ".pytest_cache",
    ".mypy_cache",
    ".ruff_cache",
    "node_modules",
    ".npm",
    ".yarn",
    "venv",
    ".venv",
    "env",
    ".env",
    "build",
    "dist",
    "target",
    ".eggs",
    "*.egg-info",
    ".tox",
    ".nox",
    "htmlcov",
    ".coverage",
    ".idea",
    ".vscode",
)
MOST_HASHED = 10 * 1024 * 1024


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, content): a row a file, in UTF-8."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("content"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(source, document_type, content) of text and Markdown files; other types raise, PDFs need their text beside them."""
    df = texts(spark, path)
    kind = X.document_type(F.col("source"))
    known = F.lower(F.col("source")).rlike(r"\.(txt|text|md|markdown|rst|log|csv|json)$")
    checked = F.when(known, kind).otherwise(F.raise_error(F.concat(F.lit("no reader for "), F.col("source"))).cast("string"))
    return df.select("source", checked.alias("document_type"), "content")


def gitignore(lines: Sequence[str], base: str = "") -> str:
    """A regular expression of the paths that lines of a .gitignore match; negations are not followed."""
    parts = []
    for line in lines:
        p = line.rstrip("\n").strip()
        if not p or p.startswith(("#", "!")):
            continue
        folder, anchored = p.endswith("/"), "/" in p.rstrip("/")
        body = fnmatch.translate(p.strip("/")).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z").replace(".*", "[^/]*")
        body = body.replace("[^/]*[^/]*/", "(?:.*/)?").replace("[^/]*[^/]*", ".*")
        parts.append(("^" if anchored else "(?:^|.*/)") + re.escape(base) + body + ("/.*" if folder else "(?:/.*)?") + "$")
    return "|".join(f"(?:{p})" for p in parts)


def ignore_lines(spark: SparkSession, root: str) -> list[str]:
    """Lines of the .gitignore of a folder; none where it has none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/.gitignore")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return []
    return [r["value"] for r in spark.read.text(p.toString()).collect()]  # one small file


def read_ini(path: str) -> dict[str, dict[str, str]]:
    """Sections and their values of an INI file, read on the driver."""
    import configparser

    parser = configparser.ConfigParser()
    with open(path, encoding="utf-8") as f:
        parser.read_file(f)
    return {name: dict(parser[name]) for name in parser.sections()}


def branch(root: str) -> str:
    """The branch a checked-out folder is on, from its HEAD; empty for a detached one and for other folders."""
    import os

    try:
        with open(os.path.join(root, ".git", "HEAD"), encoding="utf-8") as f:
            head = f.read().strip()
    except OSError:
        return ""
    return head.removeprefix("ref: refs/heads/") if head.startswith("ref: ") else ""


def repository(spark: SparkSession, root: str, repo_id: str, branch: str = "", ignore: Sequence[str] = ()) -> DataFrame:
    """(repo_id, branch, file_path, language, size, is_test, is_generated, content_hash, mtime, source) of a folder's files.

    Files over MOST_HASHED bytes have an empty hash and no source; excluded and ignored ones are left out.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.escape(root.rstrip("/").removeprefix("file:").removeprefix("//"))
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), f"^{base}/", "")
    df = df.withColumn("file_path", rel)
    dirs = "|".join(re.escape(d).replace(r"\*", "[^/]*") for d in EXCLUDED)
    df = df.where(~F.col("file_path").rlike(rf"(^|/)({dirs})/"))
    if ignore:
        df = df.where(~F.col("file_path").rlike(gitignore(ignore)))
    small = F.col("length") <= MOST_HASHED
    return df.select(
        F.lit(repo_id).alias("repo_id"),
        F.lit(branch).alias("branch"),
        "file_path",
        X.path_language(F.col("file_path")).alias("language"),
        F.col("length").alias("size"),
        X.is_test_path(F.col("file_path")).alias("is_test"),
        X.is_generated_path(F.col("file_path")).alias("is_generated"),
        F.when(small, F.sha2("content", 256)).otherwise("").alias("content_hash"),
        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("mtime"),
        F.when(small, F.decode("content", "UTF-8")).alias("source"),
    )


def commits(spark: SparkSession, path: str, file_path: str | None = None, since: str | None = None, most: int | None = None) -> DataFrame:
    """(repo_id, commit_hash, author, date, message, files_changed) of an exported log in JSON lines, newest first."""
    df = spark.read.schema("repo_id string, commit_hash string, author string, date string, message string, files_changed array<string>").json(path)
    if file_path:
        df = df.where(F.array_contains("files_changed", file_path))
    if since:
        df = df.where(F.col("date") >= since)
    df = df.orderBy(F.desc("date"), "commit_hash")
    return df.limit(most) if most else df


def head(commits_: DataFrame) -> DataFrame:
    return commits_.groupBy("repo_id").agg(F.max_by("commit_hash", F.struct("date", "commit_hash")).alias("commit_hash"))


def snapshots(commits_: DataFrame, contents: DataFrame, suffix: str = ".py") -> DataFrame:
    """(snapshot_id, repo_id, commit_hash, file_path, content_hash, source): contents of the changed files at each commit."""
    changed = commits_.select("repo_id", "commit_hash", F.explode("files_changed").alias("file_path")).where(F.col("file_path").endswith(suffix))
    j = changed.join(contents.select("repo_id", "commit_hash", "file_path", "source"), ["repo_id", "commit_hash", "file_path"])
    return j.select(X.composite_id(F.col("repo_id"), F.col("commit_hash"), F.col("file_path")).alias("snapshot_id"), "repo_id", "commit_hash", "file_path", F.sha2("source", 256).alias("content_hash"), "source")


RICH = "array<struct<plain_text:string>>"


def plain_text(rich: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(rich, lambda r: r["plain_text"]), ""), F.lit(""))


def raw_pages(df: DataFrame, raw: str, workspace: str) -> DataFrame:
    """Page rows of raw page JSON: title property, multi-select tags, times."""
    prop = f"struct<type:string,title:{RICH},multi_select:array<struct<name:string>>>"
    schema = f"struct<id:string,url:string,created_time:string,last_edited_time:string,parent:struct<page_id:string>,properties:map<string,{prop}>>"
    p = df.select(F.from_json(raw, schema).alias("p"), F.col(workspace).alias("workspace_id"))
    props = F.coalesce(F.map_values("p.properties"), F.array().cast(f"array<{prop}>"))
    title = F.try_element_at(F.filter(props, lambda x: x["type"] == "title"), F.lit(1))["title"]
    tags = F.flatten(F.transform(F.filter(props, lambda x: x["type"] == "multi_select"), lambda x: F.transform(x["multi_select"], lambda o: o["name"])))
    return p.select(
        F.col("p.id").alias("id"), "workspace_id", plain_text(title).alias("title"), F.col("p.url").alias("source_url"), F.lit("notion").alias("document_type"), tags.alias("tags"),
        F.col("p.parent.page_id").alias("parent_page_id"), F.to_timestamp("p.created_time").alias("created_time"), F.to_timestamp("p.last_edited_time").alias("updated_time"),
    )


#: Block types whose text is rich text of their own type.
BLOCK_TYPES = "paragraph heading_1 heading_2 heading_3 bulleted_list_item numbered_list_item to_do toggle quote callout code".split()


def raw_blocks(df: DataFrame, page: str, raw: str) -> DataFrame:
    """(page, order, id, block_type, content): blocks of a JSON array in order; unknown types are ``unsupported`` without content."""
    body = f"struct<rich_text:{RICH},cells:array<{RICH}>>"
    fields = ",".join(f"{t}:{body}" for t in [*BLOCK_TYPES, "table_row"])
    b = df.select(page, F.posexplode(F.from_json(raw, f"array<struct<id:string,type:string,{fields}>>")).alias("order", "b"))
    content = F.lit("")
    for t in BLOCK_TYPES:
        content = F.when(F.col("b.type") == t, plain_text(F.col(f"b.{t}.rich_text"))).otherwise(content)
    cells = F.array_join(F.transform(F.col("b.table_row.cells"), plain_text), " | ")
    content = F.when(F.col("b.type") == "table_row", cells).otherwise(content)
    kind = F.when(F.col("b.type").isin(BLOCK_TYPES + ["table_row", "divider", "image", "bookmark"]), F.col("b.type")).otherwise("unsupported")
    return b.select(page, F.col("order").cast("bigint").alias("order"), F.col("b.id").alias("id"), kind.alias("block_type"), content.alias("content"))


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, level, item): labels of an evaluation set in YAML or JSON, read on the driver."""
    import json

    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            data = yaml.safe_load(f)
        else:
            data = json.load(f)
    rows = []
    for i, q in enumerate(data["queries"] if isinstance(data, dict) else data):
        for level, name in (("chunk", "relevant_chunks"), ("doc", "relevant_docs")):
            rows += [(i, q["query"], level, str(x)) for x in q.get(name) or []]
    return spark.createDataFrame(rows, "query_id bigint, query string, level string, item string")


def number(df: DataFrame, group: str, order: Sequence[str], name: str = "chunk_id") -> DataFrame:
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("bigint"))
