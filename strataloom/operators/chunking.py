"""Texts into chunks: fixed separators, headings, sentences, blocks of pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Separators tried in turn, for plain text and within sections.
PLAIN = ["\n\n", "\n", " ", ""]
SENTENCES = ["\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", ""]
#: Limits of a section of blocks and of the parts it is split into.
SECTION_CHARS, PART_CHARS = 1200, 600
HEADINGS = ["heading_1", "heading_2", "heading_3"]
LISTS = ["bulleted_list_item", "numbered_list_item", "to_do"]
TEXTS = ["paragraph", "quote", "callout", "toggle", "code", *LISTS]


def split_text(text: str, size: int, overlap: int, separators: Sequence[str] = PLAIN) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that occurs, smaller ones within too long parts.

    A piece starts with as many whole parts of the end of the one before as fit into ``overlap``.
    """
    sep, rest = next(((s, separators[i + 1 :]) for i, s in enumerate(separators) if s == "" or s in text), ("", []))
    parts = list(text) if sep == "" else [p if i == 0 else sep + p for i, p in enumerate(text.split(sep))]
    out: list[str] = []
    held: list[str] = []
    total = 0

    def flush() -> None:
        piece = "".join(held).strip()
        if piece:
            out.append(piece)

    for p in parts:
        if len(p) > size and rest:
            if held:
                flush()
                held, total = [], 0
            out.extend(split_text(p, size, overlap, rest))
            continue
        if total + len(p) > size and held:
            flush()
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    if held:
        flush()
    return out


def recursive(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 100, separators: Sequence[str] = PLAIN) -> DataFrame:
    """(key, chunk_id, content): pieces of every text, numbered from 0."""
    kind = df.schema[key].dataType.simpleString()
    seps = list(separators)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, c) for k, t in zip(pdf["k"], pdf["t"]) for i, c in enumerate(split_text(t or "", size, overlap, seps))]
            yield pd.DataFrame(rows, columns=[key, "chunk_id", "content"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, chunk_id bigint, content string")


def fixed(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 100) -> DataFrame:
    """(key, chunk_id, content): windows of ``size`` characters, each ``overlap`` back from the end of the one before."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length("t") - F.lit(overlap)) / F.lit(step))).cast("int")
    rows = df.select(F.col(key), F.col(text).alias("t")).where(F.length("t") > 0)
    at = rows.select(key, "t", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return at.select(key, F.col("i").cast("bigint").alias("chunk_id"), F.substr("t", F.col("i") * step + 1, F.lit(size)).alias("content"))


def markdown_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sec_no, level, heading, hierarchy, content): parts of a text at ``#`` headings, a part before the first included.

    Arrays only, no shuffle: a section starts at each heading line; its hierarchy are the headings above it of
    falling levels. Headings in code fences count too, as lines are not parsed further. Empty parts are left out.
    """
    lines = F.split(F.col(text), r"\r\n|\r|\n")
    mark = r"^(#{1,6})[ \t]+(\S.*)$"
    heads = F.filter(
        F.transform("l", lambda x, i: F.struct(i.alias("at"), F.length(F.regexp_extract(x, mark, 1)).alias("level"), F.trim(F.regexp_extract(x, mark, 2)).alias("title"))), lambda h: h["level"] > 0
    )
    start = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("level"), F.lit("").alias("title")))
    rows = df.where(F.col(text).isNotNull()).select(key, lines.alias("l")).withColumn("h", F.concat(start, heads))

    def section(x: Column, n: Column) -> Column:
        end = F.coalesce(F.try_element_at(F.col("h")["at"], n + 2), F.size("l"))
        body = F.trim(F.array_join(F.slice("l", x["at"] + 2, F.greatest(F.lit(0), end - x["at"] - 1)), "\n"), F.lit(" \t\n"))
        above = F.aggregate(
            F.reverse(F.slice("h", F.lit(1), n)),
            F.struct(x["level"].alias("level"), F.array().cast("array<string>").alias("t")),
            lambda a, y: F.when((y["level"] < a["level"]) & (y["level"] > 0), F.struct(y["level"].alias("level"), F.concat(F.array(y["title"]), a["t"]).alias("t"))).otherwise(a),
        )["t"]
        path = F.array_join(F.when(x["level"] > 0, F.concat(above, F.array(x["title"]))).otherwise(F.array().cast("array<string>")), " > ")
        return F.struct(x["level"].alias("level"), x["title"].alias("heading"), path.alias("hierarchy"), body.alias("content"))

    # parts are cut before they become rows, so that no row carries the whole text
    out = rows.select(key, F.posexplode(F.transform("h", section)).alias("n", "s")).select(key, F.col("n").cast("bigint").alias("sec_no"), "s.*")
    return out.where("content != '' or level > 0")


def heading_aware(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 100) -> DataFrame:
    """(key, chunk_id, heading, content): sections as chunks, longer ones cut at sentences."""
    sections = markdown_sections(df, key, text).where("content != ''").select(F.struct(key, "sec_no", "heading").alias("s"), "content")
    parts = recursive(sections, "s", "content", size, overlap, SENTENCES)
    w = Window.partitionBy(key).orderBy("sec_no", "part")
    rows = parts.select(f"s.{key}", "s.sec_no", "s.heading", F.col("chunk_id").alias("part"), "content")
    return rows.select(key, (F.row_number().over(w) - 1).cast("bigint").alias("chunk_id"), "heading", "content")


def semantic(df: DataFrame, key: str, text: str, embed: Callable[[Column], Column], percentile: float = 0.95) -> DataFrame:
    """(key, chunk_id, content): sentences joined while their vectors stay close; breaks lie over a percentile of distances."""
    from strataloom.functions.vector import cosine

    s = df.select(key, F.posexplode(F.split(F.col(text), r"(?<=[.!?])\s+")).alias("pos", "sentence")).where("sentence != ''").withColumn("v", embed(F.col("sentence")))
    w = Window.partitionBy(key).orderBy("pos")
    d = s.withColumn("d", 1 - cosine(F.lag("v").over(w), F.col("v"))).drop("v")
    cut = d.groupBy(key).agg(F.percentile("d", F.lit(percentile)).alias("cut"))
    runs = d.join(cut, key).withColumn("chunk_id", F.sum(F.when(F.col("d") > F.col("cut"), 1).otherwise(0)).over(w))
    text_of = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ")
    return runs.groupBy(key, "chunk_id").agg(text_of.alias("content"))


def strategy(name: str | None, document_type: str) -> str:
    """The strategy asked for, else headings for Markdown and separators for the rest."""
    known = {"recursive": "recursive", "heading": "heading_aware", "heading_aware": "heading_aware", "semantic": "semantic"}
    if name in (None, "", "auto"):
        return "heading_aware" if document_type == "markdown" else "recursive"
    if name not in known:
        raise ValueError(f"no chunking strategy {name!r}; there are {sorted(known)}")
    return known[name]


def page_blocks(blocks: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, chunk_id, section, content): chunks of pages of ordered blocks ``(page, order, block_type, content)``.

    A heading is a chunk; code blocks stand alone; runs of one kind of list items are joined by lines, runs of other
    text by blank lines, and those over SECTION_CHARS are cut to about PART_CHARS. Chunks name their section.
    """
    w = Window.partitionBy(page).orderBy("order")
    b = blocks.where(F.col("block_type").isin(HEADINGS + TEXTS)).withColumn("t", F.coalesce("content", F.lit("")))
    head = F.col("block_type").isin(HEADINGS)
    b = b.withColumn("section", F.coalesce(F.last(F.when(head, F.col("t")), ignorenulls=True).over(w), F.lit("")))
    form = F.when(head, "heading").when(F.col("block_type") == "code", "code").when(F.col("block_type").isin(LISTS), F.col("block_type")).otherwise("text")
    b = b.withColumn("form", form)
    new = F.col("form").isin("heading", "code") | ~F.col("form").eqNullSafe(F.lag("form").over(w))
    b = b.withColumn("run", F.sum(F.when(new, 1).otherwise(0)).over(w))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("order", "t"))), lambda x: x["t"])
    runs = b.groupBy(page, "run", "section", "form").agg(F.when(F.first("form") == "text", F.array_join(ordered, "\n\n")).otherwise(F.array_join(ordered, "\n")).alias("c"))
    short = runs.where((F.col("form") != "text") | (F.length("c") <= SECTION_CHARS)).select(page, "run", "section", "form", F.lit(0).cast("bigint").alias("part"), "c")
    long = runs.where((F.col("form") == "text") & (F.length("c") > SECTION_CHARS))
    kinds = blocks.schema[page].dataType
    cut = recursive(long.select(F.struct(page, "run", "section", "form").alias("k"), "c"), "k", "c", PART_CHARS, 0, ["\n\n", ". ", "! ", "? ", "; ", "\n", ""])
    every = short.unionByName(cut.select(F.col(f"k.{page}").cast(kinds).alias(page), "k.run", "k.section", "k.form", F.col("chunk_id").alias("part"), F.col("content").alias("c")))
    crumb = F.when((F.col("form") != "heading") & (F.col("section") != ""), F.concat(F.lit("[Section: "), F.col("section"), F.lit("]\n\n"))).otherwise("")
    body = F.when(F.col("form") == "code", F.concat(F.lit("```\n"), F.col("c"), F.lit("\n```"))).otherwise(F.col("c"))
    n = F.row_number().over(Window.partitionBy(page).orderBy("run", "part")) - 1
    return every.where("c != ''").select(page, n.cast("bigint").alias("chunk_id"), "section", F.concat(crumb, body).alias("content"))


def hashed_bag(column: Column, size: int = 64) -> Column:
    """A vector of hashed words: a stand-in for an embedding model that needs none."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(size, np.float32)
            for word in (t or "").lower().split():
                v[sum(word.encode()) % size] += 1
            out.append(v)
        return pd.Series(out)

    return run(column)
