"""Indexes of repositories and commits, routing to repositories, and search of stored question-answer pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as X
from strataloom.operators import graph, index, knn
from strataloom.operators.code import manifest_hash


def overviews(files: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(repo_id, text, n_files): what describes a repository to a search: counts, languages, and every source file with the first line of its docstring.

    ``files(repo_id, file_path, language)``, ``docs(repo_id, file_path, docstring)``. Files are in order of their paths, languages by their number, then name.
    A row holds the overview of one repository, as the index does.
    """
    f = files.select("repo_id", "file_path", X.text_of(F.col("language")).alias("language"))
    if docs is not None:
        f = f.join(docs.select("repo_id", "file_path", F.trim(F.substring_index("docstring", "\n", 1)).alias("line")).dropDuplicates(["repo_id", "file_path"]), ["repo_id", "file_path"], "left")
    else:
        f = f.withColumn("line", F.lit(None).cast("string"))
    source = (F.col("language") != "") & ~X.is_test_path(F.col("file_path")) & ~X.is_generated_path(F.col("file_path"))
    line = F.concat(F.lit("  "), F.col("file_path"), F.coalesce(F.concat(F.lit(" - "), F.nullif("line", F.lit(""))), F.lit("")))
    per = f.groupBy("repo_id").agg(F.count("*").alias("n_files"), F.count_if(source).alias("n_source"), F.sort_array(F.collect_list(F.when(source, F.struct("file_path", line.alias("l"))))).alias("x"))
    langs = f.where(source).groupBy("repo_id", "language").agg(F.count("*").alias("n")).groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "language"))).alias("g"))
    shown = F.array_join(F.transform("g", lambda x: F.concat(x["language"], F.lit(" "), (-x["o"]).cast("string"))), ", ")
    head = F.concat(F.lit("files: "), F.col("n_files").cast("string"), F.lit("  source: "), F.col("n_source").cast("string"))
    return per.join(langs, "repo_id", "left").select(
        "repo_id",
        F.concat_ws("\n", F.concat(F.lit("repository: "), F.col("repo_id")), head, F.concat(F.lit("languages: "), F.coalesce(shown, F.lit(""))), F.nullif(F.array_join(F.transform("x", lambda r: r["l"]), "\n"), F.lit(""))).alias("text"),
        "n_files",
    )


def repository_index(files: DataFrame, embed, docs: DataFrame | None = None) -> DataFrame:
    """(repo_id, text, content_hash, embedding): a row a repository; the hash is that of its files' hashes in order of their paths."""
    t = overviews(files, docs).join(manifest_hash(files).select("repo_id", "content_hash"), "repo_id")
    return t.select("repo_id", "text", "content_hash", embed(F.col("text")).alias("embedding"))


def commit_index(commits: DataFrame, embed) -> DataFrame:
    """(id, repo_id, commit_hash, text, content_hash, embedding): commits described by message, summary and changed files."""
    c = commits if "summary" in commits.columns else commits.withColumn("summary", F.lit(""))
    text = F.concat_ws("\n", F.nullif("message", F.lit("")), F.nullif("summary", F.lit("")), F.nullif(F.array_join("files_changed", ", "), F.lit("")))
    c = c.withColumn("text", text)
    return c.select(X.composite_id(F.col("repo_id"), F.col("commit_hash")).alias("id"), "repo_id", "commit_hash", "text", F.sha2("text", 256).alias("content_hash"), embed(F.col("text")).alias("embedding"))


def search_index(rows: DataFrame, queries: DataFrame, key: str, k: int = 10, keep: Column | None = None, **options) -> DataFrame:
    """(query_id, key, score, rank): nearest rows of an index of repositories or commits, of some repositories with ``keep``."""
    return knn.search(rows, queries, key, "embedding", k, keep=keep, **options)


def route(repositories: DataFrame, queries: DataFrame, repos: int = 3) -> DataFrame:
    """(query_id, repo_id, rank): the repositories nearest to each query."""
    return search_index(repositories, queries, "repo_id", repos).select("query_id", "repo_id", "rank")


def hierarchical_search(repositories: DataFrame, blocks: DataFrame, queries: DataFrame, key: str, k: int = 5, repos: int = 3, keep: Column | None = None, repo_ids: list[str] | None = None) -> DataFrame:
    """(query_id, key, score, rank): routed to the nearest repositories, then to their nearest blocks.

    Given ``repo_ids`` skip the routing. A query that is routed nowhere searches all blocks. Which repositories a query may see goes
    with its block of queries, so a repository of a third of all blocks is read once, not once a query.
    """
    if repo_ids:
        own = F.col("repo_id").isin(list(dict.fromkeys(repo_ids)))
        return search_index(blocks, queries, key, k, own if keep is None else own & keep)
    routes = route(repositories, queries, repos)
    return search_index(blocks, queries, key, k, keep, only=routes.select("query_id", F.col("repo_id").alias("group")), only_column="repo_id")


def qa_index(existing: DataFrame | None, pairs: DataFrame, embed, doc: str = "doc_id", overwrite: bool = False) -> DataFrame:
    """(id, doc, question, answer, embedding): stored pairs and new ones; a document that has pairs keeps them, or with ``overwrite`` loses them.

    ``pairs(doc, pos, question, answer)``; ids are the document and the position.
    """
    new = pairs.select(X.composite_id(F.col(doc).cast("string"), F.col("pos").cast("string")).alias("id"), doc, "question", "answer", embed(F.col("question")).alias("embedding"))
    if existing is None:
        return new
    if overwrite:
        return existing.join(new.select(doc).distinct(), doc, "left_anti").select(*new.columns).unionByName(new)
    return existing.select(*new.columns).unionByName(new.join(existing.select(doc).distinct(), doc, "left_anti").select(*new.columns))


def qa_search(qa: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, question, answer, score, rank): pairs whose question is nearest to the query."""
    return knn.search(qa, queries, "id", "embedding", k).join(qa.select("id", "question", "answer"), "id").select("query_id", "id", "question", "answer", "score", "rank")


def related_blocks(primaries: DataFrame, blocks: DataFrame, edges: DataFrame, most_related: int = 8, most_nearby: int = 3, types: list[str] | None = None) -> DataFrame:
    """(chunk_id, related_count, related): of every primary block its ranked relations: graph neighbours both ways, and blocks of its file that start nearest.

    ``blocks(chunk_id, repo_id, file_path, name, chunk_type, start_line, end_line)``; targets of edges are resolved to blocks where one
    fits and kept as they are where none does. At most ``most_related`` + ``most_nearby`` a block; a block without any has an empty list.
    """
    b = blocks.select("chunk_id", "repo_id", "file_path", "name", "chunk_type", "start_line", "end_line")
    own = b.join(primaries.select("chunk_id").distinct(), "chunk_id", "left_semi")
    about = own.select(F.col("chunk_id").alias("source"), F.col("repo_id").alias("repo_id"), F.col("file_path").alias("source_file"), F.col("start_line").alias("source_line"))
    hop = graph.expand(graph.anchors(own, "chunk_id", "repo_id", "file_path", "chunk_type", "name"), edges, types).join(about, "source")
    found = graph.resolve_targets(hop.select("target", "repo_id", F.col("line_no").alias("line")), b).where("chunk_id is not null").groupBy("target", "repo_id").agg(F.min("chunk_id").alias("block"))
    hop = hop.join(found, ["target", "repo_id"], "left").withColumn("target", F.coalesce("block", "target")).where("target != source")
    files = b.select(F.col("chunk_id").alias("target"), F.col("file_path").alias("target_file"))
    hop = hop.join(files, "target", "left").select("source", "target", "edge_type", "direction", "line_no", F.lit(0).cast("bigint").alias("distance"), "source_file", F.coalesce("target_file", F.lit("")).alias("target_file"), "source_line")
    close = graph.nearby(b.where("chunk_type != 'module'"), "chunk_id", ["repo_id", "file_path"], "start_line", most_nearby, own.select("chunk_id"))
    near = close.select(F.col("chunk_id").alias("source"), F.col("other").alias("target"), F.lit("NEARBY").alias("edge_type"), F.lit("undirected").alias("direction"), F.lit(0).cast("bigint").alias("line_no"), "distance")
    near = near.join(about.drop("repo_id"), "source").withColumn("target_file", F.col("source_file")).select(*hop.columns)
    ranked = graph.rank_relations(hop.unionByName(near).withColumn("hop", F.lit(1)), most_related + most_nearby)
    fields = F.struct("rank", "target", "edge_type", "direction", "score", "evidence", "explain")
    lists = ranked.groupBy(F.col("source").alias("chunk_id")).agg(F.sort_array(F.collect_list(fields)).alias("related"))
    return own.select("chunk_id").join(lists, "chunk_id", "left").select("chunk_id", F.coalesce(F.size("related"), F.lit(0)).cast("bigint").alias("related_count"), F.coalesce("related", F.array().cast(lists.schema["related"].dataType)).alias("related"))


def enriched(primaries: DataFrame, blocks: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """``primaries`` with related_count and related; if edges or blocks lack a column, the rows as they came, with none."""
    try:
        r = related_blocks(primaries, blocks, edges, **options)
    except Exception:  # noqa: BLE001  a broken index must not take the search results along
        return primaries.withColumns({"related_count": F.lit(0).cast("bigint"), "related": F.array()})
    return primaries.join(r, "chunk_id", "left").withColumn("related_count", F.coalesce("related_count", F.lit(0).cast("bigint")))


def graph_payload(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of enriched rows (chunk_id, score, related): nodes(id, label, score, is_primary), edges(id, source, target, edge_type, direction, score) and one row of figures.

    A node that is a primary keeps its own score. Edges are one a source, target, type and direction. The figures are the number of primaries, of those with
    relations, their share to four digits, and the number of references.
    """
    p = found.where(F.length(F.trim(F.coalesce("chunk_id", F.lit("")))) > 0)
    rel = p.select(F.col("chunk_id").alias("source"), F.explode("related").alias("r")).where("r.target != ''")
    label = F.element_at(F.split("id", "::"), -1)
    nodes = p.select(F.col("chunk_id").alias("id"), F.col("score").cast("double").alias("score"), F.lit(True).alias("is_primary")).unionByName(
        rel.select(F.col("r.target").alias("id"), F.col("r.score").alias("score"), F.lit(False).alias("is_primary"))
    )
    nodes = nodes.groupBy("id").agg(F.max_by("score", F.struct("is_primary", "score")).alias("score"), F.max("is_primary").alias("is_primary")).withColumn("label", label)
    kind, way = F.coalesce(F.nullif("r.edge_type", F.lit("")), F.lit("RELATED")), F.coalesce(F.nullif("r.direction", F.lit("")), F.lit("undirected"))
    edges = rel.select("source", F.col("r.target").alias("target"), kind.alias("edge_type"), way.alias("direction"), F.col("r.score").alias("score"))
    edges = edges.groupBy("source", "target", "edge_type", "direction").agg(F.max("score").alias("score")).withColumn("id", F.concat_ws("|", "source", "target", "edge_type", "direction"))
    some = F.size("related") > 0
    figures = found.agg(F.count("*").alias("primaries"), F.count_if(some).alias("with_relations"), F.coalesce(F.round(F.count_if(some) / F.count("*"), 4), F.lit(0.0)).alias("hit_rate"), F.coalesce(F.sum(F.size("related")), F.lit(0)).cast("bigint").alias("references"))
    return nodes.select("id", "label", "score", "is_primary"), edges.select("id", "source", "target", "edge_type", "direction", "score"), figures


def edge_histogram(edges: DataFrame, most: int) -> DataFrame:
    """(edge_type, n, truncated): edges of each type, and whether the graph has more of all types than may be shown."""
    kind = F.coalesce(F.nullif("edge_type", F.lit("")), F.lit("UNKNOWN"))
    n = edges.groupBy(kind.alias("edge_type")).agg(F.count("*").alias("n"))
    return n.withColumn("truncated", F.sum("n").over(Window.partitionBy()) > most)  # a row a type


def upsert_index(existing: DataFrame | None, rows: DataFrame, key: str, repo_id: str | None = None, prune: bool = False) -> DataFrame:
    """An index after an upsert by key; with ``prune``, rows of ``repo_id`` that aren't incoming disappear, those of others stay."""
    if existing is None:
        return rows
    if not prune or repo_id is None:
        return index.upsert(existing, rows, key)
    other = existing.where(F.col("repo_id") != repo_id)
    return index.upsert(existing.where(F.col("repo_id") == repo_id), rows, key, prune=True).unionByName(other)
