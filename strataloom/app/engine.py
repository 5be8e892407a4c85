"""One object for indexing, searching, knowledge and memory over the tables of a Store."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.app import prompts
from strataloom.app.config import Config
from strataloom.app.memory import Gateway
from strataloom.functions import text as X
from strataloom.operators import chunking, code, facets, fusion, history, index, knn, knowledge, lexical, lookups, pipeline, repos, rerank
from strataloom.operators.filters import SearchFilter, effective
from strataloom.session import cut as session_cut
from strataloom.sources import files


class Indexer(Protocol):
    """What keeps an index: each call gives the numbers of each kind of change."""

    def ingest(self, source: Any, source_id: str) -> dict[str, int]: ...

    def update(self, source: Any, source_id: str) -> dict[str, int]: ...

    def delete(self, source_id: str) -> dict[str, int]: ...

    def reindex(self, source: Any, source_id: str) -> dict[str, int]: ...


class TableIndex:
    """An index of rows with ``source_id``, a key and a hash in a table of a Store."""

    def __init__(self, store: index.Store, name: str, key: str = "id", hash_col: str = "content_hash", owner: str = "source_id"):
        self.store, self.name, self.key, self.hash_col, self.owner = store, name, key, hash_col, owner

    def ingest(self, source: DataFrame, source_id: str) -> dict[str, int]:
        return self.store.sync(self.name, source.withColumn(self.owner, F.lit(source_id)), self.key, self.hash_col)

    update = ingest

    def delete(self, source_id: str) -> dict[str, int]:
        return {"deleted": self.store.delete(self.name, F.col(self.owner) == source_id)}

    def reindex(self, source: DataFrame, source_id: str) -> dict[str, int]:
        gone = self.delete(source_id)
        return index.add_stats(self.ingest(source, source_id), gone)


class Engine:
    """``embed`` makes a vector column of a text column; ``model`` answers a Series of prompts; both are plain functions."""

    def __init__(self, spark: SparkSession, config: Config | None = None, embed: Callable[[Column], Column] = X.hash_embedding, model: Callable[[pd.Series], pd.Series] | None = None):
        self.spark, self.config = spark, config or Config.from_env()
        self.embed, self.model = embed, model
        self.store = index.Store(spark, self.config.store)
        self.memory = Gateway(spark, self.store)

    # ------------------------------------------------------------ documents

    def add_documents(self, path: str, workspace: str = "", tags: Sequence[str] = (), strategy: str | None = None) -> dict[str, int]:
        """Read, split, stamp and index the files under a path; the numbers of each kind of change."""
        docs = files.documents(self.spark, path)
        kinds = [r["document_type"] for r in docs.select("document_type").distinct().collect()]  # a few types
        parts = None
        for kind in kinds:
            own = docs.where(F.col("document_type") == kind)
            how = chunking.strategy(strategy, kind)
            if how == "semantic":
                rows = chunking.semantic(own, "source", "content", self.embed)
            else:
                rows = (chunking.heading_aware if how == "heading_aware" else chunking.recursive)(own, "source", "content", self.config.chunk_size, self.config.chunk_overlap)
            rows = rows.select("source", "chunk_id", (F.col("heading") if "heading" in rows.columns else F.lit("")).alias("section"), "content", F.lit(kind).alias("document_type"))
            parts = rows if parts is None else parts.unionByName(rows)
        if parts is None:
            return {"added": 0, "modified": 0, "skipped": 0, "deleted": 0}
        stamped = parts.select(
            F.concat_ws("::", "source", F.col("chunk_id").cast("string")).alias("id"),
            F.col("source").alias("doc_id"),
            "chunk_id",
            "section",
            "content",
            "document_type",
            F.lit(workspace).alias("workspace"),
            F.lit(",".join(tags)).alias("tags"),
            F.sha2("content", 256).alias("content_hash"),
            self.embed(F.col("content")).alias("embedding"),
        )
        return self.store.sync("chunks", stamped, "id", "content_hash")

    def add_texts(self, texts: DataFrame, workspace: str = "") -> dict[str, int]:
        """Texts ``(id, text)`` as chunks of their own; the numbers of each kind of change."""
        rows = texts.select(
            F.col("id").cast("string").alias("id"), F.col("id").cast("string").alias("doc_id"), F.lit(0).cast("bigint").alias("chunk_id"), F.lit("").alias("section"), F.col("text").alias("content"),
            F.lit("text").alias("document_type"), F.lit(workspace).alias("workspace"), F.lit("").alias("tags"), F.sha2("text", 256).alias("content_hash"), self.embed(F.col("text")).alias("embedding"),
        )
        return self.store.sync("chunks", rows, "id", "content_hash")

    def delete_document(self, doc_id: str) -> int:
        return self.store.delete("chunks", F.col("doc_id") == doc_id)

    def reindex(self, path: str, doc_id: str, **options: Any) -> dict[str, int]:
        gone = self.delete_document(doc_id)
        return index.add_stats(self.add_documents(path, **options), {"deleted": gone})

    def chunks(self) -> DataFrame:
        return self.store.read("chunks")

    # ------------------------------------------------------------ search

    def search(self, queries: DataFrame, top_k: int | None = None, mode: str = "hybrid", search_filter: SearchFilter | None = None, doc_id: str | None = None) -> DataFrame:
        """(query_id, key, score, rank) of every query, by ``vector``, ``lexical`` or ``hybrid`` search, reranked if configured."""
        docs = self.chunks()
        sides: dict[str, pipeline.Retriever] = {"vector": pipeline.Nearest(docs, "id", "embedding", self.embed), "lexical": pipeline.Lexical(docs, "id", "content")}
        chosen = list(sides.values()) if mode == "hybrid" else [sides[mode]]
        p = pipeline.document_pipeline(
            chosen, docs, "id", "content", rerank.build_reranker(self.config.reranker), [self.config.vector_weight, self.config.lexical_weight] if mode == "hybrid" else None
        )
        return p.run(queries, top_k or self.config.top_k, self.config.fetch_k, effective(search_filter, doc_id))

    def search_workspace(self, queries: DataFrame, workspace: str | None = None, document_type: str = "notion", **options: Any) -> DataFrame:
        """The same among the pages of a workspace, or of all workspaces."""
        return self.search(queries, search_filter=SearchFilter(workspace=workspace, document_type=document_type), **options)

    def trace(self, queries: DataFrame, top_k: int | None = None) -> dict[str, DataFrame]:
        """Every stage's list, their overlap and their scores."""
        stages = {m: self.search(queries, top_k or self.config.fetch_k, m) for m in ("vector", "lexical", "hybrid")}
        lists = None
        for name, df in stages.items():
            part = df.withColumn("list_id", F.lit(name))
            lists = part if lists is None else lists.unionByName(part)
        return {**stages, "overlap": fusion.overlap(stages["vector"], stages["lexical"], "query_id", "key"), "stats": fusion.score_stats(lists)}

    def answer(self, queries: DataFrame, top_k: int | None = None, **options: Any) -> DataFrame:
        """(query_id, answer) by the model from the found context."""
        found = self.search(queries, top_k, **options).join(self.chunks().select(F.col("id").alias("key"), "content", "section", "doc_id"), "key")
        tag = F.concat_ws(" / ", F.col("doc_id"), F.nullif("section", F.lit("")))
        ctx = pipeline.context(found.withColumn("tag", tag), "query_id", "rank", "content", "tag")
        asked = queries.join(ctx, "query_id", "left").withColumn("prompt", prompts.answer(F.col("query"), F.col("context")))
        if self.model is None:
            return asked.select("query_id", F.col("prompt").alias("answer"))
        return knowledge.generate(asked, "query_id", "prompt", self.model)

    def facet(self, column: str) -> DataFrame:
        return facets.list_values(self.chunks(), column) if column in ("tags", "topics", "ka_keywords") else facets.distinct_values(self.chunks(), column)

    def documents(self) -> DataFrame:
        return facets.doc_info(self.chunks(), "doc_id", "chunk_id", ["document_type", "workspace"])

    # ------------------------------------------------------------ knowledge

    def link(self) -> DataFrame:
        return knowledge.link_chunks(self.chunks(), "id", "doc_id", "embedding", k=self.config.link_top_k, least=self.config.link_threshold)

    def cluster(self) -> DataFrame:
        return knowledge.topics(self.chunks(), "id", "embedding", self.config.clusters)

    def enrich(self, overwrite: bool = False) -> dict[str, int]:
        """Extract summary, keywords and the rest of every chunk that has none yet, write them back; the numbers of each status."""
        if self.model is None:
            raise RuntimeError("enrichment needs a model")
        rows = self.chunks()
        todo = rows if overwrite or "ka_summary" not in rows.columns else rows.where(~knowledge.is_enriched())
        answers = knowledge.generate(todo.select("id", prompts.extract(F.col("content")).alias("prompt")), "id", "prompt", self.model)
        done = session_cut(knowledge.enrich_stored(rows, "id", answers, overwrite=overwrite))
        counts = {r["status"]: r["n"] for r in lookups.counts_by(done, "status").collect()}  # three rows
        if counts.get("enriched"):
            self.store.replace("chunks", done.drop("status"))
        return {s: counts.get(s, 0) for s in ("enriched", "skipped", "failed")}

    def assign_topics(self) -> int:
        """Cluster the chunks and write each cluster's topic into its chunks; their number."""
        rows = self.chunks()
        if "topics" not in rows.columns:
            rows = rows.withColumn("topics", F.lit(""))
        found = session_cut(self.cluster().select(F.col("id"), "topic"))
        labels = self.spark.createDataFrame([], "topic int, label string")
        if self.model is not None:
            some = rows.select("id", "content").join(found, "id").groupBy("topic").agg(F.min_by("content", "id").alias("content"))
            labels = knowledge.generate(some.select("topic", prompts.label(F.col("content")).alias("prompt")), "topic", "prompt", self.model, "label")
        self.store.replace("chunks", session_cut(knowledge.assign_topics(rows, "id", found, labels)))
        return found.count()

    def build_qa(self, overwrite: bool = False) -> int:
        """Questions and answers of every document that has none yet; their number in the index."""
        if self.model is None:
            raise RuntimeError("question-answer pairs need a model")
        old = self.store.read("qa") if self.store.exists("qa") else None
        rows = self.chunks()
        todo = rows if overwrite or old is None else rows.join(old.select("doc_id").distinct(), "doc_id", "left_anti")
        asked = todo.select(F.struct("doc_id", "chunk_id").alias("k"), prompts.pairs(F.substring("content", 1, 2000)).alias("prompt"))
        pairs = knowledge.qa_pairs(knowledge.generate(asked, "k", "prompt", self.model), "k")
        pairs = pairs.select(F.col("k.doc_id").alias("doc_id"), F.concat_ws("-", F.col("k.chunk_id").cast("string"), F.col("pos").cast("string")).alias("pos"), "question", "answer")
        self.store.replace("qa", session_cut(repos.qa_index(old, pairs, self.embed, overwrite=overwrite)))
        return self.store.read("qa").count()

    def search_qa(self, queries: DataFrame, k: int = 5) -> DataFrame:
        return repos.qa_search(self.store.read("qa"), self._asked(queries), k)

    def _asked(self, queries: DataFrame) -> DataFrame:
        return queries.where("query is not null").select("query_id", self.embed(F.col("query")).alias("vector"))

    # ------------------------------------------------------------ code

    def add_repository(self, path: str, repo_id: str, branch: str = "", commit: str = "", force: bool = False) -> dict[str, int]:
        """Index the Python files of a folder: chunks, symbols and edges; files that are gone are pruned.

        A commit that was indexed last is not read again unless forced; the state table has each repository's last one.
        """
        state = "repositories"
        if commit and not force and self.store.exists(state) and not self.store.read(state).where((F.col("repo_id") == repo_id) & (F.col("commit") == commit)).isEmpty():
            return {"added": 0, "modified": 0, "skipped": 0, "deleted": 0}
        found = files.repository(self.spark, path, repo_id, branch, files.ignore_lines(self.spark, path))
        python = found.where("language = 'Python' and not is_test and not is_generated")
        parts = code.chunks(python)
        stats = self.store.sync(f"code_{repo_id}", parts.withColumnRenamed("chunk_id", "id").dropDuplicates(["id"]), "id", "content_hash", prune=True)
        self.store.replace(f"edges_{repo_id}", code.edges(python))
        self.store.replace(f"symbols_{repo_id}", code.symbols(parts))
        parts = session_cut(parts)
        docs = parts.where("chunk_type = 'module'").select("repo_id", "file_path", "docstring")
        self.store.sync("repository_index", repos.repository_index(found, self.embed, docs), "repo_id", "content_hash")
        last = self.spark.createDataFrame([(repo_id, commit)], "repo_id string, commit string")
        self.store.replace(state, index.upsert(self.store.read(state), last, "repo_id") if self.store.exists(state) else last)
        return stats

    def remove_repository(self, repo_id: str) -> int:
        return sum(self.store.delete(f"{kind}_{repo_id}", F.lit(True)) for kind in ("code", "edges", "symbols"))

    def add_repositories(self, paths: dict[str, str], **options: Any) -> dict[str, int]:
        """Several folders by repository id; the numbers of each kind of change together. One that fails doesn't stop the others."""
        stats: list[dict[str, int]] = []
        for repo_id, path in paths.items():
            try:
                stats.append(self.add_repository(path, repo_id, **options))
            except Exception as problem:  # noqa: BLE001  one folder's failure is not the others'
                print(f"{repo_id}: {problem}")
                stats.append({"failed": 1})
        return index.add_stats(*stats)

    def add_commits(self, commits: DataFrame, repo_id: str | None = None, prune: bool = False) -> int:
        """Commits ``(repo_id, commit_hash, message, files_changed)`` into their index; with ``prune``, those of ``repo_id`` that aren't given disappear."""
        old = self.store.read("commits") if self.store.exists("commits") else None
        self.store.replace("commits", session_cut(repos.upsert_index(old, repos.commit_index(commits, self.embed), "id", repo_id, prune)))
        return self.store.read("commits").count()

    def search_commits(self, queries: DataFrame, k: int = 10, repo_id: str | None = None) -> DataFrame:
        return repos.search_index(self.store.read("commits"), self._asked(queries), "id", k, None if repo_id is None else F.col("repo_id") == repo_id)

    def search_repositories(self, queries: DataFrame, k: int = 3) -> DataFrame:
        return repos.search_index(self.store.read("repository_index"), self._asked(queries), "repo_id", k)

    def code_level(self, repo_ids: Sequence[str], level: str = "block") -> DataFrame:
        """(id, repo_id, file_path, name, content, embedding) of files, symbols or blocks of repositories; long blocks are shortened before they are embedded."""
        parts = None
        for r in repo_ids:
            own = self.store.read(f"code_{r}")
            parts = own if parts is None else parts.unionByName(own)
        if level == "file":
            rows = code.file_texts(parts.withColumnRenamed("id", "chunk_id")).select(F.concat_ws("::", "repo_id", "file_path").alias("id"), "repo_id", "file_path", F.col("file_path").alias("name"), F.col("text").alias("content"))
        elif level == "symbol":
            text = F.concat_ws("\n", F.concat_ws(" ", "chunk_type", "name"), F.nullif("docstring", F.lit("")))
            rows = parts.where("chunk_type != 'module'").select("id", "repo_id", "file_path", "name", text.alias("content"))
        else:
            rows = parts.select("id", "repo_id", "file_path", "name", "content")
        return rows.withColumn("embedding", self.embed(X.shorten(F.col("content"))))

    def nearest_code(self, queries: DataFrame, repo_ids: Sequence[str], level: str = "block", k: int = 5) -> DataFrame:
        return knn.search(self.code_level(repo_ids, level), self._asked(queries), "id", "embedding", k)

    def route_code(self, queries: DataFrame, repo_ids: Sequence[str], k: int = 5, level: str = "block") -> DataFrame:
        """The nearest blocks of each query in the three repositories nearest to it."""
        return repos.hierarchical_search(self.store.read("repository_index"), self.code_level(repo_ids, level), self._asked(queries), "id", k)

    def search_code(self, queries: DataFrame, repo_id: str, top_k: int | None = None, scope: rerank.Scope | None = None) -> DataFrame:
        blocks = self.store.read(f"code_{repo_id}")
        found = lexical.search(blocks, queries, "id", "content", top_k or self.config.fetch_k, tokens=X.code_tokens)
        if scope is None:
            return found
        return rerank.scope_rerank(found.join(blocks.select("id", "repo_id", "file_path", "name"), "id"), scope, "repo_id", "file_path", "name", "score", "rank", ["query_id"])

    def related(self, found: DataFrame, repo_id: str, most: int = 8, nearby: int = 3) -> DataFrame:
        """(chunk_id, related_count, related): relations of found blocks in the graph and in their files."""
        blocks = self.store.read(f"code_{repo_id}").withColumnRenamed("id", "chunk_id")
        return repos.enriched(found.select(F.col("id").alias("chunk_id")).distinct(), blocks, self.store.read(f"edges_{repo_id}"), most_related=most, most_nearby=nearby)

    def search_blocks(self, queries: DataFrame, repo_id: str, k: int = 5, fetch_k: int = 20, relations: bool = True, scorer: rerank.Scorer | None = None, scope: rerank.Scope | None = None) -> DataFrame:
        """Nearest blocks without those of tests, boosted by a scope, with their relations; with a scorer the best k of them, else all that were fetched."""
        blocks = self.store.read(f"code_{repo_id}").select("id", "repo_id", "file_path", "name", "content")
        found = self.nearest_code(queries, [repo_id], "block", fetch_k).join(blocks, "id").where(~lookups.is_test(F.col("file_path")))
        if scope is not None:
            found = rerank.scope_rerank(found, scope, "repo_id", "file_path", "name", "score", "rank", ["query_id"])
        if scorer is not None:
            best = rerank.rerank(found.join(queries, "query_id"), "query_id", "id", "query", "content", k, scorer)
            found = found.drop("score", "rank").join(best, ["query_id", "id"])
        if relations:
            found = found.join(self.related(found, repo_id).withColumnRenamed("chunk_id", "id"), "id", "left")
        return found.drop("content", "rank_before")

    def diff_summaries(self, diffs: DataFrame, key: str = "id") -> DataFrame:
        """(key, summary): the first line a model says of each diff, without quotes; an empty diff has an empty one."""
        if self.model is None:
            raise RuntimeError("summaries need a model")
        said = knowledge.generate(diffs.where(F.length(F.trim("diff")) > 0).select(key, prompts.summarize_diff(F.col("diff")).alias("prompt")), key, "prompt", self.model)
        return diffs.select(key).join(said, key, "left").select(key, history.first_line(F.col("answer")).alias("summary"))
