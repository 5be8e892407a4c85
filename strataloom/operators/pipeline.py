"""Retrieval pipelines: steps over one long frame of result lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators import fusion, knn, lexical, rerank
from strataloom.operators.filters import where


class Retriever(Protocol):
    """Anything that answers a frame ``queries(query_id, query)`` with ``(query_id, key, score, rank)``."""

    def search(self, queries: DataFrame, top_k: int, filters: dict[str, Any] | None = None) -> DataFrame: ...


@dataclass
class Lexical:
    docs: DataFrame
    key: str
    text: str
    tokens: Callable = lexical.prose_tokens

    def search(self, queries: DataFrame, top_k: int, filters: dict[str, Any] | None = None) -> DataFrame:
        found = lexical.search(self.docs, queries, self.key, self.text, top_k, keep=where(filters) if filters else None, tokens=self.tokens)
        return found.withColumnRenamed(self.key, "key")


@dataclass
class Nearest:
    docs: DataFrame
    key: str
    vector: str
    embed: Callable  # of a text column

    def search(self, queries: DataFrame, top_k: int, filters: dict[str, Any] | None = None) -> DataFrame:
        asked = queries.select("query_id", self.embed(F.col("query")).alias("vector"))
        found = knn.search(self.docs, asked, self.key, self.vector, top_k, keep=where(filters) if filters else None)
        return found.withColumnRenamed(self.key, "key")


@dataclass
class Static:
    """A fixed list as a retriever."""

    rows: DataFrame  # (key, score)

    def search(self, queries: DataFrame, top_k: int, filters: dict[str, Any] | None = None) -> DataFrame:
        first = lexical.top(self.rows.withColumn("g", F.lit(0)), ["g"], "score", "key", top_k).drop("g")
        return queries.select("query_id").crossJoin(F.broadcast(first))  # at most top_k rows


@dataclass(frozen=True)
class State:
    queries: DataFrame
    top_k: int
    fetch_k: int
    filters: dict[str, Any] | None = None
    lists: DataFrame | None = None
    candidates: DataFrame | None = None
    results: DataFrame | None = None

    @property
    def final(self) -> DataFrame:
        if self.results is not None:
            return self.results
        if self.candidates is None:
            raise ValueError("the pipeline has no step that makes candidates")
        return self.candidates.where(F.col("rank") <= self.top_k)


Step = Callable[[State], State]


def expand(expander: Callable) -> Step:
    """More phrasings of each query: an expander gives an array of texts of a text column; the query itself stays first."""

    def run(s: State) -> State:
        texts = F.array_distinct(F.concat(F.array("query"), F.coalesce(expander(F.col("query")), F.array().cast("array<string>"))))
        more = s.queries.select("query_id", F.posexplode(texts).alias("phrase", "query"))
        return replace(s, queries=more)

    return run


def retrieve(retrievers: Sequence[Retriever]) -> Step:
    """A list for each retriever and phrasing, ``list_id`` numbers them; a retriever's name is its place."""

    def run(s: State) -> State:
        lists = None
        phrased = "phrase" in s.queries.columns
        for i, r in enumerate(retrievers):
            asked = s.queries
            if phrased:
                asked = asked.select(F.concat_ws("\x01", "query_id", "phrase").alias("query_id"), "query")
            found = r.search(asked, max(s.fetch_k, s.top_k), s.filters)
            if phrased:
                parts = F.split("query_id", "\x01")
                kind = s.queries.schema["query_id"].dataType
                found = found.withColumns({"list_id": F.concat(F.lit(f"{i}."), parts[1]), "query_id": parts[0].cast(kind)})
            else:
                found = found.withColumn("list_id", F.lit(str(i)))
            found = found.select("query_id", "list_id", "key", "score", "rank")
            lists = found if lists is None else lists.unionByName(found)
        return replace(s, lists=lists)

    return run


def deduplicate() -> Step:
    return lambda s: replace(s, candidates=fusion.dedup_best(s.lists, "query_id", "key").select("query_id", "key", "score", "rank"))


def fuse(weights: Sequence[float] | None = None, rrf_k: int = fusion.RRF_K) -> Step:
    """Reciprocal-rank fusion; a weight is that of a retriever, whatever the number of phrasings."""

    def run(s: State) -> State:
        if not weights:
            return replace(s, candidates=fusion.rrf(s.lists, "query_id", "key", rrf_k=rrf_k))
        table = F.create_map(*[F.lit(x) for i, w in enumerate(weights) for x in (str(i), float(w))])
        weight = F.coalesce(F.try_element_at(table, F.substring_index("list_id", ".", 1)), F.lit(1.0))
        fused = s.lists.groupBy("query_id", "key").agg(F.round(F.sum(weight / (rrf_k + F.col("rank"))), 6).alias("score"))
        return replace(s, candidates=lexical.top(fused, ["query_id"], "score", "key", 2**31 - 1))

    return run


def reranked(texts: DataFrame, key: str, text: str, scorer: rerank.Scorer) -> Step:
    """The whole pool of candidates scored anew, cut to top_k. ``texts`` has the text of every key."""

    def run(s: State) -> State:
        first = s.queries.where("phrase = 0").drop("phrase") if "phrase" in s.queries.columns else s.queries
        pairs = s.candidates.join(texts.select(F.col(key).alias("key"), F.col(text).alias("text")), "key").join(first.select("query_id", "query"), "query_id")
        return replace(s, results=rerank.rerank(pairs, "query_id", "key", "query", "text", s.top_k, scorer))

    return run


@dataclass
class Pipeline:
    """Steps in order; ``run`` gives the ranked rows of every query."""

    steps: list[Step] = field(default_factory=list)

    def then(self, step: Step) -> Pipeline:
        return Pipeline([*self.steps, step])

    def run(self, queries: DataFrame, top_k: int = 5, fetch_k: int = 20, filters: dict[str, Any] | None = None) -> DataFrame:
        state = State(queries, top_k, fetch_k, filters)
        for step in self.steps:
            state = step(state)
        return state.final


def document_pipeline(retrievers: Sequence[Retriever], texts: DataFrame, key: str, text: str, scorer: rerank.Scorer | None = None, weights: Sequence[float] | None = None) -> Pipeline:
    p = Pipeline().then(retrieve(retrievers)).then(fuse(weights) if len(retrievers) > 1 else deduplicate())
    return p.then(reranked(texts, key, text, scorer)) if scorer else p


def context(rows: DataFrame, query_key: str, rank: str, text: str, tag: str) -> DataFrame:
    """(query_key, context): each query's texts under their citation tags, by rank, blank lines between."""
    block = F.concat(F.lit("["), F.col(tag), F.lit("]\n"), F.coalesce(F.col(text), F.lit("")))
    return rows.groupBy(query_key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))
