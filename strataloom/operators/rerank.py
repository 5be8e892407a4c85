"""Reranking: soft scopes of code queries, pluggable scorers of (query, text) pairs."""

from __future__ import annotations

import json
import math
import shlex
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as X
from strataloom.operators.lexical import top

#: Boosts of a match of each kind of scope, and their limit.
REPO_BOOST, PATH_BOOST, MODULE_BOOST, MOST_BOOST = 0.18, 0.10, 0.12, 0.45


@dataclass(frozen=True)
class Scope:
    raw: str
    semantic: str
    repos: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    modules: tuple[str, ...] = ()

    @property
    def hints(self) -> bool:
        return bool(self.repos or self.paths or self.modules)


def parse_scope(query: str) -> Scope:
    """``repo:``, ``path:`` and ``module:`` words of a query apart from its text; quotes group, the raw text stands in for an empty rest."""
    raw = (query or "").strip()
    try:
        words = shlex.split(raw)
    except ValueError:
        words = raw.split()
    kinds: dict[str, list[str]] = {"repo": [], "path": [], "module": []}
    rest = []
    for w in words:
        kind, colon, value = w.partition(":")
        if colon and value and kind.lower() in kinds:
            kinds[kind.lower()].append(value.strip().lower())
        else:
            rest.append(w)
    found = {k: tuple(dict.fromkeys(v for v in vs if v)) for k, vs in kinds.items()}
    return Scope(raw, " ".join(rest).strip() or raw, found["repo"], found["path"], found["module"])


def scope_boost(scope: Scope, repo: Column, path: Column, name: Column) -> Column:
    """What a row's repository, path, module and name add to its score."""
    r, p, n = F.lower(F.trim(X.text_of(repo))), X.slash_path(path), F.lower(F.trim(X.text_of(name)))
    m = X.module_path(path)
    hit = lambda test, by: F.when(test, F.lit(by)).otherwise(0.0)
    terms = [hit(r.contains(t), REPO_BOOST) for t in scope.repos]
    terms += [hit(p.contains(t.replace("\\", "/")), PATH_BOOST) for t in scope.paths]
    terms += [hit(m.contains(t) | (n == t), MODULE_BOOST) for t in scope.modules]
    total = F.lit(0.0)
    for t in terms:
        total = total + t
    return F.least(F.lit(MOST_BOOST), total)


def scope_rerank(rows: DataFrame, scope: Scope, repo: str, path: str, name: str, score: str, rank: str, group: list[str]) -> DataFrame:
    """Rows with boosted scores, rounded to 4 digits, ranked anew; equal ones keep their order. Without hints, as they were."""
    if not scope.hints:
        return rows
    boosted = rows.withColumn(score, F.round(F.col(score) + scope_boost(scope, F.col(repo), F.col(path), F.col(name)), 4))
    return top(boosted.withColumnRenamed(rank, "rank_before"), group, score, "rank_before", 2**31 - 1, rank)


Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def lexical_overlap(query: pd.Series, text: pd.Series) -> pd.Series:
    """Share of the query's words that the text has: a scorer that needs no model."""

    def one(q: str | None, t: str | None) -> float:
        words = set((q or "").lower().split())
        return len(words & set((t or "").lower().split())) / len(words) if words else 0.0

    return pd.Series([one(q, t) for q, t in zip(query, text)], dtype=float)


def rerank(pairs: DataFrame, query_key: str, key: str, query: str, text: str, k: int, scorer: Scorer = lexical_overlap) -> DataFrame:
    """(query_key, key, score, rank): pairs by a scorer's rounded score, batches of Arrow at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({query_key: pdf["a"], key: pdf["b"], "score": scorer(pdf["q"], pdf["t"]).astype(float).round(6)})

    kinds = {c: pairs.schema[c].dataType.simpleString() for c in (query_key, key)}
    schema = f"{query_key} {kinds[query_key]}, {key} {kinds[key]}, score double"
    some = pairs.select(F.col(query_key).alias("a"), F.col(key).alias("b"), F.col(query).alias("q"), F.col(text).alias("t"))
    return top(some.mapInPandas(run, schema), [query_key], "score", key, k)


def parsed_scores(answer: Column, n: Column) -> Column:
    """Scores 0-10 that a model wrote as a JSON list; null unless there are n of them."""
    got = F.from_json(X.unfence(answer), "array<double>")
    return F.when(F.size(got) == n, F.transform(got, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(10.0), x))))


EXCERPT = 400  # characters of a text that a model is shown


def model_rerank(pairs: DataFrame, query_key: str, key: str, query: str, text: str, rank: str, model: Callable[[str], str], k: int) -> DataFrame:
    """(query_key, key, score, rank): each query's texts by the scores a model gives them in one answer, a JSON list of one number a text.

    An answer that isn't such a list, or a failing model, leaves the order as it was, with scores of 0. A query's texts are the few rows of a search.
    """
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in (query_key, key)}

    def scores(query: str | None, texts: list[str]) -> list[float]:
        shown = "\n\n".join(f"[{i}] {t}" for i, t in enumerate(texts))
        try:
            said = json.loads(model(f"{query}\n\n{shown}").strip())
            return [float(x) for x in said] if isinstance(said, list) and len(said) == len(texts) else [0.0] * len(texts)
        except Exception:  # noqa: BLE001  whatever a model does, the list stands
            return [0.0] * len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, place, score, rank, before = [], [], [], [], 0
            for i, (query, texts) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                s = scores(query, texts)
                best = sorted(range(len(s)), key=lambda j: (math.isnan(s[j]), -s[j]))[:k]  # noqa: B023  equal ones stay in order
                owner += [i] * len(best)
                place += [before + j for j in best]
                score += [s[j] for j in best]
                rank += range(1, len(best) + 1)
                before += len(texts)
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), batch.column(2).flatten().take(pa.array(place, pa.int64())), pa.array(score, pa.float64()), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[query_key, key, "score", "rank"])

    # only what a model is shown moves, a query's list is one row
    shown = F.coalesce(F.substring(F.col(text), 1, EXCERPT), F.lit(""))
    some = pairs.select(F.col(query_key).alias("a"), F.col(query).alias("q"), F.struct(F.col(rank).alias("r"), F.col(key).alias("b"), shown.alias("t")).alias("x"))
    lists = some.groupBy("a").agg(F.min_by("q", "x.r").alias("q"), F.sort_array(F.collect_list("x")).alias("x")).select("a", "q", "x.b", "x.t")
    return lists.mapInArrow(run, f"`{query_key}` {kinds[query_key]}, `{key}` {kinds[key]}, score double, rank bigint")


def cross_scorer(encode: Callable[[list[tuple[str, str]]], list[float]], batch: int = 64) -> Scorer:
    """A scorer of a model that reads query and text together, given batches of pairs."""

    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        both = list(zip(query.fillna(""), text.fillna("")))
        return pd.Series([x for a in range(0, len(both), batch) for x in encode(both[a : a + batch])], dtype=float)

    return score


RERANKERS: dict[str, Scorer | None] = {"none": None, "lexical": lexical_overlap}


def build_reranker(name: str) -> Scorer | None:
    if name not in RERANKERS:
        raise ValueError(f"no reranker {name!r}; there are {sorted(RERANKERS)}")
    return RERANKERS[name]
