"""Exact vector search: blocks of queries against every row, scores by matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import vector as VX
from strataloom.operators.lexical import top

CUBE = 4_000_000  # products or differences held at once
QUERY_BLOCK = 4096  # queries on the driver at once: 2 MB at 64 numbers


def search(
    corpus: DataFrame,
    queries: DataFrame,
    key: str,
    vector: str,
    k: int = 4,
    query_key: str = "query_id",
    query_vector: str = "vector",
    metric: str = "l2",
    keep: Column | None = None,
    least: float | None = None,
    group: str | None = None,
    only: DataFrame | None = None,
    only_column: str | None = None,
) -> DataFrame:
    """(query_key, key, score, rank): the k best rows of each query.

    ``l2`` scores 1 / (1 + squared distance), ``cosine`` the cosine; rounded to 4 digits before ranking, ties to the
    smaller key. ``keep`` filters rows before, ``least`` drops lower scores. With ``group``, a column of both sides, rows of
    the query's own group don't count. With ``only(query_key, group)``, a query that it names sees only rows with one of its groups in
    ``only_column``; it must name few groups a query, as they go along with the block. Vectors that are null or of another length than the query's are skipped.
    The query side is taken in blocks of bounded size; each block is one narrow pass over the corpus,
    and only k rows a query leave a partition.
    """
    base = corpus.where(keep) if keep is not None else corpus
    cols = [F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")] + ([F.col(group).alias("g")] if group else []) + ([F.col(only_column).alias("o")] if only is not None else [])
    base = base.where(F.col(vector).isNotNull()).select(*cols)
    asked = queries.where(F.col(query_vector).isNotNull()).select(
        F.col(query_key).alias("q"), F.col(query_vector).cast("array<double>").alias("v"), *([F.col(group).alias("g")] if group else [])
    )
    spark = corpus.sparkSession
    q_kind, k_kind = queries.schema[query_key].dataType.simpleString(), corpus.schema[key].dataType.simpleString()
    schema = f"q {q_kind}, k {k_kind}, score double"
    parts: list[DataFrame] = []
    blocks = asked.count() // QUERY_BLOCK + 1
    for b in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        pdf = block.toPandas()  # about QUERY_BLOCK rows
        if not len(pdf):
            continue
        seen: dict | None = None
        if only is not None:
            mine = only.where(F.pmod(F.xxhash64(F.col(query_key).cast(q_kind)), F.lit(blocks)) == b).toPandas()  # a few rows a query
            place = {q: i for i, q in enumerate(pdf["q"])}
            seen = {}
            for q, g in zip(mine[query_key], mine["group"]):
                seen.setdefault(g, []).append(place[q])
        shared = spark.sparkContext.broadcast((pdf["q"].to_numpy(), [np.asarray(v, float) for v in pdf["v"]], pdf["g"].to_numpy() if group else None, seen))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, vectors, groups, seen = shared.value
            size = np.array([len(v) for v in vectors])
            routed = np.zeros(len(names), bool)
            for at in (seen or {}).values():
                routed[at] = True
            lowest = -np.inf if least is None else least
            floor = np.full(len(names), lowest)  # scores that a row must reach
            held: list[pd.DataFrame] = []
            for rows in batches:
                length = rows["v"].map(len)
                for n in np.unique(length[length > 0]):
                    which = np.flatnonzero(size == n)
                    own = rows[length == n]
                    if not len(which):
                        continue
                    x, q = np.stack(own["v"].to_numpy()), np.stack([vectors[i] for i in which])
                    lx, lq = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
                    g = own["g"].to_numpy() if group else None
                    routes = own.reset_index(drop=True).groupby("o").indices if seen is not None else {}
                    step = max(1, CUBE // len(x))
                    for a in range(0, len(which), step):
                        w, part = which[a : a + step], q[a : a + step]
                        # the lower the nearer: squared distances but for what products of matrices lose, or cosines with their sign changed
                        far = part @ x.T
                        if metric == "cosine":
                            far /= -(np.where(lq[a : a + step] == 0, 1e-10, lq[a : a + step])[:, None] * np.where(lx == 0, 1e-10, lx))
                            slack = 0.0
                        else:
                            far *= -2
                            far += (lq[a : a + step] ** 2)[:, None]
                            far += lx**2
                            slack = 1e-9 * (1 + lq[a : a + step] ** 2 + (lx**2).max())
                        hidden = groups[w][:, None] == g[None, :] if group else None
                        if seen is not None:
                            may = np.zeros((len(names), len(own)), bool)
                            for o, rows_of in routes.items():
                                if o in seen:
                                    may[np.ix_(seen[o], rows_of)] = True
                            may[~routed] = True
                            hidden = ~may[w] if hidden is None else hidden | ~may[w]
                        if hidden is not None:
                            far[hidden] = np.inf
                        fresh = np.flatnonzero(floor[w] <= lowest) if len(x) > k else []
                        if len(fresh):
                            kth = np.partition(far[fresh], k - 1, axis=1)[:, k - 1] + (slack if np.isscalar(slack) else slack[fresh])
                            with np.errstate(divide="ignore", invalid="ignore"):
                                reached = -kth if metric == "cosine" else 1 / (1 + np.maximum(kth, 0))
                            floor[w[fresh]] = np.where(np.isfinite(kth), np.maximum(lowest, np.round(reached, 4) - 1e-4), lowest)
                        # scores are rounded, so all within half a step of the floor are looked at
                        low = floor[w] - 0.6e-4
                        with np.errstate(divide="ignore", invalid="ignore"):
                            bound = -low if metric == "cosine" else np.where(low > 0, 1 / low - 1 + slack, np.inf)
                        near = ~(far > bound[:, None])
                        if hidden is not None:
                            near &= ~hidden
                        i, j = np.nonzero(near)
                        if metric == "cosine":
                            s = -far[i, j]
                        else:
                            some = max(1, CUBE // n)
                            s = 1 / (1 + np.concatenate([((part[i[c : c + some]] - x[j[c : c + some]]) ** 2).sum(1) for c in range(0, max(1, len(i)), some)]))
                        s = np.round(s, 4)
                        good = np.isfinite(s) & (s >= floor[w][i])
                        i, j, s = i[good], j[good], s[good]
                        held.append(pd.DataFrame({"q": names[w[i]], "k": own["k"].array[j], "score": s, "at": w[i]}))
                        if sum(map(len, held)) > 200_000:
                            held = [_best(pd.concat(held), k)]
                            full = held[0].groupby("at")["score"].agg(["size", "min"])
                            full = full[full["size"] == k]
                            floor[full.index] = np.maximum(floor[full.index], full["min"])
            if held:
                yield _best(pd.concat(held), k)[["q", "k", "score"]]

        parts.append(base.mapInPandas(run, schema))
    if not parts:
        found = spark.createDataFrame([], schema)
    else:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
    return top(found, ["q"], "score", "k", k).select(F.col("q").alias(query_key), F.col("k").alias(key if key != query_key else "neighbour"), "score", "rank")


def _best(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    return pdf.sort_values(["q", "score", "k"], ascending=[True, False, True]).groupby("q", sort=False).head(k)


def mmr(candidates: DataFrame, query_key: str, key: str, vector: str, score: str, k: int = 4, weight: float = 0.5) -> DataFrame:
    """(query_key, key, rank): k of each query's candidates, each balancing its score against likeness to those chosen.

    Candidates of a query are the few rows of a search, so each query is one small group.
    """
    kind = f"{query_key} {candidates.schema[query_key].dataType.simpleString()}, {key} {candidates.schema[key].dataType.simpleString()}, rank bigint"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, key], ascending=[False, True]).reset_index(drop=True)
        x = np.stack(pdf[vector].to_numpy()).astype(float)
        length = np.linalg.norm(x, axis=1)
        x = x / np.where(length == 0, 1e-10, length)[:, None]
        s = pdf[score].to_numpy(float)
        chosen: list[int] = []
        most = np.full(len(pdf), -1.0)
        while len(chosen) < min(k, len(pdf)):
            gain = weight * s - (1 - weight) * (most if chosen else 0)
            gain[chosen] = -np.inf
            best = int(np.argmax(gain))
            chosen.append(best)
            most = np.maximum(most, x @ x[best])
        out = pdf.loc[chosen, [query_key, key]]
        out["rank"] = np.arange(1, len(out) + 1)
        return out

    return candidates.select(query_key, key, vector, score).groupBy(query_key).applyInPandas(run, kind)


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid, n): the mean vector of each group, combined before the shuffle; empty groups are left out."""
    long = df.where(F.col(group).isNotNull() & (F.col(group).cast("string") != "") & F.col(vector).isNotNull()).select(
        group, F.posexplode(F.col(vector).cast("array<double>")).alias("p", "x")
    )
    mean = long.groupBy(group, "p").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return mean.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("centroid"), F.max("n").alias("n"))


def representatives(df: DataFrame, cluster: str, key: str, vector: str, k: int = 5) -> DataFrame:
    """(cluster, key, distance, rank): the rows nearest to the centroid of their cluster."""
    c = centroids(df, cluster, vector)
    d = df.join(c, cluster).select(cluster, key, F.round(F.sqrt(VX.squared_distance(F.col(vector), F.col("centroid"))), 4).alias("distance"))
    return top(d.withColumn("near", -F.col("distance")), [cluster], "near", key, k).drop("near")
