"""Clusters of mutually similar vectors, by density peaks.

Method: the density of a vector is the number of vectors within the similarity limit, found by blocked
neighbour joins; its pointer leads to the most similar denser vector within the limit. A vector without
one is a peak; following the pointers gives every vector the label of its peak. An exact check follows: labels
whose members touch, being similar across labels, are joined, so that clusters are the sets
of vectors linked by similar pairs. Neither pairs nor links of dense groups are emitted: a
block gives each of its vectors one count, one pointer and the smallest vector it is linked to there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm import vectors as V
from strataloom.operators.graph import components
from strataloom.session import cut, release

ROWS = 512
ROWS_PER_DIRECTION = 1024  # comparing a pair is one product of matrices


def _similar(x: np.ndarray, y: np.ndarray | None, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine) of the similar pairs of rows, i < j within x if y is None, by batches of rows."""
    xf = x.astype(np.float32)
    yf = xf if y is None else y.astype(np.float32)
    y64 = x if y is None else y
    for s in range(0, len(x), ROWS):
        lo = s if y is None else 0
        dots = xf[s : s + ROWS] @ yf[lo:].T
        i, j = np.nonzero(dots >= np.float32(limit - 1e-4))
        i, j = i + s, j + lo
        if y is None:
            i, j = i[i < j], j[i < j]
        for b in range(0, len(i), 200_000):
            ib, jb = i[b : b + 200_000], j[b : b + 200_000]
            cos = np.einsum("ij,ij->i", x[ib], y64[jb])
            good = cos >= limit
            yield ib[good], jb[good], cos[good]


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    x = V.stack(pdf["vec"], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = pdf["side"].to_numpy()
    left = np.flatnonzero(side == 0)
    return x, left, np.flatnonzero(side == 1) if side.any() else None


def _pairs(pdf: pd.DataFrame, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    x, left, right = _sides(pdf)
    for i, j, c in _similar(x[left], None if right is None else x[right], limit):
        yield left[i], (left if right is None else right)[j], c


def densities(vectors: DataFrame, route: V.Routing, limit: float) -> DataFrame:
    """(rep, density, vec, caps): weighted number of similar other vectors, at least 1; vectors without any have no row.

    A pair that meets in several blocks counts in the one of the smallest direction it shares.
    """

    kind = route.kind

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        caps, n = V.stack(pdf["caps"], kind), pdf["n"].to_numpy(np.int64)
        direction = V.direction_of(pdf)
        sums = np.zeros(len(pdf), np.int64)
        for i, j, _ in _pairs(pdf, limit):
            first = V.first_shared(caps[i], caps[j]) == direction
            i, j = i[first], j[first]
            sums += np.bincount(i, n[j], len(pdf)).astype(np.int64) + np.bincount(j, n[i], len(pdf)).astype(np.int64)
        some = np.flatnonzero(sums)
        return pdf[["rep"]].iloc[some].assign(density=sums[some])

    def total(found: DataFrame) -> DataFrame:
        return found.groupBy("rep").agg(F.sum("density").alias("density"))

    found = V.by_turns(vectors, route, "n bigint", lambda b: b.groupBy("block").applyInPandas(run, "rep string, density bigint"))
    return total(found).join(vectors.select("rep", "vec", "caps"), "rep").select("rep", "density", "vec", "caps")


def _hook(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of the pairs in a forest of smallest members."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def pointers(vectors: DataFrame, route: V.Routing, limit: float) -> DataFrame:
    """(rep, to, cos, low): the most similar denser vector with its cosine, null for a peak, and the vectors it is linked to, one a block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable").reset_index(drop=True)
        names = pdf["rep"].to_numpy()
        # order of density, ties by name: the denser has the smaller place
        place = np.argsort(np.lexsort((np.arange(len(pdf)), -pdf["density"].to_numpy())))
        cos, to = np.full(len(pdf), -2.0), np.full(len(pdf), -1)
        parent = np.arange(len(pdf))
        for i, j, c in _pairs(pdf, limit):
            lower = np.where(place[i] > place[j], i, j)  # the less dense points to the other
            upper = i + j - lower
            order = np.lexsort((upper, -c, lower))
            first = order[np.r_[True, lower[order][1:] != lower[order][:-1]]] if len(order) else order
            better = first[(c[first] > cos[lower[first]]) | ((c[first] == cos[lower[first]]) & (upper[first] < to[lower[first]]))]
            cos[lower[better]], to[lower[better]] = c[better], upper[better]
            parent = _hook(parent, i, j)
        return pd.DataFrame(
            {
                "rep": names,
                "cos": cos,
                "to": [names[t] if t >= 0 else None for t in to],
                "low": names[parent],
            }
        )

    schema = "rep string, cos double, `to` string, low string"
    found = V.by_turns(vectors, route, "density bigint", lambda b: b.groupBy("block").applyInPandas(run, schema))
    best = F.max_by("to", F.when(F.col("to").isNotNull(), F.struct("cos", "to")))
    return found.groupBy("rep").agg(F.collect_set("low").alias("low"), best.alias("to"), F.max(F.when(F.col("to").isNotNull(), F.col("cos"))).alias("cos"))


def follow(pointer: DataFrame) -> DataFrame:
    """(rep, label): the end of the line of pointers ``(rep, to)``; a null pointer is its own end. Doubling rounds."""
    now = cut(pointer.select("rep", F.coalesce("to", "rep").alias("to")))
    while True:
        up = now.select(F.col("rep").alias("to"), F.col("to").alias("up"))
        now = cut(now.join(up, "to").select("rep", F.col("up").alias("to"), (F.col("up") != F.col("to")).alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("rep", F.col("to").alias("label"))


def cluster(df: DataFrame, key: str, vector: str, size: int, limit: float, least: int = 3) -> DataFrame:
    """(cluster_key, size, key, density, nearest, peak): the members of every cluster of at least ``least`` vectors.

    ``cluster_key`` is the smallest key of the cluster, ``density`` the number of similar other vectors, copies
    included, ``nearest`` the cosine to the most similar denser vector, ``peak`` whether there is none within the limit: peaks are
    chosen by a distance over that of the limit, at any density, as the limit alone says what a cluster is. Vectors that are null, of another size, not finite
    or all zero belong to none; copies are similar. Keys are unique strings. An empty table gives an empty result.
    """
    reps, members = V.copies(V.usable(df, key, vector, size))
    reps = reps.select("rep", "v", "n")
    route = V.routing(reps, size, ROWS_PER_DIRECTION)
    release(df.sparkSession)
    laid = V.routed(reps, route, "n bigint")
    # of the vectors, no more than this second copy is kept
    members, several = cut(members), cut(reps.where("n > 1").select("rep", "n"))
    del reps
    release(df.sparkSession)
    dense = cut(densities(laid, route, limit))
    del laid
    release(df.sparkSession)
    found = cut(pointers(dense, route, limit))
    release(df.sparkSession)
    dense = dense.select("rep", "density")
    label = follow(found.select("rep", "to"))
    near = found.select("rep", "cos")
    # the exact check: labels joined where a block linked their members
    linked = found.select("rep", F.explode("low").alias("low")).distinct()
    edges = (
        linked.join(label, "rep")
        .select("low", F.col("label").alias("a"))
        .join(label.select(F.col("rep").alias("low"), F.col("label").alias("b")), "low")
        .select("a", "b")
        .distinct()
    )
    whole = components(edges, "a", "b")
    placed = label.join(whole, F.col("label") == F.col("node")).select("rep", "component", (F.col("rep") == F.col("label")).alias("peak"))
    # copies without other neighbours are sets of their own
    alone = several.join(dense, "rep", "left_anti").select("rep", F.col("rep").alias("component"), F.lit(True).alias("peak"))
    placed = placed.unionByName(alone).join(several, "rep", "left").join(dense, "rep", "left").join(near, "rep", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    size_of = placed.groupBy("component").agg(F.min("rep").alias("cluster_key"), F.sum("n").alias("size")).where(F.col("size") >= least)
    rows = cut(placed.join(size_of, "component").select("cluster_key", "size", "rep", "n", "peak", F.round("cos", 6).alias("nearest"), (F.coalesce("density", F.lit(0)) + F.col("n") - 1).alias("density")))
    single = rows.where("n = 1").select("cluster_key", "size", F.col("rep").alias(key), "density", "nearest", "peak")
    copied = members.join(rows.where("n > 1"), "rep").select("cluster_key", "size", F.col("key").alias(key), "density", "nearest", "peak")
    return single.unionByName(copied)


def profiles(members: DataFrame, key: str, about: DataFrame, topic: str, typical: int = 3) -> DataFrame:
    """(cluster_key, size, peaks, typical, topics): a row a cluster, the number of its peaks, its densest members and their topics.

    ``about(key, topic)`` describes members; empty and null topics are left out.
    """
    order = Window.partitionBy("cluster_key").orderBy(F.desc("density"), F.col(key))
    top = members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= typical)
    named = top.join(about.select(key, F.nullif(F.trim(F.col(topic)), F.lit("")).alias("topic")), key, "left")
    peaks = members.where("peak").groupBy("cluster_key").agg(F.count("*").alias("peaks"))
    return named.groupBy("cluster_key").agg(
        F.max("size").alias("size"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", F.col(key).alias("k")))), lambda x: x["k"]), "|").alias("typical"),
        F.array_join(F.transform(F.filter(F.sort_array(F.collect_list(F.struct("r", F.col("topic").alias("t")))), lambda x: x["t"].isNotNull()), lambda x: x["t"]), "|").alias("topics"),
    ).join(peaks, "cluster_key").select("cluster_key", "size", "peaks", "typical", "topics")
