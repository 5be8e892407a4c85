"""Vectors for neighbour search: usable ones, exact copies, and the blocks in which neighbours meet.

A set of random directions makes the blocks: every vector joins the ``caps`` directions it projects
farthest on. Near vectors share a direction almost surely, random ones rarely, and the number
of directions follows the number of vectors without an end. The more directions there are, the less likely two near vectors
share one of a fixed few, so ``caps`` grows with each doubling of the directions: of pairs at a cosine of
0.85 at least 94 in 100 meet whatever the size. Beyond PLAIN_DIRECTIONS a direction is the sum of one of each of two
sets, so that a million of them cost two thousand projections; these resemble each other more, which more caps make up for.
The blocks are made in turns, so that no more than TURN_CAPS copies
of a vector lie in blocks at once. The load of every direction is counted; a crowded one is split into parts by a hash,
and every pair of its parts makes a block: nothing is left out and no task holds a hot group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.session import cut, release

CAPS = 4  # directions a vector joins where there are at most 64
CAPS_MORE, SUM_CAPS_MORE = 1, 2.5  # so many more with each doubling, of plain directions and of sums
ROWS_PER_DIRECTION = 512  # the more, the fewer copies move and the more pairs a block compares
PLAIN_DIRECTIONS = 16_384
TURN_CAPS = 1  # copies of a vector that are in blocks at once
SCORES = 1 << 22  # projections held at once
PART_ROWS = 16_384  # rows of one part of a crowded direction


def usable(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(key, v): rows whose vector has ``size`` numbers, all finite, not all zero; null keys are dropped.

    A repeated key counts once, with the smallest of its vectors; where rows lie by key, that moves nothing.
    """
    v = F.col(f"`{vector}`").cast("array<float>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        df.select(F.col(f"`{key}`").alias("key"), v.alias("v"))
        .where(F.col("key").isNotNull() & F.coalesce(F.size("v") == size, F.lit(False)))
        .where(~bad & F.exists("v", lambda x: x != 0))
        .groupBy("key")
        .agg(F.min("v").alias("v"))
    )


def copies(vectors: DataFrame, k: int = 5, numbered: bool = False) -> tuple[DataFrame, DataFrame]:
    """Exact copies of a vector as one: (rep, v, named, n) and, of groups of several, members (key, rep). If ``numbered``, also ``id``, a number of each.

    ``rep`` is the smallest key of the copies, ``named`` the k + 1 smallest, so that each has k others, ``n`` their number. Only keys and hashes
    are grouped, names cut to a few within each task before the shuffle, so a group of a third of all rows
    stays small. The vectors move once, by key, and are written once, to the checkpoint folder.
    """
    marked = vectors.select("key", "v", F.xxhash64("v").alias("h"), F.hash("v").alias("h2"))
    keys, group = marked.select("key", "h", "h2"), ["h", "h2"]
    several = keys.groupBy(*group).agg(F.count("*").alias("n"), F.min("key").alias("rep")).where("n > 1")
    order = Window.partitionBy(*group).orderBy("key")
    few = keys.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    named = few.groupBy(*group).agg(F.sort_array(F.collect_list("key")).alias("named")).where(F.size("named") > 1)
    info = keys.join(several.join(named, group), group).select("key", "rep", "n", "named")
    own = F.coalesce(F.col("rep") == F.col("key"), F.lit(True))
    # what a single vector's key says already is left null, as this is written
    ids = [F.monotonically_increasing_id().alias("id")] * numbered
    all_of = cut(marked.join(info, "key", "left").select("key", "rep", "n", F.when(own, F.col("v")).alias("v"), F.when(own, F.col("named")).alias("named"), *ids))
    reps = all_of.where("v is not null").select(F.col("key").alias("rep"), "v", F.coalesce("named", F.array("key")).alias("named"), F.coalesce("n", F.lit(1)).alias("n"), *["id"] * numbered)
    return reps, all_of.where("n > 1").select("key", "rep")


@dataclass
class Routing:
    directions: np.ndarray  # a row a direction, unit length
    second: np.ndarray | None  # with it, direction i * len(second) + j is the sum of row i of the first and row j of the second
    caps: int
    crowded: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # directions in several parts, ascending
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # and how many

    def of(self, unit: np.ndarray) -> np.ndarray:
        """The directions each row joins, in ascending order."""
        caps = self.joined
        out = np.empty((len(unit), caps), np.int32)
        wide = len(self.directions) if self.second is None else len(self.directions) + len(self.second) + caps * caps
        rows = max(1, SCORES // wide)
        for a in range(0, len(unit), rows):
            x = unit[a : a + rows]
            s = x @ self.directions.T
            if self.second is None:
                out[a : a + rows] = _farthest(s, caps)
                continue
            # the largest sums are among the sums of the largest
            s2 = x @ self.second.T
            i, j = _farthest(s, min(caps, s.shape[1])), _farthest(s2, min(caps, s2.shape[1]))
            sums = (np.take_along_axis(s, i, 1)[:, :, None] + np.take_along_axis(s2, j, 1)[:, None, :]).reshape(len(x), -1)
            t = _farthest(sums, caps)
            out[a : a + rows] = np.take_along_axis(i, t // j.shape[1], 1) * len(self.second) + np.take_along_axis(j, t % j.shape[1], 1)
        return np.sort(out, axis=1)

    @property
    def count(self) -> int:
        return len(self.directions) * (1 if self.second is None else len(self.second))

    @property
    def kind(self) -> type:
        """Of the numbers of directions."""
        return np.int16 if self.count <= 1 << 15 else np.int32

    @property
    def joined(self) -> int:
        return min(self.caps, self.count)

    @property
    def turns(self) -> int:
        return -(-self.joined // TURN_CAPS)

    def parts_of(self, d: np.ndarray) -> np.ndarray:
        if not len(self.crowded):
            return np.ones(len(d), np.int64)
        at = np.minimum(np.searchsorted(self.crowded, d), len(self.crowded) - 1)
        return np.where(self.crowded[at] == d, self.parts[at], 1)


def _farthest(s: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-s, k - 1, axis=1)[:, :k]


def directions_for(n: int, size: int, rows: int | None = None, seed: int = 11) -> Routing:
    """Directions for ``n`` vectors, one for so many ``rows``."""
    m = 2 ** max(2, round(math.log2(max(1, n) / (rows or ROWS_PER_DIRECTION))))
    rng = np.random.default_rng(seed)
    plain = m <= PLAIN_DIRECTIONS
    first = m if plain else 2 ** math.ceil(math.log2(m) / 2)
    made = [rng.normal(size=(k, size)).astype(np.float32) for k in ([first] if plain else [first, m // first])]
    made = [d / np.linalg.norm(d, axis=1, keepdims=True) for d in made]
    more = round((CAPS_MORE if plain else SUM_CAPS_MORE) * math.log2(m / 64))
    return Routing(made[0], None if plain else made[1], max(CAPS, CAPS + more))


def routing(reps: DataFrame, size: int, rows: int | None = None) -> Routing:
    """Directions for so many vectors."""
    return directions_for(reps.count(), size, rows)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


BLOCK = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("side", T.IntegerType()),
        T.StructField("rep", T.StringType()),
        T.StructField("vec", T.BinaryType()),
        T.StructField("caps", T.BinaryType()),
    ]
)


def coded(x: np.ndarray) -> np.ndarray:
    """Rows as 16-bit numbers, each row with a scale of its own; code_error bounds what that does."""
    x = x.astype(np.float64)
    return np.rint(x * ((2**15 - 1) / np.abs(x).max(axis=1, keepdims=True))).astype(np.int16)


def code_error(size: int) -> float:
    """Most by which the distance of two codes at unit length is off, and their cosine: either is at most half a step off in each number, and at least 2^15 - 1 steps long."""
    return 1.05 * math.sqrt(size) / (2**15 - 1)


def routed(reps: DataFrame, route: Routing, extra: str = "", codes: bool = False) -> DataFrame:
    """(rep, vec, caps, extras): the vectors ``v`` as bytes, or their codes, with the numbers of their directions, written once for all turns.

    Counts the load of each direction, within each task before the shuffle, and tells ``route`` of the crowded ones: at most
    caps x vectors / PART_ROWS numbers.
    """
    spark = reps.sparkSession
    shared = spark.sparkContext.broadcast(route)  # at most 4 MB at 64 numbers for plain directions, less for a million sums
    names = [x.split()[0] for x in extra.split(",") if x.strip()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(np.float32)
            caps = r.of(unit_rows(x)).astype(r.kind)
            yield pdf[["rep", *names]].assign(vec=[b.tobytes() for b in (coded(x) if codes else x)], caps=[c.tobytes() for c in caps])[["rep", "vec", "caps", *names]]

    def loads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, d, n = shared.value, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for pdf in batches:
            if len(pdf):
                d, at = np.unique(np.r_[d, stack(pdf["caps"], r.kind).ravel()], return_inverse=True)
                n = np.bincount(at, np.r_[n, np.ones(len(at) - len(n))], len(d)).astype(np.int64)
        yield pd.DataFrame({"d": d, "n": n})

    schema = f"rep {reps.schema['rep'].dataType.simpleString()}, vec binary, caps binary" + (", " + extra if extra else "")
    out = cut(reps.select("rep", "v", *names).mapInPandas(run, schema))
    load = out.select("caps").mapInPandas(loads, "d bigint, n bigint").groupBy("d").agg(F.sum("n").alias("n")).where(F.col("n") > PART_ROWS)
    crowded = load.toPandas().sort_values("d")
    route.crowded = crowded["d"].to_numpy(np.int64)
    route.parts = -(-crowded["n"].to_numpy(np.int64) // PART_ROWS)
    return out


def blocks(vectors: DataFrame, route: Routing, extra: str = "", turn: int = 0, turns: int = 1, caps: bool = True, only: np.ndarray | None = None) -> DataFrame:
    """(block, side, rep, vec, caps, extras): every vector once for each block it joins, of the directions of one turn; without ``caps`` if these aren't asked for.

    ``vectors`` has (rep, vec, caps) as of ``routed``. The upper half of a block's
    number is its direction. A block of a split direction
    has the two parts as sides 0 and 1; ``extra`` names further columns to carry, with their types, ``only`` the numbers of the blocks asked for, if not all are.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(Routing(route.directions[:0], None, route.caps, route.crowded, route.parts))
    names, kind = [x.split()[0] for x in extra.split(",") if x.strip()], route.kind
    carried = ["rep", "vec", *["caps"] * caps, *names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            joined = stack(pdf["caps"], kind)
            row, place = np.nonzero(joined % turns == turn)
            d = joined[row, place].astype(np.int64)
            g = r.parts_of(d)
            own = pdf["salt"].to_numpy(np.int64)[row] % g
            # a row of part p meets every part q: block (min, max)
            rep = np.repeat(np.arange(len(row)), g)
            q = np.arange(len(rep)) - np.repeat(np.cumsum(g) - g, g)
            p = own[rep]
            lo, hi = np.minimum(p, q), np.maximum(p, q)
            block, side, at = (d[rep] << 32) | (lo << 16) | hi, (p == hi).astype(np.int32) * (lo != hi), row[rep]
            if only is not None:
                some = np.isin(block, only)
                block, side, at = block[some], side[some], at[some]
            yield pd.DataFrame({"block": block, "side": side, **{c: pdf[c].array[at] for c in carried}})

    kinds = {f.name: f.dataType.simpleString() for f in [*BLOCK, vectors.schema["rep"]] if caps or f.name != "caps"}
    schema = ", ".join(" ".join(x) for x in kinds.items()) + (", " + extra if extra else "")
    some = vectors.select("rep", "vec", "caps", F.pmod(F.xxhash64("rep"), F.lit(1 << 16)).alias("salt"), *names)
    return some.mapInPandas(run, schema)


def by_turns(vectors: DataFrame, route: Routing, extra: str, work: Callable[[DataFrame], DataFrame], caps: bool = True, only: np.ndarray | None = None) -> DataFrame:
    """What ``work`` gives for the blocks of each turn, together; a turn's blocks are let go before the next."""
    out: DataFrame | None = None
    for k in range(route.turns):
        part = cut(work(blocks(vectors, route, extra, k, route.turns, caps, only)))
        release(vectors.sparkSession)
        out = part if out is None else out.unionByName(part)
    return out


def direction_of(pdf: pd.DataFrame) -> int:
    return int(pdf["block"].iloc[0]) >> 32


def stack(column: pd.Series, kind: type) -> np.ndarray:
    """The rows of a column of bytes as a matrix."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest direction that the rows of a and b share; a large number where none."""
    out = np.full(len(a), np.iinfo(np.int32).max, np.int32)
    for k in range(a.shape[1] - 1, -1, -1):
        hit = (b == a[:, k : k + 1]).any(1)
        out[hit] = a[hit, k]
    return out
