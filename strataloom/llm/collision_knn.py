"""The k most similar vectors of every vector.

Method: collision-counting hashing. Within a block of vectors.blocks, each of PROJECTIONS single projections
puts the vectors into a sorted array of unit-width slots. A query's window is centred on its own
slot and grows by virtual rehashing: the slots within radius r, cr, c^2 r of one array count as one bucket,
nothing is hashed again. Vectors that lie in the query's window in at least so many arrays collide;
only these can become neighbours. A query is done once k neighbours are closer
than the radius vouches for; the last radius is that of the similarity limit.

Blocks hold codes of the vectors, by which a distance is off by no more than vectors.code_error: all that may be among the
k nearest are candidates, and once these are merged their exact cosines decide. A block with too many
candidates to tell apart by codes is searched again with exact vectors.

The method alone would have every window at the limit's radius hold a fixed share of all vectors, which
doesn't scale; the blocks bound that share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import vectors as V
from strataloom.operators.skew import lookup
from strataloom.session import cut, release

PROJECTIONS = 24
COLLISIONS = 19  # of 24 windows of two standard deviations: a neighbour at the radius fails with 2 in 1000
SLOTS = 16  # half width of the last window
RADII = (4, 8, 16)  # half widths of the windows, c = 2
SLACK = 1.6  # wider slice of the first array alone, 3.2 standard deviations, as all candidates come from it
ROWS = 256  # queries handled at once
WORD = 64  # bits
WORTH = 0.25  # a smaller radius that finishes a smaller share of its queries isn't tried again in a block
MANY = 64  # candidates of a vector beyond which its block is searched with exact vectors
CANDIDATE = np.dtype([("other", "<i8"), ("apart", "<f4")])  # a number, and the distance by codes


def search(x: np.ndarray, y: np.ndarray, same: bool, limit: float, k: int, seed: int = 5, loose: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine): for the queries x, rows of y with a rounded cosine of ``limit`` or more, the k nearest among them.

    Rows are float64 vectors of unit length; if ``same``, x is y and a row isn't its own neighbour. Cosines may be off by
    ``loose``: so much below the limit is given too.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    empty = np.zeros(0, np.int64)
    if not len(x) or not len(y):
        return empty, empty, np.zeros(0)
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(x.shape[1], PROJECTIONS))
    a = (a / np.linalg.norm(a, axis=0)).astype(np.float32)
    far = math.sqrt(2 - 2 * limit)  # distance at the limit
    width = 2.0 * far / math.sqrt(x.shape[1]) / SLOTS  # of a slot: the last window is two standard deviations
    px, py = (x.astype(np.float32) @ a) / width, (y.astype(np.float32) @ a) / width
    # the first array orders both sides: its windows are slices of it
    ox, oy = np.argsort(px[:, 0], kind="stable"), np.argsort(py[:, 0], kind="stable")
    qx, qy = px[ox, 0], py[oy, 0]
    sx, sy = (np.floor(p).astype(np.int32).T for p in (px[ox], py[oy]))
    low = sy.min(axis=1)
    maps = [_prefixes(s - b) for s, b in zip(sy, low)]
    xs, ys = x[ox], y[oy]
    xf, yf = xs.astype(np.float32), ys.astype(np.float32)
    radii = list(RADII)
    for s in range(0, len(xs), ROWS):
        active = np.arange(s, min(len(xs), s + ROWS))
        for r in tuple(radii):
            lo = int(np.searchsorted(qy, qx[active[0]] - SLACK * r - 1)) // WORD * WORD
            hi = int(np.searchsorted(qy, qx[active[-1]] + SLACK * r + 1, "right"))
            if hi <= lo:
                continue
            words = slice(lo // WORD, -(-hi // WORD))
            inside = []
            for m, at in zip(maps, sx[:, active] - low[:, None]):
                upper, under = (np.clip(at + z, 0, len(m) - 1) for z in (r + 1, -r))
                inside.append(m[upper, words] & ~m[under, words])
            collide = at_least(inside, COLLISIONS).view(np.uint8)
            # the cosines of all of a slice are one product, cheaper than to gather what collides
            i, j = np.nonzero(xf[active] @ yf[lo:hi].T >= limit - loose - 1e-4)
            hit = (collide[i, j >> 3] >> (j & 7).astype(np.uint8)) & 1 > 0
            i, j = active[i[hit]], j[hit] + lo
            if same:
                i, j = i[i != j], j[i != j]
            cos = np.empty(len(i))
            for b in range(0, len(i), 100_000):
                c = slice(b, b + 100_000)
                cos[c] = np.einsum("ij,ij->i", xs[i[c]], ys[j[c]])
            good = np.round(cos, 6) >= limit - loose
            i, j, cos = i[good], j[good], cos[good]
            # done: k neighbours as near as this radius vouches for
            d = far * r / SLOTS
            sure = np.bincount(i[cos >= 1 - d * d / 2 + 2 * loose] - s, minlength=ROWS)[active - s] >= k
            if r != RADII[-1] and sure.mean() < WORTH:
                radii.remove(r)
            finished = active[sure] if r != RADII[-1] else active
            take = np.isin(i, finished)
            out.append((ox[i[take]], oy[j[take]], cos[take]))
            active = active[~np.isin(active, finished)]
            if not len(active):
                break
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (empty, empty, np.zeros(0))  # type: ignore[return-value]


def _prefixes(slots: np.ndarray) -> np.ndarray:
    """Row t has a bit for each of the slots, in words: whether it is below t. A window is the difference of two rows."""
    below = np.zeros((int(slots.max()) + 2, -(-len(slots) // WORD) * WORD), bool)
    np.less(slots, np.arange(len(below))[:, None], out=below[:, : len(slots)])
    return np.packbits(below, axis=1, bitorder="little").view(np.uint64)


def at_least(bits: list[np.ndarray], least: int) -> np.ndarray:
    """The bits that are set in so many of the arrays, counted for 64 at once: binary counters whose digits are arrays."""
    digits, of = [], list(bits)
    while of:
        carry = []
        while len(of) > 1:
            a, b = of.pop(), of.pop()
            odd, both = a ^ b, a & b
            if of:
                c = of.pop()
                odd, both = odd ^ c, both | (odd & c)
            of.append(odd)
            carry.append(both)
        digits.append(of[0])
        of = carry
    more, same = np.zeros_like(bits[0]), ~np.zeros_like(bits[0])
    for k in reversed(range(max(len(digits), least.bit_length()))):
        digit = digits[k] if k < len(digits) else np.zeros_like(more)
        if not least >> k & 1:
            more |= same & digit
            digit = ~digit
        same &= digit
    return more | same


def best(owner: np.ndarray, other: np.ndarray, cos: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each owner the k rows with the highest rounded cosine, equal ones by the smaller name."""
    rounded = np.round(cos, 6)
    rank = np.argsort(np.argsort(names, kind="stable"), kind="stable")[other]
    order = np.lexsort((rank, -rounded, owner))
    o = owner[order]
    start = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
    place = np.arange(len(o)) - np.repeat(start, np.diff(np.r_[start, len(o)]))
    keep = order[place < k]
    return owner[keep], other[keep], rounded[keep]


def candidates(owner: np.ndarray, apart: np.ndarray, k: int, off: float) -> np.ndarray:
    """Of each owner, the rows that may be among its k nearest if distances are ``off`` by so much at most, by owner.

    With those whose cosines may be equal to that of the k-th when rounded: two millionths are 4e-6 of a square of a distance.
    """
    order = np.lexsort((apart, owner))
    o, d = owner[order], apart[order].astype(np.float64)
    start = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(o)])
    kth = d[start + np.minimum(k, size) - 1] if len(o) else d
    return order[d <= np.repeat(np.sqrt((kth + off) ** 2 + 4e-6) + off, size)]


def lists(owner: np.ndarray, other: np.ndarray, cos: np.ndarray, names: np.ndarray) -> pd.DataFrame:
    """(rep, near): the rows of each owner, in order of owners, as one text of CANDIDATE."""
    c = np.empty(len(owner), CANDIDATE)
    c["other"], c["apart"] = names[other], distance(cos)
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    whole, at = c.tobytes(), np.r_[start, len(owner)] * CANDIDATE.itemsize
    return pd.DataFrame({"rep": names[owner[start]], "near": pd.Series([whole[a:b] for a, b in zip(at[:-1], at[1:])], dtype=object)})


def distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cos))


def neighbours(df: DataFrame, key: str, vector: str, size: int, limit: float, k: int = 5) -> DataFrame:
    """(key, other, cosine, rank): the k most similar other vectors of each, if their cosine is at least ``limit``.

    Cosines are rounded to six decimals; equal ones go to the smaller key, by bytes. Vectors that are null, of another
    size, not finite or all zero have no neighbours; copies are neighbours with cosine 1. Keys are
    strings and unique. An empty table gives an empty result.
    """
    reps, members = V.copies(V.usable(df, key, vector, size), k, numbered=True)
    route = V.routing(reps, size)
    release(df.sparkSession, wait=1.0)
    codes = V.routed(reps.select(F.col("id").alias("rep"), "v"), route, codes=True)
    members, groups = cut(members), cut(reps.where("n > 1").select("rep", "named"))
    release(df.sparkSession)
    off = V.code_error(size)  # of a distance, and of a cosine

    def near(x: np.ndarray, side: np.ndarray, loose: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = x.astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        if not side.any():
            return search(x, x, True, limit, k, loose=loose)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j, c = search(x[left], x[right], False, limit, k, loose=loose)
        i2, j2, c2 = search(x[right], x[left], False, limit, k, loose=loose)
        return np.r_[left[i], right[i2]], np.r_[right[j], left[j2]], np.r_[c, c2]

    def by_codes(pdf: pd.DataFrame) -> pd.DataFrame:
        owner, other, cos = near(V.stack(pdf["vec"], np.int16), pdf["side"].to_numpy(), off)
        keep = candidates(owner, distance(cos), k, off)
        owner, other, cos = owner[keep], other[keep], cos[keep]
        if len(owner) and np.bincount(owner).max() > MANY:
            return pd.DataFrame({"rep": pdf["block"].iloc[:1], "near": [None]})
        return lists(owner, other, cos, pdf["rep"].to_numpy())

    def by_vectors(pdf: pd.DataFrame) -> pd.DataFrame:
        owner, other, cos = near(V.stack(pdf["vec"], np.float32), pdf["side"].to_numpy(), 0.0)
        return lists(*best(owner, other, cos, pdf["name"].to_numpy(str), k), pdf["rep"].to_numpy()) if len(owner) else lists(owner, other, cos, owner)

    schema = "rep bigint, near binary"
    found = V.by_turns(codes, route, "", lambda b: b.groupBy("block").applyInPandas(by_codes, schema), caps=False)
    del codes
    release(df.sparkSession, wait=1.0)
    # blocks with more near vectors than codes tell apart: at most a number for each block
    dense = [r["rep"] for r in found.where("near is null").select("rep").collect()]
    if dense:
        laid = V.routed(reps.select(F.col("id").alias("rep"), "v", F.col("rep").alias("name")), route, "name string")
        more = V.by_turns(laid, route, "name string", lambda b: b.groupBy("block").applyInPandas(by_vectors, schema), caps=False, only=np.array(dense))
        found = found.where("near is not null").unionByName(more)
        del laid, more

    def pairs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            whole = [b"".join(x) for x in pdf["near"]]
            owner = np.repeat(np.arange(len(whole)), [len(x) // CANDIDATE.itemsize for x in whole])
            c = np.frombuffer(b"".join(whole), CANDIDATE)
            # a pair that met in several blocks counts once
            order = np.lexsort((c["apart"], c["other"], owner))
            owner, c = owner[order], c[order]
            new = np.r_[True, (owner[1:] != owner[:-1]) | (c["other"][1:] != c["other"][:-1])] if len(c) else np.zeros(0, bool)
            owner, c = owner[new], c[new]
            keep = candidates(owner, c["apart"], k, off)
            a, b = pdf["rep"].to_numpy(np.int64)[owner[keep]], c["other"][keep]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "way": np.where(a < b, 1, 2)})

    wanted = found.groupBy("rep").agg(F.collect_list("near").alias("near")).mapInPandas(pairs_of, "a bigint, b bigint, way int")
    # ways: 1, b is a candidate of a; 2, a is one of b
    pairs = cut(wanted.repartition("a").groupBy("a", "b").agg(F.bit_or("way").alias("way")))
    del found, wanted
    release(df.sparkSession, wait=1.0)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = cut(reps.join(ids.hint("merge"), "id", "left_semi").select("id", F.col("rep").alias("name"), "v", F.when(F.col("n") > 1, F.col("named")).alias("named")))
    del reps
    release(df.sparkSession, wait=1.0)

    def texts(pdf: pd.DataFrame) -> Iterator[tuple[str, str]]:
        x, y = (np.stack(pdf[c].to_numpy()).astype(np.float64) for c in ("v_a", "v_b"))
        x, y = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x, y))
        cos = np.round(np.einsum("ij,ij->i", x, y), 6)
        rows = zip(cos >= limit, entry_number(cos).tolist(), pdf["way"], pdf["name_a"], pdf["named_a"], pdf["name_b"], pdf["named_b"])
        for _, n, way, a, named_a, b, named_b in (r for r in rows if r[0]):
            # several names of one vector: its copies, all with the same cosine to others
            if way & 1:
                yield from ((a, f"{n:07d}{z}") for z in ([b] if named_b is None else named_b[:k]))
            if way & 2:
                yield from ((b, f"{n:07d}{z}") for z in ([a] if named_a is None else named_a[:k]))

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame(texts(pdf), columns=["rep", "near"], dtype=object)

    side = lambda s: held.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("name", "v", "named")])
    counts = pairs.groupBy("b").agg(F.count("*").alias("n"))
    both = lookup(lookup(pairs, side("a"), "a", "b"), side("b"), "b", "a", counts=counts)
    merged = cut(both.mapInPandas(verified, "rep string, near string").groupBy("rep").agg(F.slice(F.sort_array(F.collect_list("near")), 1, k).alias("near")))
    del held, pairs, both, counts
    release(df.sparkSession)
    # every member of a group of copies: its copies first, then the neighbours of the group
    alone = merged.join(groups, "rep", "left_anti").select(F.col("rep").alias("key"), "rep")
    full = members.select("key", "rep").unionByName(alone).join(merged, "rep", "left").join(groups, "rep", "left")
    none = F.array().cast("array<string>")
    same = F.transform(F.filter(F.coalesce("named", none), lambda n: n != F.col("key")), lambda n: F.concat(F.lit("0000000"), n))
    all_of = F.slice(F.sort_array(F.concat(same, F.coalesce("near", none))), 1, k)
    return full.select("key", F.posexplode(all_of).alias("r", "x")).select(
        F.col("key").alias(key),
        F.expr("substring(x, 8)").alias("other"),
        ((F.lit(1_000_000) - F.substring("x", 1, 7).cast("int")) / F.lit(1e6)).alias("cosine"),
        (F.col("r") + 1).cast("bigint").alias("rank"),
    )


def entry_number(cos: np.ndarray) -> np.ndarray:
    """Millionths that rounded cosines are below 1: seven digits before a name make one text of a neighbour, by which lists are sorted."""
    return np.maximum(0, 1_000_000 - np.rint(cos * 1e6)).astype(np.int64)
