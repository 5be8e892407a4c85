"""Items of varying size into containers of fixed capacity.

Method: sum-of-squares online packing. A level array counts the open containers of every fill
level; each item goes where the sum of the squared counts grows least, so that no level
piles up. Items are dealt into blocks by a hash of their key; a block packs on its
own, then joins its part-filled containers, best fit in decreasing order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
BLOCK_ITEMS = 200_000  # items a block holds about; only keys and sizes come into it


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container, offset) of each item, 0 < size <= capacity, in the given order."""
    count = np.zeros(capacity + 1, np.int64)  # 0 at level 0, as an empty container is new, and at the capacity
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    container, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    n = 0
    for i, s in enumerate(sizes.tolist()):
        # growth of the sum of squares when a container moves from level h to h + s; full ones don't count
        level = count[: capacity + 1 - s]
        grow = np.where(level > 0, 2 * (count[s:] - level) + 2, np.iinfo(np.int64).max)
        if level[-1]:
            grow[-1] = 1 - 2 * level[-1]
        grow[0] = 2 * count[s] + 1 if s < capacity else 0  # a new container
        best = int(grow.min())
        h = int(np.flatnonzero(grow == best)[-1])  # of equal ones the fullest
        if h == 0:
            c, n = n, n + 1
        else:
            c = stacks[h].pop()
            count[h] -= 1
        if h + s < capacity:
            stacks[h + s].append(c)
            count[h + s] += 1
        container[i], offset[i] = c, h
    return container, offset


def join_rest(container: np.ndarray, offset: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Put part-filled containers into each other: best fit, fullest first. Numbers stay without gaps."""
    if not len(container):
        return container, offset
    fill = np.bincount(container, weights=sizes).astype(np.int64)
    into, shift = np.arange(len(fill)), np.zeros(len(fill), np.int64)
    space: list[list[int]] = [[] for _ in range(capacity + 1)]
    room = np.zeros(capacity + 1, np.int64)
    for c in np.lexsort((np.arange(len(fill)), -fill)):
        f = int(fill[c])
        fits = np.flatnonzero(room[f:])
        if len(fits):
            r = f + int(fits[0])
            t = space[r].pop()
            room[r] -= 1
            into[c], shift[c] = t, capacity - r
            left = r - f
        else:
            t, left = int(c), capacity - f
        if left:
            space[left].append(t)
            room[left] += 1
    used, number = np.unique(into, return_inverse=True)
    return number[container], offset + shift[container]


def pack(df: DataFrame, key: str, size: str, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(key, part, container, position, start, size): where each item, or part of one, lies.

    Only an item larger than the capacity is divided: into full containers and a rest that is packed
    like any item. ``position`` counts the items of a container from 0, ``start`` its tokens.
    Items of size 0 or null take no space and have a null container. Ties, repeated keys
    and empty tables are fine; other columns are not read. Containers are numbered block by block,
    so a number is unique but the numbers of blocks have gaps.
    """
    kind = df.schema[key].dataType.simpleString()
    items = df.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)).alias("n"))
    blocks = max(1, math.ceil(items.count() / block_items))
    items = items.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "n"], kind="stable")
        n = pdf["n"].to_numpy(np.int64)
        parts = np.maximum(1, -(-n // capacity))
        row = np.repeat(np.arange(len(n)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        sizes = np.minimum(capacity, n[row] - part * capacity)
        some = sizes > 0
        c, at = sum_of_squares(sizes[some], capacity)
        c, at = join_rest(c, at, sizes[some], capacity)
        container, start = np.full(len(row), -1, np.int64), np.zeros(len(row), np.int64)
        container[some], start[some] = c, at
        out = pd.DataFrame({key: pdf["k"].array[row], "part": part, "container": container, "start": start, "size": sizes})
        out = out.sort_values(["container", "start"], kind="stable")
        out["position"] = out.groupby("container").cumcount()
        block = int(pdf["block"].iloc[0])
        none = out["container"] < 0
        out["container"] = (out["container"] + block * (1 << 40)).astype("Int64").mask(none)
        out["position"] = out["position"].astype("Int64").mask(none)
        return out[[key, "part", "container", "position", "start", "size"]]

    schema = f"`{key}` {kind}, part bigint, container bigint, position bigint, start bigint, size bigint"
    return items.groupBy("block").applyInPandas(run, schema)
