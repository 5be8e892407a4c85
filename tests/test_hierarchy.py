import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import hierarchy as H
from strataloom.operators.skew import lookup


def run(spark, rows):
    df = spark.createDataFrame(rows, "id string, parent_page_id string, root_id string")
    return {r["id"]: (r["root_id"], r["depth"]) for r in H.hierarchy(df).collect()}


def brute(parents):
    out = {}
    for x in parents:
        seen, at = [x], x
        while parents[at] is not None and parents[at] not in seen:
            at = parents[at]
            seen.append(at)
        if parents[at] is None:
            out[x] = (at, len(seen) - 1)
        else:
            out[x] = (min(seen[seen.index(parents[at]) :]), -1)
    return out


def test_empty(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([], "id string, parent_page_id string")
    assert H.paths(H.resolve_parents(df, "id", "parent_page_id")).collect() == []


def test_written_differently(spark):
    a = "8b951b41-5f8d-4dfd-bd97-840e2944079b"
    forms = [a.upper(), a.replace("-", ""), "{%s}" % a, "urn:uuid:" + a, f" {a}\n"]
    got = run(spark, [(a, None, "x")] + [(f"b{i}", form, "x") for i, form in enumerate(forms)])
    assert got == {a: (a, 0), **{f"b{i}": (a, 1) for i in range(len(forms))}}


def test_roots_and_repeats(spark):
    rows = [("a", None, ""), ("b", "", ""), ("c", "gone", ""), ("d", "a", ""), ("d", "a", ""), (None, "a", "")]
    assert run(spark, rows) == {"a": ("a", 0), "b": ("b", 0), "c": ("c", 0), "d": ("a", 1)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i:03}" for i in range(150)]
    parents = {x: (rng.choice(ids) if rng.random() < 0.97 else None) for x in ids} if seed == 1 else {x: (ids[max(0, i - rng.randint(1, 3))] if i else None) for i, x in enumerate(ids)}
    if seed == 3:
        parents[ids[0]] = ids[100]
    assert run(spark, [(x, p, None) for x, p in parents.items()]) == brute(parents)


def forest(parents):
    """Path and subtree size of each node, the links between nodes of cycles left out; by brute force."""
    on_cycle = set()
    for x in parents:
        seen, at = [x], x
        while parents[at] is not None and parents[at] not in seen:
            at = parents[at]
            seen.append(at)
        if parents[at] is not None:
            on_cycle |= set(seen[seen.index(parents[at]) :])
    path = {}
    for x in parents:
        p = [x]
        while p[0] not in on_cycle and parents[p[0]] is not None:
            p.insert(0, parents[p[0]])
        path[x] = p
    return {x: (p, sum(x in q for q in path.values())) for x, p in path.items()}


def edges(spark, parents):
    return H.resolve_parents(spark.createDataFrame(list(parents.items()), "id string, parent_page_id string"), "id", "parent_page_id")


def check_paths(spark, parents):
    paths = H.paths(edges(spark, parents))
    want = forest(parents)
    assert {r["id"]: (r["path"], r["subtree_size"]) for r in paths.collect()} == want
    pairs = {(r["ancestor"], r["descendant"], r["distance"]) for r in H.descendants(paths).collect()}
    assert pairs == {(a, x, len(p) - 1 - i) for x, (p, _) in want.items() for i, a in enumerate(p)}


def test_chain_paths_and_descendants(spark):
    ids = [f"n{i:02}" for i in range(70)]
    check_paths(spark, {x: ids[i - 1] if i else None for i, x in enumerate(ids)})


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_paths_against_brute_force(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i:03}" for i in range(120)]
    parents = {x: (ids[max(0, i - rng.randint(1, seed))] if i else None) for i, x in enumerate(ids)}
    if seed == 5:  # a cycle of 40 pages with trees below it
        parents["n000"] = "n040"
    if seed == 6:
        parents = {x: rng.choice(ids) for x in ids}
    check_paths(spark, parents)


def test_below_a_cycle(spark):
    check_paths(spark, {"a": "b", "b": "a", "c": "a", **{f"d{i}": "c" for i in range(20)}, "s": "s", "t": "s"})


def test_long_chain_and_star(spark):
    rows = spark.range(20_000).selectExpr("lpad(id, 6, '0') id", "if(id = 0, null, lpad(id - 1, 6, '0')) parent_page_id")
    star = spark.range(100_000).selectExpr("concat('s', id) id", "if(id = 0, '019999', 's0') parent_page_id")
    got = H.hierarchy(rows.unionByName(star))
    assert got.where("root_id = '000000'").count() == 120_000
    assert got.agg({"depth": "max"}).first()[0] == 20_001


def test_paths_of_a_star(spark):
    star = spark.range(100_000).selectExpr("concat('s', id) id", "if(id = 0, null, 's0') parent_page_id")
    got = H.paths(H.resolve_parents(star, "id", "parent_page_id"))
    assert got.where("id = 's0'").first()["subtree_size"] == 100_000
    assert got.where("path = array('s0', id) and subtree_size = 1").count() == 99_999


def test_lookup_deals_hot_keys(spark):
    left = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'hot', if(id % 3 = 1, cast(id as string), null)) k")
    right = left.where("k is not null").groupBy("k").count()
    hot, plain = (lookup(left, right, "k", "id", n) for n in (20, 1000))
    assert sorted(hot.collect()) == sorted(plain.collect()) and hot.count() == 667
    told = lookup(left, right, "k", "id", 20, right.withColumnRenamed("count", "n"))
    assert sorted(told.collect()) == sorted(plain.collect())
    sizes = [r["count"] for r in hot.groupBy("k", F.pmod(F.xxhash64("id"), F.lit(17))).count().collect()]
    assert max(sizes) <= 3 * 20


def test_hot_root(spark):
    rows = [("r", None)] + [(f"c{i}", "r") for i in range(500)]
    got = H.hierarchy(spark.createDataFrame(rows, "id string, parent_page_id string"))
    assert got.where("depth = 1 and root_id = 'r'").count() == 500
