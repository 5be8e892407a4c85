import numpy as np
import pytest

from strataloom.llm import collision_knn as K
from strataloom.llm import density_peaks as D
from strataloom.llm import vectors as V

SIZE, LIMIT = 64, 0.85
SCHEMA = "chunk_uid string, embedding array<float>, rep string, v int, block string"


def data(seed=0, groups=12, each=9, noise=400, cos=0.93):
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    rows = [unit(rng.normal(size=SIZE)) for _ in range(noise)]
    for _ in range(groups):
        c = unit(rng.normal(size=SIZE))
        for _ in range(each):
            rows.append(unit(c * np.sqrt(cos) + np.sqrt(1 - cos) * unit(rng.normal(size=SIZE))))
    x = np.array(rows) * rng.uniform(0.1, 9, size=(len(rows), 1))
    names = [f"{i:05}::{i % 7}" for i in rng.permutation(len(rows))]
    return names, x.astype(np.float32)


def frame(spark, names, x, odd=()):
    rows = [(n, [float(z) for z in v], "r", 1, "b") for n, v in zip(names, x)] + [(n, v, None, None, None) for n, v in odd]
    return spark.createDataFrame(rows, SCHEMA)


def brute(names, x, k=5):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    pairs, parent = set(), np.arange(len(u))
    i, j = np.nonzero(np.round(s, 6) >= LIMIT)
    parent = D._hook(parent, i, j)
    for q in range(len(u)):
        near = sorted((-round(s[q, t], 6), names[t]) for t in np.flatnonzero(np.round(s[q], 6) >= LIMIT))[:k]
        pairs |= {(min(names[q], n), max(names[q], n)) for _, n in near}
    groups = {}
    for q in range(len(u)):
        groups.setdefault(parent[q], []).append(names[q])
    clusters = {(min(g), n) for g in groups.values() if len(g) >= 3 for n in g}
    return pairs, clusters


def found_pairs(df):
    got = K.neighbours(df, "chunk_uid", "embedding", SIZE, LIMIT, 5).collect()
    return {(min(r["chunk_uid"], r["other"]), max(r["chunk_uid"], r["other"])) for r in got}


def found_clusters(df):
    got = D.cluster(df, "chunk_uid", "embedding", SIZE, LIMIT).collect()
    assert len(got) == len({r["chunk_uid"] for r in got})
    return {(r["cluster_key"], r["chunk_uid"]) for r in got}


def test_against_brute_force(spark):
    names, x = data()
    pairs, clusters = brute(names, x)
    df = frame(spark, names, x)
    got = found_pairs(df)
    assert got <= pairs
    assert len(got) >= 0.97 * len(pairs)
    assert len(found_clusters(df) & clusters) >= 0.97 * len(clusters)


def test_recall_at_the_limit():
    rng = np.random.default_rng(4)
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    x = unit(rng.normal(size=(1500, SIZE)))
    z = rng.normal(size=x.shape)
    z = unit(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.855 * x + np.sqrt(1 - 0.855**2) * z
    i, j, c = K.search(x, y, False, LIMIT, 5)
    assert (i == j).sum() >= 0.99 * len(x)
    r = V.Routing(unit(rng.normal(size=(256, SIZE))).astype(np.float32), None, V.CAPS)
    a, b = r.of(x.astype(np.float32)), r.of(y.astype(np.float32))
    assert (V.first_shared(a, b) < 256).mean() >= 0.9


@pytest.mark.parametrize("n", [30_000, 130_000, 300_000, 1_000_000, 3_000_000, 8_000_000, 40_000_000])
def test_meeting_at_the_limit_whatever_the_size(n):
    rng = np.random.default_rng(n)
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    x = unit(rng.normal(size=(1500, SIZE)))
    z = rng.normal(size=x.shape)
    y = LIMIT * x + np.sqrt(1 - LIMIT**2) * unit(z - (z * x).sum(1, keepdims=True) * x)
    assert meeting(V.directions_for(n, SIZE), x, y) >= 0.98
    assert meeting(V.directions_for(n, SIZE, 128), x, y) >= 0.98


def test_meeting_and_windows_together():
    """A million sums of directions: meeting and the windows find over 0.9 of the pairs at the limit."""
    rng = np.random.default_rng(12)
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    x = unit(rng.normal(size=(1500, SIZE)))
    z = rng.normal(size=x.shape)
    y = 0.855 * x + np.sqrt(1 - 0.855**2) * unit(z - (z * x).sum(1, keepdims=True) * x)
    r = V.directions_for(134_000_000, SIZE, 128)
    assert r.count == 1 << 20
    i, j, _ = K.search(x, y, False, LIMIT, 5)
    assert meeting(r, x, y) * (i == j).sum() / len(x) >= 0.93


def meeting(r, x, y):
    a, b = r.of(x.astype(np.float32)), r.of(y.astype(np.float32))
    return (V.first_shared(a, b) < r.count).mean()


def test_blocks_in_turns(spark, monkeypatch):
    names, x = data(9, groups=20, each=5, noise=200, cos=0.9)
    pairs, clusters = brute(names, x)
    monkeypatch.setattr(V, "ROWS_PER_DIRECTION", 2)
    monkeypatch.setattr(D, "ROWS_PER_DIRECTION", 2)
    df = frame(spark, names, x)
    assert V.routing(V.copies(V.usable(df, "chunk_uid", "embedding", SIZE))[0], SIZE).turns > 1
    got = found_pairs(df)
    assert got <= pairs and len(got) >= 0.97 * len(pairs)
    assert len(found_clusters(df) & clusters) >= 0.97 * len(clusters)


def test_crowded_directions_are_split(spark, monkeypatch):
    names, x = data(2, groups=2, each=60, noise=100)
    pairs, clusters = brute(names, x)
    monkeypatch.setattr(V, "PART_ROWS", 20)
    df = frame(spark, names, x)
    got = found_pairs(df)
    assert got <= pairs and len(got) >= 0.97 * len(pairs)
    assert found_clusters(df) == clusters


def test_copies_and_ties(spark):
    names, x = data(3, groups=1, each=3, noise=30)
    copies = np.repeat(x[:1], 40, axis=0)
    names, x = names + [f"9{i:03}" for i in range(40)], np.r_[x, copies]
    pairs, clusters = brute(names, x)
    df = frame(spark, names, x)
    assert found_pairs(df) == pairs
    assert found_clusters(df) == clusters


def test_unusable_and_empty(spark):
    names, x = data(5, groups=1, each=4, noise=5)
    nan = [float("nan")] + [1.0] * 63
    odd = [("n1", None), ("n2", []), ("n3", [1.0] * 32), ("n4", nan), ("n5", [0.0] * 64), ("n6", [None] + [1.0] * 63), (None, [1.0] * 64), ("n7", [float("inf")] + [1.0] * 63)]
    pairs, clusters = brute(names, x)
    df = frame(spark, names, x, odd)
    assert found_pairs(df) == pairs and found_clusters(df) == clusters
    none = spark.createDataFrame([], SCHEMA)
    assert found_pairs(none) == set() and found_clusters(none) == set()


def test_repeated_rows(spark):
    names, x = data(8, groups=1, each=4, noise=10)
    pairs, clusters = brute(names, x)
    df = frame(spark, names, x)
    assert found_pairs(df.union(df)) == pairs and found_clusters(df.union(df)) == clusters


def test_profiles(spark):
    names, x = data(6, groups=1, each=4, noise=0)
    members = D.cluster(frame(spark, names, x), "chunk_uid", "embedding", SIZE, LIMIT)
    about = spark.createDataFrame([(n, t) for n, t in zip(names, ["a", None, "", "b"])], "chunk_uid string, topics string")
    (row,) = D.profiles(members, "chunk_uid", about, "topics", 3).collect()
    assert row["size"] == 4 and len(row["typical"].split("|")) == 3


def test_sums_of_directions(spark, monkeypatch):
    names, x = data(13, groups=20, each=5, noise=200, cos=0.9)
    pairs, clusters = brute(names, x)
    monkeypatch.setattr(V, "ROWS_PER_DIRECTION", 1)
    monkeypatch.setattr(D, "ROWS_PER_DIRECTION", 1)
    monkeypatch.setattr(V, "PLAIN_DIRECTIONS", 64)
    monkeypatch.setattr(V, "PART_ROWS", 6)
    df = frame(spark, names, x)
    assert V.directions_for(300, SIZE).second is not None
    got = found_pairs(df)
    assert got <= pairs and len(got) >= 0.97 * len(pairs)
    assert len(found_clusters(df) & clusters) >= 0.97 * len(clusters)


def test_more_copies_than_neighbours_asked(spark):
    names = [f"{i:02}" for i in range(12)]
    df = frame(spark, names, np.repeat(np.eye(SIZE)[:1], 12, axis=0))
    got = K.neighbours(df, "chunk_uid", "embedding", SIZE, LIMIT, 9)
    assert got.count() == 12 * 9


@pytest.mark.parametrize("n", [0, 1, 2])
def test_small_blocks(n):
    x = np.eye(SIZE)[:n]
    i, _, _ = K.search(x, x, True, LIMIT, 5)
    assert not len(i)


@pytest.mark.parametrize("found", [found_pairs, found_clusters])
def test_a_turn_has_one_copy_of_each_vector(spark, monkeypatch, found):
    names, x = data(9, groups=20, each=5, noise=700, cos=0.9)
    monkeypatch.setattr(V, "ROWS_PER_DIRECTION", 12)
    monkeypatch.setattr(D, "ROWS_PER_DIRECTION", 12)
    made, blocks = [], V.blocks

    def seen(vectors, *a, **k):
        made.append((blocks(vectors, *a, **k).count(), vectors.count()))
        return blocks(vectors, *a, **k)

    monkeypatch.setattr(V, "blocks", seen)
    assert found(frame(spark, names, x))
    assert len(made) >= 4 and all(rows < 1.6 * n for rows, n in made)


def test_neighbours_are_kept_as_short_texts_and_blocks_without_caps(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(30, SIZE)), 3, axis=0) + 0.02 * rng.normal(size=(90, SIZE))
    x[1] = x[0]
    df = spark.createDataFrame([(f"k{i:02d}", v.tolist()) for i, v in enumerate(x.astype(np.float32))], "chunk_uid string, embedding array<float>")
    carried, blocks = [], V.blocks
    monkeypatch.setattr(V, "blocks", lambda *a, **k: carried.append((b := blocks(*a, **k)).columns) or b)
    got = {(r["chunk_uid"], r["rank"]): (r["other"], r["cosine"]) for r in K.neighbours(df, "chunk_uid", "embedding", SIZE, LIMIT, 2).collect()}
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = np.round(u @ u.T, 6)
    for i in range(90):
        want = sorted((j for j in range(90) if j != i and c[i, j] >= LIMIT), key=lambda j: (-c[i, j], j))[:2]
        assert [got[f"k{i:02d}", r + 1] for r in range(2)] == [(f"k{j:02d}", c[i, j]) for j in want]
    assert carried and all("caps" not in names for names in carried)


def test_collisions_are_counted_on_bits():
    rng = np.random.default_rng(21)
    bits = rng.random((24, 5, 128)) < 0.7
    words = [np.packbits(b, axis=1, bitorder="little").view(np.uint64) for b in bits]
    for least in (1, 8, 16, 19, 24):
        got = np.unpackbits(K.at_least(words, least).view(np.uint8), axis=1, bitorder="little")
        assert (got == (bits.sum(0) >= least)).all()


def test_blocks_carry_codes_and_no_names(spark, monkeypatch):
    names, x = data(22, groups=10, each=7, noise=50)
    pairs, _ = brute(names, x)
    carried, blocks = [], V.blocks
    monkeypatch.setattr(V, "blocks", lambda *a, **k: carried.append((b := blocks(*a, **k)).first().asDict()) or b)
    got = found_pairs(frame(spark, names, x))
    assert got <= pairs and len(got) >= 0.97 * len(pairs)
    assert carried and all(len(r["vec"]) == 2 * SIZE and isinstance(r["rep"], int) for r in carried)


def test_codes_are_off_by_no_more_than_stated():
    rng = np.random.default_rng(23)
    x = rng.normal(size=(2000, SIZE)) * rng.uniform(1e-30, 1e30, size=(2000, 1))
    x[:500, 1:] *= 1e-4
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    u, c = unit(x), unit(V.coded(x).astype(np.float64))
    y, d = np.roll(u, 1, 0), np.roll(c, 1, 0)
    assert (np.abs(np.linalg.norm(u - y, axis=1) - np.linalg.norm(c - d, axis=1)) <= V.code_error(SIZE)).all()
    assert (np.abs((u * y).sum(1) - (c * d).sum(1)) <= V.code_error(SIZE)).all()


def test_more_near_vectors_than_codes_tell_apart(spark):
    """Their blocks are searched again with exact vectors; none is left out and ties go to the smaller name."""
    rng = np.random.default_rng(24)
    names, x = data(24, groups=3, each=6, noise=20)
    dense = rng.normal(size=SIZE) + 1e-4 * rng.normal(size=(K.MANY + 30, SIZE))
    names, x = names + [f"8{i:03}" for i in range(len(dense))], np.r_[x, dense.astype(np.float32)]
    assert found_pairs(frame(spark, names, x)) == brute(names, x)[0]
