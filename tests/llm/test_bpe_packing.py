import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import bpe, packing

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    t.encode_special_tokens = True
    return bpe.Encoder(bpe.vocabulary_path()), t


def test_known_texts(both):
    own, other = both
    texts = ["", "Hello  world\n\n x", "aaaa" * 900, "ab" * 999 + "abc", "<|endoftext|>", "don't we'll", "記憶體 тест 🧪👩‍💻", " \t　 ", "x" * 20000, "é" * 700, "\x00�"]
    assert [x.tolist() for x in own.encode(texts)] == [t.ids for t in other.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    own, other = bpe.encoder(bpe.vocabulary_path()), tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    other.encode_special_tokens = True
    assert own.encode([text])[0].tolist() == other.encode(text, add_special_tokens=False).ids


def test_frames(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a note", 0), (3, "a note", 0)], "doc_id bigint, text string, ids int")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode_corpus(df, "doc_id", "text").collect())
    note = bpe.encoder(bpe.vocabulary_path()).encode(["a note"])[0].tolist()
    assert got == [(1, []), (2, []), (3, note), (3, note)]
    assert [r["n_tokens"] for r in bpe.encode_corpus(df, "doc_id", "text", ids=False).collect()] == [0, 0, 2, 2]
    assert bpe.encode_corpus(df.where("false"), "doc_id", "text").collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_fits(sizes):
    s = np.array(sizes, np.int64)
    for c, at in (packing.sum_of_squares(s, 50), packing.join_rest(*packing.sum_of_squares(s, 50), s, 50)):
        spans = {}
        for k, o, n in zip(c, at, sizes):
            spans.setdefault(int(k), []).append((int(o), int(o + n)))
        for v in spans.values():
            v.sort()
            assert v[-1][1] <= 50 and v[0][0] == 0
            assert all(a[1] == b[0] for a, b in zip(v, v[1:]))
        assert sorted(spans) == list(range(len(spans)))


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 7, 300, 900, 2047, 2048, 2049, 9000])) for i in range(3000)] + [(9999, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint").selectExpr("*", "'x' AS container", "1 AS block")
    for block_items in (packing.BLOCK_ITEMS, 500):
        got = packing.pack(df, "doc_id", "n", block_items=block_items).collect()
        total, fill, parts = {}, {}, {}
        for r in got:
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["size"]
            parts.setdefault(r["doc_id"], []).append(r["size"])
            if r["size"]:
                fill.setdefault(r["container"], []).append((r["start"], r["size"], r["position"]))
            else:
                assert r["container"] is None and r["position"] is None
        assert total == {k: v or 0 for k, v in rows}
        assert all(len(p) == 1 for k, p in parts.items() if total[k] <= 2048)
        for v in fill.values():
            v.sort()
            assert [p for _, _, p in v] == list(range(len(v)))
            assert sum(s for _, s, _ in v) == v[-1][0] + v[-1][1] <= 2048
        assert sum(total.values()) / (2048 * len(fill)) > 0.97
    assert packing.pack(df.where("false"), "doc_id", "n").collect() == []
