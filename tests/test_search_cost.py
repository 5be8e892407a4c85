"""What search looks at: blocks of documents and queries by products of matrices, terms without a pattern over every text."""

import numpy as np
import pyarrow as pa
import pytest
from test_operators import _shuffled

import __spark_entry__ as entry
from strataloom.functions import text as X
from strataloom.operators import lexical, rerank

ODD = ["", " ", None, "a", "  A b\tc\x0bd\x0ce\r\nf ", "x　y〿z＀q￯r", "再見。你好、ok", "é\xa0x\x85y\x1cz", "〄豈￰ıİΣς", "あ" * 50 + "。" * 3, "ｆｕｌｌ ｗｉｄｅ"]


def test_terms_of_prose_need_no_pattern(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD * 3)], "id int, t string").coalesce(1).orderBy("id")
    want = [r["t"] for r in df.select(X.prose_tokens(df["t"]).alias("t")).collect()]
    texts = pa.array([r["t"] for r in df.select(lexical._terms(df["t"], X.prose_tokens).alias("t")).collect()], pa.string())
    for a in (0, 5):
        terms, start = lexical._split(texts.slice(a))
        assert [terms.to_pylist()[start[i] : start[i + 1]] for i in range(len(texts) - a)] == want[a:]
    terms, start = lexical._split(pa.array([["a", "b"], None, [], ["c"]]))
    assert terms.to_pylist() == ["a", "b", "c"] and start.tolist() == [0, 2, 2, 2, 3]


@pytest.mark.parametrize("least", [0.1, -1.0])
@pytest.mark.parametrize("cells", [1_000_000, 500])
def test_scores_only_what_can_be_among_the_best(monkeypatch, least, cells):
    monkeypatch.setattr(lexical, "CELLS", cells)
    rng, k = np.random.default_rng(1), 5
    words = np.array([f"w{i}" for i in range(60)])
    docs = [words[(60 * rng.random(rng.integers(0, 30)) ** 3).astype(int)].tolist() for _ in range(1500)]
    docs[100:130] = [docs[7]] * 30  # ties, more than k
    terms = [np.sort(rng.choice(60, rng.integers(1, 6), replace=False)) for _ in range(80)]
    weight = [rng.uniform(least, 5, len(t)) for t in terms]
    avgdl = np.mean([len(d) for d in docs])
    share = np.zeros((60, 1500))
    for j, d in enumerate(docs):
        for w in set(d):
            tf = d.count(w)
            share[int(w[1:]), j] = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avgdl))
    full = np.array([np.round((w[:, None] * share[t]).sum(0), 6) for t, w in zip(terms, weight)])
    asked = lexical.Asked(np.r_[0, np.cumsum([len(t) for t in terms])], np.concatenate(terms), np.concatenate(weight))
    best, got = np.zeros((80, k)), [{} for _ in terms]
    looked = 0
    for a in range(0, 1500, 500):
        held = pa.array(docs[a : a + 500], pa.list_(pa.string()))
        for i, j, s in lexical._scored(asked, lexical._postings(held, pa.array(words), avgdl), best, 6):
            looked += len(i)
            for x, y, z in zip(i, j, s):
                got[x][a + y] = z
    for i in range(80):
        first = lambda s: sorted(s, key=lambda x: (-x[1], x[0]))[:k]
        want = first([(j, x) for j, x in enumerate(full[i]) if x > 0])
        assert [j for j, _ in first(got[i].items())] == [j for j, _ in want]
        assert np.allclose([x for _, x in first(got[i].items())], [x for _, x in want], atol=2e-6)
    if least > 0 and cells > 1000:
        assert looked < 1500 * 80 // 10


@pytest.mark.parametrize("name", ["reranked_search", "context_blocks", "model_rerank"])
def test_no_pattern_over_documents(spark, tmp_path, monkeypatch, name):
    d, calls, pattern = str(tmp_path), [], X.F.regexp_extract_all
    spark.range(50).selectExpr("id as doc_id", "concat('the fox ', id % 5) as text").write.parquet(f"{d}/documents.parquet")
    spark.range(1, 4).selectExpr("id * 100 as id", "concat('fox ', id) as question").write.parquet(f"{d}/conversation_turns.parquet")
    monkeypatch.setattr(X.F, "regexp_extract_all", lambda *a: calls.append(a) or pattern(*a))
    assert entry.queries()[name](spark, d).select("query_id").distinct().count() == 3
    assert len(calls) == 1  # the queries' texts


@pytest.mark.parametrize("name", ["context_blocks", "model_rerank"])
def test_moves_only_texts_that_were_found(spark, tmp_path, name):
    d, n, kept = str(tmp_path), 5000, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.range(n).selectExpr("id as doc_id", "concat('the fox ', id % 5) as text").write.parquet(f"{d}/documents.parquet")
    spark.range(1, 4).selectExpr("id * 100 as id", "concat('fox ', id) as question").write.parquet(f"{d}/conversation_turns.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _shuffled(spark, lambda: entry.queries()[name](spark, d).collect()) < n // 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_text_of_many_found_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "d bigint, t string")
    found = spark.createDataFrame([(q, d) for q in range(3) for d in (1, 2, 19, 40)], "q int, d bigint")
    want = sorted((q, d, f"t{d}") for q in range(3) for d in (1, 2, 19))
    for few in (100, 0):
        monkeypatch.setattr(lexical, "FEW", few)
        assert sorted((r["q"], r["d"], r["t"]) for r in lexical.with_text(found, docs, "d", "t").collect()) == want


def test_rows_split_in_pieces_give_the_same_terms(spark, monkeypatch):
    texts = pa.array(["", *ODD, "", "", "z"] * 2, pa.string())
    want, start = lexical._split(texts)
    want, start = want.to_pylist(), start.tolist()
    for size in (1, 7, 64):
        monkeypatch.setattr(lexical, "BYTES", size)
        terms, at = lexical._split(texts)
        assert terms.to_pylist() == want and at.tolist() == start


def test_model_rerank_in_batches_of_lists(spark):
    answers = {"a": "[1, NaN, 3, 1]", "b": "nonsense", "c": "[1]", "d": None, "e": " [2, 2, 5, -1] "}
    shown = spark.sparkContext.broadcast(answers)

    def model(prompt):
        q, *texts = prompt.split("\n\n")
        assert texts[0] == "[0] " + "é" * 400 and texts[1] == "[1] "
        return shown.value[q]

    texts = ["é" * 500, None, "t2", "t3"]
    pairs = spark.createDataFrame([(q, f"{q}{i}", q, texts[i], i) for q in answers for i in (2, 0, 3, 1)], "q string, d string, query string, text string, r int")
    df = rerank.model_rerank(pairs, "q", "d", "query", "text", "r", model, 3)
    got = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["q"], []).append((r["d"], r["score"], r["rank"]))
    as_it_was = lambda q: [(f"{q}{i}", 0.0, i + 1) for i in range(3)]
    assert got == {"a": [("a2", 3.0, 1), ("a0", 1.0, 2), ("a3", 1.0, 3)], "e": [("e2", 5.0, 1), ("e0", 2.0, 2), ("e1", 2.0, 3)], **{q: as_it_was(q) for q in "bcd"}}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
