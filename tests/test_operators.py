"""Operators on small inline tables, with the values they must give."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions import text as X
from strataloom.operators import chunking, code, evaluate, facets, filters, fusion, graph, history, index, knn, knowledge, lexical, memory, pipeline, rerank


def one(spark, column, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("RAGEngine", ["rag", "engine"]),
        ("content_hash", ["content", "hash"]),
        ("_DEFAULT_COLLECTION_NAMES", ["default", "collection", "names"]),
        ("__init__", ["init"]),
        ("RAGEngine.retrieve", ["rag", "engine", "retrieve"]),
        ("index()", ["index"]),
        ("BM25Index", ["bm", "25", "index"]),
        ("", []),
        (None, []),
    ],
)
def test_code_tokens(spark, text, tokens):
    assert one(spark, X.code_tokens, text) == tokens


@pytest.mark.parametrize(
    "text, slug",
    [("RAG Retrieval", "topic_rag_retrieval"), ("topic: agents", "topic_agents"), ("label: LLM Fine-Tuning!", "topic_llm_fine_tuning"), ("a" * 50, "topic_" + "a" * 40), (None, "topic_")],
)
def test_slug(spark, text, slug):
    assert one(spark, X.slug, text) == slug


def test_text_functions(spark):
    assert one(spark, X.prose_tokens, "Hello,  World　再見。ok") == ["hello,", "world", "再見", "ok"]
    assert one(spark, X.shorten, "x" * 12001).count("x") == 12000
    assert one(spark, X.shorten, "short") == "short"
    assert [one(spark, X.visibility, n) for n in ("__init__", "A._x", "A.run", "____")] == ["dunder", "private", "public", "private"]
    assert [one(spark, X.path_language, p) for p in ("a/b.py", "Makefile", "x.tsx", "none")] == ["Python", "Makefile", "TypeScript", ""]
    assert [one(spark, X.is_test_path, p) for p in ("tests/a.py", "a\\test_b.py", "src/a.spec.ts", "src/latest.py")] == [True, True, True, False]
    assert [one(spark, X.is_generated_path, p) for p in ("build/a", "x_pb2.py", "src/a.py")] == [True, True, False]
    assert one(spark, X.parse_id, "r::p.py::class::A::B")["name"] == "A::B"
    assert one(spark, X.parse_id, "r::p.py::class") is None
    assert one(spark, X.unfence, 'ok\n```json\n{"a": [1]}\n```') == '{"a": [1]}'
    got = one(spark, X.hash_embedding, "abc")
    assert [round(v, 5) for v in got[:4]] == [0.72941, 0.47059, 0.08627, 0.74902] and len(got) == 16


def test_filters(spark):
    rows = [("d1", "w", "pdf", "a,b", "2024-01-05T10:00:00+00:00"), ("d2", "w", "text", "b", "2024-02-01T00:00:00+00:00"), ("d3", None, "pdf", None, None)]
    df = spark.createDataFrame(rows, "doc_id string, workspace string, document_type string, tags string, created_time string")
    ids = lambda w: sorted(r["doc_id"] for r in df.where(filters.where(w)).collect())
    assert ids(None) == ids({}) == ["d1", "d2", "d3"]
    assert ids({"doc_id": "d1"}) == ["d1"] and ids({"doc_id": {"$in": ["d1", "d3"]}}) == ["d1", "d3"]
    assert ids({"tags": {"$contains": "a"}}) == ["d1"] and ids({"tags": {"$unknown": 1}}) == ["d1", "d2", "d3"]
    assert ids({"$or": [{"doc_id": "d2"}, {"workspace": ""}]}) == ["d2", "d3"]
    f = filters.SearchFilter(workspace="w", created_after="2024-01-05", created_before="2024-01-31")
    assert ids(f.to_where()) == ["d1"] and not f.is_empty() and "workspace=w" in f.summary()
    assert filters.SearchFilter().to_where() is None and filters.SearchFilter().summary() == "off"
    assert filters.effective(filters.SearchFilter(), "d") == {"doc_id": {"$eq": "d"}}
    assert filters.merge_filters({"$and": [{"a": 1}, {"b": 2}]}, {"c": 3}) == {"$and": [{"a": 1}, {"b": 2}, {"c": 3}]}
    assert filters.repo_filter(["r"]) == {"repo_id": {"$eq": "r"}} and filters.normalize_ids([" a ", "", None, "a", "b"]) == ["a", "b"]
    assert df.where(filters.has_value(F.col("tags"), "b")).count() == 2


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, None), (4, "")], "id int, text string")
    q = spark.createDataFrame([(1, "fox"), (2, "none"), (3, None)], "query_id int, query string")
    got = lexical.search(docs, q, "id", "text", 5).collect()
    assert [(r["query_id"], r["id"], r["rank"]) for r in got] == [(1, 1, 1)]
    assert lexical.search(docs, q, "id", "text", 5, keep=F.col("id") > 1).count() == 0


def test_knn_and_mmr(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "a"), (3, [0.0, 1.0], "b"), (4, None, "b"), (5, [1.0], "b")], "id int, v array<double>, g string")
    q = spark.createDataFrame([(7, [1.0, 0.0], "a")], "query_id int, vector array<double>, g string")
    got = knn.search(docs, q, "id", "v", 2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(1, 1.0), (2, round(1 / 1.02, 4))]
    assert [r["id"] for r in knn.search(docs, q, "id", "v", 2, metric="cosine", group="g").collect()] == [3]
    assert knn.search(docs.where("false"), q, "id", "v", 2).count() == 0 and knn.search(docs, q.where("false"), "id", "v", 2).count() == 0
    found = knn.search(docs, q, "id", "v", 3).join(docs.select("id", "v"), "id")
    assert [r["id"] for r in knn.mmr(found, "query_id", "id", "v", "score", 2, 0.3).orderBy("rank").collect()] == [1, 3]


def _shuffled(spark, run):
    """Records that the shuffles of ``run`` write."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()

    def stages():
        listed = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteRecords() for s in (listed.apply(i) for i in range(listed.size()))}

    before = stages()
    run()
    time.sleep(0.5)
    return sum(n for i, n in stages().items() if i not in before)


def test_bm25_moves_no_pairs(spark):
    docs = spark.range(2000).selectExpr("id", "concat('the fox ', id % 50) as text")
    q = spark.range(200).selectExpr("id as query_id", "concat('the ', id % 50) as query")
    want = lambda i: [(i % 50 + 50 * r, r + 1) for r in range(3)]
    out = []
    # every query shares a word with every document: 400,000 pairs
    moved = _shuffled(spark, lambda: out.extend(lexical.search(docs, q, "id", "text", 3).collect()))
    assert moved < 40_000
    got = {i: sorted(((r["id"], r["rank"]) for r in out if r["query_id"] == i), key=lambda x: x[1]) for i in range(200)}
    assert got == {i: want(i) for i in range(200)}
    # a repeated term counts repeatedly, in any number of blocks
    twice = spark.createDataFrame([(1, "fox 7"), (2, "fox 7 7"), (3, "7 fox")], "query_id int, query string")
    score = lambda: {r["query_id"]: r["score"] for r in lexical.search(docs.where("id < 60"), twice, "id", "text", 1).collect()}
    one = score()
    assert one[1] == one[3] < one[2]
    whole, lexical.TERM_BLOCK = lexical.TERM_BLOCK, 1
    try:
        assert score() == one
    finally:
        lexical.TERM_BLOCK = whole


def test_nearest_by_brute_force(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(900, 6)).round(1), rng.normal(size=(40, 6)).round(1)
    x[100:140] = x[200]  # ties, more than k
    y[0] = x[200]
    docs = spark.createDataFrame([(i, v.tolist(), i % 7) for i, v in enumerate(x)], "id int, v array<double>, g int")
    q = spark.createDataFrame([(i, v.tolist(), i % 7) for i, v in enumerate(y)], "query_id int, vector array<double>, g int")
    squares = ((y[:, None] - x[None]) ** 2).sum(2)
    cosines = (y @ x.T) / (np.linalg.norm(y, axis=1)[:, None] * np.linalg.norm(x, axis=1))
    allowed = np.arange(40)[:, None] % 7 != np.arange(900)[None] % 7
    whole, knn.CUBE = knn.CUBE, 5_000
    try:
        for metric, s in (("l2", 1 / (1 + squares)), ("cosine", cosines)):
            for group in (None, "g"):
                s = np.round(s, 4)
                shown = s if group is None else np.where(allowed, s, -np.inf)
                want = {(i, j, r + 1) for i in range(40) for r, j in enumerate(np.lexsort((np.arange(900), -shown[i]))[:20].tolist())}
                got = knn.search(docs, q, "id", "v", 20, metric=metric, group=group).collect()
                assert {(r["query_id"], r["id"], r["rank"]) for r in got} == want
    finally:
        knn.CUBE = whole


def test_rrf(spark):
    lists = lambda rows: spark.createDataFrame(rows, "query_id int, list_id string, key string, rank int, score double")
    got = {r["key"]: r["score"] for r in fusion.rrf(lists([(1, "a", "a", 1, 0.0), (1, "b", "b", 1, 0.0)]), "query_id", "key").collect()}
    assert got == {"a": 0.016393, "b": 0.016393}
    shared = fusion.rrf(lists([(1, "a", "s", 1, 0.0), (1, "a", "x", 2, 0.0), (1, "b", "s", 1, 0.0), (1, "b", "y", 2, 0.0)]), "query_id", "key").orderBy("rank").collect()
    assert shared[0]["key"] == "s" and len(shared) == 3
    heavy = fusion.rrf(lists([(1, "a", "h", 1, 0.0), (1, "b", "l", 1, 0.0)]), "query_id", "key", {"a": 10.0}).orderBy("rank").collect()
    assert heavy[0]["key"] == "h"


def test_scope():
    s = rerank.parse_scope('repo:Core path:"src/a b" find module:x the thing')
    assert (s.repos, s.paths, s.modules, s.semantic) == (("core",), ("src/a b",), ("x",), "find the thing")
    assert rerank.parse_scope("repo:a").semantic == "repo:a" and not rerank.parse_scope("").hints
    assert rerank.parse_scope('say "open').semantic == 'say "open'
    with pytest.raises(ValueError):
        rerank.build_reranker("missing")


def test_pipeline(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "blue fox", "green dog"])], "id int, text string")
    q = spark.createDataFrame([(1, "fox red")], "query_id int, query string")
    lex = pipeline.Lexical(docs, "id", "text")
    p = pipeline.document_pipeline([lex], docs, "id", "text", rerank.lexical_overlap)
    assert [r["key"] for r in p.run(q, 2).orderBy("rank").collect()] == [0, 1]
    more = pipeline.Pipeline().then(pipeline.expand(lambda c: F.array(F.lit("dog")))).then(pipeline.retrieve([lex])).then(pipeline.fuse([1.0]))
    assert {r["key"] for r in more.run(q, 5).collect()} == {0, 1, 2}


def test_hash_diff_and_upsert(spark):
    old = spark.createDataFrame([("keep", "s"), ("change", "old"), ("gone", "h"), ("blank", "")], "id string, h string")
    new = spark.createDataFrame([("keep", "s"), ("change", "new"), ("fresh", "h2"), ("blank", "h1")], "id string, h string")
    got = {r["id"]: r["change"] for r in index.diff(old, new, "id", "h").collect()}
    assert got == {"keep": "skipped", "change": "modified", "gone": "deleted", "fresh": "added", "blank": "modified"}
    once = index.upsert(old, new, "id", prune=True)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, new.collect())) == sorted(map(tuple, index.upsert(once, new, "id", prune=True).collect()))
    assert index.upsert(old, new.where("false"), "id", prune=True).count() == 4


def test_store(spark, tmp_path):
    s = index.Store(spark, str(tmp_path))
    rows = lambda r: spark.createDataFrame(r, "id string, h string")
    assert s.sync("t", rows([("a", "1"), ("b", "1")]), "id", "h")["added"] == 2
    assert s.sync("t", rows([("a", "2"), ("c", "1")]), "id", "h", prune=True) == {"added": 1, "modified": 1, "skipped": 0, "deleted": 1}
    assert sorted(r["id"] for r in s.read("t").collect()) == ["a", "c"]
    assert s.delete("t", F.col("id") == "a") == 1 and s.delete("t", F.col("id") == "a") == 0


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, k, i + 1) for i, k in enumerate("CABDE")], "query_id int, key string, rank int")
    labels = spark.createDataFrame([(1, "A"), (1, "B"), (2, "Z")], "query_id int, key string")
    got = {r["query_id"]: r for r in evaluate.metrics(ranked, labels, 5).collect()}
    assert got[1]["mrr"] == 0.5 and got[1]["recall"] == 1.0 and abs(got[1]["ndcg"] - 0.6934) < 1e-4
    assert (got[2]["recall"], got[2]["mrr"], got[2]["ndcg"]) == (0.0, 0.0, 0.0)
    assert evaluate.metrics(ranked, labels, 1).where("query_id = 1").first()["recall"] == 0.0


def test_evolution(spark):
    none: dict = {}
    rows = [
        ("r", "f", 1, "A", "1", ["foo", "bar", "x", "back"], {"foo": "v1", "x": "h1"}),
        ("r", "f", 2, "B", "2", ["foo", "x"], {"foo": "v2"}),
        ("r", "f", 3, "C", "3", ["foo", "x", "back"], {"foo": "v3", "x": "h2"}),
        ("r", "g", 1, "A", "4", [], none),
    ]
    df = spark.createDataFrame(rows, "repo_id string, file_path string, seq int, commit_hash string, snapshot_id string, symbols array<string>, symbol_hashes map<string,string>")
    e = history.evolutions(df)
    got = {r["symbol_name"]: (r["introduced_in"], r["modified_in"], r["deleted_in"]) for r in e.collect()}
    assert got == {"foo": ("A", ["B", "C"], ""), "bar": ("A", [], "B"), "x": ("A", ["C"], ""), "back": ("A", [], "")}
    assert {r["commit_hash"]: r["symbols"] for r in history.affected_symbols(e).collect()}["B"] == ["bar", "foo"]
    d = {r["seq"]: (r["added"], r["removed"]) for r in history.symbol_diff(df.where("file_path = 'f'")).collect()}
    assert d[2] == ([], ["back", "bar"]) and d[3] == (["back"], [])


def test_memory(spark):
    seen = spark.createDataFrame([(t, i) for t, n in (("A", 1), ("B", 2), ("C", 3)) for i in range(n)], "topic string, ts int")
    assert {r["topic"]: r["weight"] for r in memory.interests(seen, "topic", "ts").collect()} == {"A": 1.0, "B": 1.9, "C": 2.71}
    merge = lambda new, old, n: spark.range(1).select(memory.merged_topics(F.array(*map(F.lit, new)), F.array(*map(F.lit, old)), n).alias("t")).first()["t"]
    assert merge(["Memory", "rag"], ["RAG", "Python", "Spark"], 4) == ["Memory", "rag", "Python", "Spark"]
    assert merge(["e"], ["a", "b", "c", "d"], 3) == ["e", "a", "b"]
    t = spark.createDataFrame([(1, dt.datetime(2024, 5, 1, 9), ["A", "B"], ["doc1"]), (2, dt.datetime(2024, 5, 1, 10), ["C", "A"], ["doc1"])], "id int, ts timestamp, topics array<string>, docs array<string>")
    (day,) = memory.timeline(t, "ts", ["id"], "topics", "docs").collect()
    assert (day["topics"], day["doc_ids"], day["n"]) == (["A", "B", "C"], ["doc1"], 2)
    r = spark.createDataFrame([("s", 1, "q1", ["d1"], 5), ("s", 2, "q1", ["d1", "d2"], 6)], "s string, seq int, q string, d array<string>, t int")
    (row,) = memory.research_sessions(r, "s", ["seq"], "q", "d", "t").collect()
    assert (row["queries"], row["doc_ids"], row["updated_at"]) == (["q1", "q1"], ["d1", "d2"], 6)


SOURCE = '''import os
from pathlib import Path as P
from .near import thing

class Animal(Base):
    """A thing."""

    def speak(self):
        def inner():
            return os.path.join("a")
        return P("x")

class Shape(Protocol):
    pass

def make_animal():
    def helper():
        pass
    return unknown()
'''


def test_code(spark):
    df = spark.createDataFrame([("r", "a.py", SOURCE), ("r", "bad.py", "def ("), ("r", "none.py", None)], "repo_id string, file_path string, source string")
    c = code.chunks(df)
    got = {(r["chunk_type"], r["name"]): (r["start_line"], r["end_line"], r["parent_name"]) for r in c.collect()}
    assert got[("class", "Animal")] == (5, 11, None) and got[("method", "Animal.speak")] == (8, 11, "Animal")
    assert got[("function", "Animal.speak.inner")] == (9, 10, "Animal.speak") and got[("function", "make_animal.helper")][2] == "make_animal"
    edges = {(r["edge_type"], r["dst_id"]): r["line_no"] for r in code.edges(df).collect()}
    assert edges == {("IMPORTS", "import::os"): 1, ("IMPORTS", "import::pathlib.Path"): 2, ("EXTENDS", "import::Base"): 5, ("CALLS", "import::os.path.join"): 10, ("CALLS", "import::pathlib.Path"): 11, ("IMPLEMENTS", "import::Protocol"): 13}
    s = {r["symbol_name"]: (r["parent_symbol"], r["visibility"]) for r in code.symbols(c).collect()}
    assert s["Animal.speak"] == ("r::a.py::class::Animal", "public") and "<module>" not in s


def test_graph(spark):
    e = spark.createDataFrame([("f", "g", "CALLS", 12), ("f", "g", "CALLS", 12), ("x", "f", "IMPORTS", 0), ("f", "f", "CALLS", 1)], "src_id string, dst_id string, edge_type string, line_no int")
    a = spark.createDataFrame([("f", "f")], "source string, anchor string")
    r = graph.expand(a, e)
    assert {(x["target"], x["direction"]) for x in r.collect()} == {("g", "outgoing"), ("x", "incoming")}
    rows = r.where("target = 'g'").withColumns({"distance": F.lit(0), "hop": F.lit(1), "source_file": F.lit("a.py"), "target_file": F.lit("a.py"), "source_line": F.lit(10)})
    (top,) = graph.rank_relations(rows).collect()
    assert top["score"] == 1.0297 and top["explain"] == "outgoing calls relation | same file"
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("z", "z")] + [(f"h{i:03}", f"h{i + 1:03}") for i in range(60)], "s string, d string")
    got = {x["node"]: x["component"] for x in graph.components(pairs, "s", "d").collect()}
    assert got["c"] == "a" and got["e"] == "d" and got["z"] == "z" and {got[f"h{i:03}"] for i in range(61)} == {"h000"}
    b = spark.createDataFrame([("a", "f", 1), ("b", "f", 5), ("c", "f", 6), ("d", "g", 6)], "key string, file string, line int")
    assert [(x["other"], x["distance"]) for x in graph.nearby(b, "key", ["file"], "line", 1, b.where("key = 'a'")).collect()] == [("b", 4)]
    i = spark.createDataFrame([("i1", "pkg.sub.mod.f"), ("i2", "other")], "import_id string, target string")
    m = spark.createDataFrame([("m1", "pkg"), ("m2", "pkg.sub")], "module_id string, path string")
    assert {x["import_id"]: x["module_id"] for x in graph.resolve_imports(i, m).collect()} == {"i1": "m2", "i2": None}


def test_resolve_targets(spark):
    blocks = spark.createDataFrame(
        [("r::a/b.py::function::f", "r", "a/b.py", "f", "function", 10, 20), ("r::a/b.py::class::C", "r", "a/b.py", "C", "class", 30, 60), ("r::a/b.py::module::<module>", "r", "a/b.py", "<module>", "module", 1, 90)],
        "chunk_id string, repo_id string, file_path string, name string, chunk_type string, start_line int, end_line int",
    )
    wanted = {"r::a/b.py::function::f": "exact", "import::a.b.f": "import", "import::a.b": "import", "r::a/b.py::method::C": "name", "r::a/b.py::class::gone": "kind", "import::os": None, "odd": None}
    t = spark.createDataFrame([(k, "r", 12) for k in wanted], "target string, repo_id string, line int")
    got = {r["target"]: (r["chunk_id"], r["strategy"]) for r in graph.resolve_targets(t, blocks).collect()}
    assert {k: v[1] for k, v in got.items()} == wanted
    assert got["import::a.b"][0].endswith("<module>") and got["import::a.b.f"][0].endswith("::f")


def test_links_and_topics(spark):
    rows = [("c0", "a", [1.0, 0.0]), ("c1", "a", [0.9, 0.1]), ("c2", "b", [1.0, 0.05]), ("c3", "b", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, doc string, v array<double>")
    assert {r["id"] for r in knowledge.link_chunks(df, "id", "doc", "v", k=2, least=0.0).collect()} == {"c0", "c1", "c2", "c3"}
    assert knowledge.link_chunks(df.where("doc = 'a'"), "id", "doc", "v").count() == 0
    assert knowledge.link_docs(df, "doc", "v", least=0.0).count() == 2
    assert knowledge.topics(df, "id", "v", 8).count() == 4 and knowledge.topics(df.where("false"), "id", "v").count() == 0
    said = spark.createDataFrame([("k", 'x ```json\n{"summary": "s", "keywords": ["a", "b"]}\n```'), ("e", "nothing")], "id string, answer string")
    got = {r["id"]: (r["ka_summary"], r["ka_keywords"]) for r in knowledge.extracted(said).collect()}
    assert got == {"k": ("s", "a,b"), "e": ("", "")}
    qa = spark.createDataFrame([("k", '[{"question": "q", "answer": "a"}, {"question": " ", "answer": "a"}]')], "id string, answer string")
    assert [(r["question"], r["answer"]) for r in knowledge.qa_pairs(qa, "id").collect()] == [("q", "a")]

    def fails(_):
        raise RuntimeError

    assert knowledge.generate(df.limit(1), "id", "doc", fails).first()["answer"] is None


def test_chunking(spark):
    assert chunking.split_text("aaa bbb ccc", 7, 3) == ["aaa bbb", "ccc"]
    assert all(len(p) <= 50 for p in chunking.split_text("word " * 200 + "x" * 300, 50, 10))
    assert chunking.split_text("", 50, 10) == []
    df = spark.createDataFrame([(1, "intro\n# A\nx\n## B\ny\n# C\nz"), (2, None), (3, "")], "id int, text string")
    got = [(r["heading"], r["hierarchy"], r["content"]) for r in chunking.markdown_sections(df, "id", "text").orderBy("sec_no").collect()]
    assert got == [("", "", "intro"), ("A", "A", "x"), ("B", "A > B", "y"), ("C", "C", "z")]
    blocks = [(1, 0, "heading_1", "H"), (1, 1, "paragraph", "p1"), (1, 2, "paragraph", "p2"), (1, 3, "bulleted_list_item", "i1"), (1, 4, "bulleted_list_item", "i2"), (1, 5, "code", "c"), (1, 6, "divider", None)]
    b = spark.createDataFrame(blocks, "page_id int, order int, block_type string, content string")
    got = [r["content"] for r in chunking.page_blocks(b).orderBy("chunk_id").collect()]
    assert got == ["H", "[Section: H]\n\np1\n\np2", "[Section: H]\n\ni1\ni2", "[Section: H]\n\n```\nc\n```"]
    with pytest.raises(ValueError):
        chunking.strategy("odd", "text")


def test_facets(spark):
    a, b = spark.createDataFrame([], "id int, t string"), spark.createDataFrame([(2, "x"), (1, "y")], "id int, t string")
    assert [r["id"] for r in facets.browse_first([a, b], F.lit(True), "id", 1).collect()] == [1]
    assert [r["id"] for r in facets.page_of(b, [F.col("id")], 1, 1).collect()] == [2]


def test_versions(spark):
    v = spark.createDataFrame([("p", 1, "h1"), ("p", 2, "h2")], "page_id string, version int, content_hash string")
    new = spark.createDataFrame([("p", "h2", 1), ("p", "h3", 2), ("q", "h1", 1)], "page_id string, content_hash string, created_at int")
    got = {(r["page_id"], r["version"], r["content_hash"]) for r in index.append_versions(v, new).collect()}
    assert got == {("p", 3, "h3"), ("q", 1, "h1")}
