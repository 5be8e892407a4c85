import datetime as dt
import json

import pytest

from strataloom.app import cli
from strataloom.app.config import Config
from strataloom.app.engine import Engine
from strataloom.operators import rerank
from strataloom.sources import files, sinks


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, Config(store=str(tmp_path / "store")))


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def test_documents(engine, spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("# Foxes\n\nThe red fox runs.\n\n# Dogs\n\nThe green dog sleeps.\n")
    (tmp_path / "d" / "b.txt").write_text("Blue whales swim.")
    assert engine.add_documents(str(tmp_path / "d"), "w", ["x", "y"])["added"] == 3
    assert engine.add_documents(str(tmp_path / "d"), "w", ["x", "y"])["skipped"] == 3
    found = engine.search(queries(spark, "red fox", "whales"), 1, "lexical").collect()
    assert len(found) == 2
    assert engine.search(queries(spark, "red fox")).count() == 3
    assert {r["value"] for r in engine.facet("tags").collect()} == {"x", "y"}
    assert engine.documents().count() == 2
    assert "red fox" in engine.answer(queries(spark, "red fox"), mode="lexical").first()["answer"]
    assert set(engine.trace(queries(spark, "dog"))) == {"vector", "lexical", "hybrid", "overlap", "stats"}
    doc = next(r["doc_id"] for r in engine.documents().collect() if r["doc_id"].endswith("b.txt"))
    assert engine.delete_document(doc) == 1


def test_repository(engine, spark, tmp_path, capsys):
    src = tmp_path / "repo"
    (src / "pkg").mkdir(parents=True)
    (src / "build").mkdir()
    (src / "pkg" / "a.py").write_text("import os\n\n\ndef walk_tree(root):\n    return os.walk(root)\n")
    (src / "build" / "b.py").write_text("x = 1\n")
    for i in range(8):
        (src / "pkg" / f"c{i}.py").write_text(f"value_{i} = {i}\n")
    assert engine.add_repository(str(src), "r")["added"] == 10
    assert engine.add_repository(str(src), "r", commit="c1")["skipped"] == 10
    assert engine.add_repository(str(src), "r", commit="c1")["skipped"] == 0
    found = engine.search_code(queries(spark, "walk tree"), "r", 5, rerank.parse_scope("path:pkg"))
    assert found.where("id like '%walk_tree'").count() == 1
    rows = {r["chunk_id"]: r for r in engine.related(found, "r").collect()}
    assert {x["target"] for r in rows.values() for x in r["related"]} >= {"import::os", "import::os.walk"}
    assert all(r["related_count"] == len(r["related"]) for r in rows.values())
    q = queries(spark, "walk the tree")
    assert engine.search_repositories(q).collect()[0]["repo_id"] == "r"
    assert engine.route_code(q, ["r"]).count() > 0
    for level in ("file", "symbol", "block"):
        assert engine.nearest_code(q, ["r"], level).count() > 0
    got = engine.search_blocks(q, "r", k=1, scorer=rerank.lexical_overlap).collect()
    assert len(got) == 1 and got[0]["related"] is not None
    cli.main(["edges", "r", "--store", engine.config.store])
    assert {json.loads(x)["edge_type"] for x in capsys.readouterr().out.splitlines() if x.startswith("{")} == {"IMPORTS", "CALLS"}
    assert engine.remove_repository("r") > 0


def test_memory(engine, spark):
    t = dt.datetime(2024, 5, 1, 9)
    rows = [("s", 1, t, "q1", ["A", "B"], ["d1"], "x"), ("s", 2, t, "q2", ["a"], ["d2"], "x")]
    turns = spark.createDataFrame(rows, "session_id string, id bigint, turn_time timestamp, question string, topics array<string>, doc_ids array<string>, research string")
    m = engine.memory
    m.store("conversation", "turns", turns)
    m.store("conversation", "turns", turns)
    assert [r["seq"] for r in m.retrieve("conversation", "turns").orderBy("seq").collect()] == [1, 2]
    assert m.retrieve("conversation", "current_topics").first()["topics"] == ["a", "B"]
    assert m.retrieve("user_profile", "top_interests", n=1).count() == 1
    assert m.retrieve("timeline", "days").first()["n"] == 2
    assert m.retrieve("research", "queries").first()["queries"] == ["q1", "q2"]
    for bad in (lambda: m.retrieve("x", "y"), lambda: m.clear("nowhere"), lambda: m.store("a", "b", turns)):
        with pytest.raises(KeyError):
            bad()
    assert m.clear("conversation", "s") == 2


def test_raw_pages(spark):
    raw = {"id": "p", "url": "u", "created_time": "2024-01-01T00:00:00Z", "parent": {"page_id": "q"}, "properties": {"N": {"type": "title", "title": [{"plain_text": "Hi "}, {"plain_text": "you"}]}, "T": {"type": "multi_select", "multi_select": [{"name": "a"}]}}}
    df = spark.createDataFrame([(json.dumps(raw), "w"), ("{}", "w")], "raw string, ws string")
    got = files.raw_pages(df, "raw", "ws").collect()
    assert (got[0]["title"], got[0]["tags"], got[0]["parent_page_id"]) == ("Hi you", ["a"], "q") and got[1]["title"] == ""
    blocks = [{"id": "1", "type": "paragraph", "paragraph": {"rich_text": [{"plain_text": "t"}]}}, {"id": "2", "type": "table_row", "table_row": {"cells": [[{"plain_text": "a"}], [{"plain_text": "b"}]]}}, {"id": "3", "type": "odd"}]
    b = files.raw_blocks(spark.createDataFrame([("p", json.dumps(blocks))], "page string, raw string"), "page", "raw").collect()
    assert [(r["block_type"], r["content"]) for r in b] == [("paragraph", "t"), ("table_row", "a | b"), ("unsupported", "")]


def test_files(spark, tmp_path):
    log = [{"repo_id": "r", "commit_hash": "b", "date": "2024-02", "message": "m", "files_changed": ["a.py", "x.md"]}, {"repo_id": "r", "commit_hash": "a", "date": "2024-01", "files_changed": []}]
    (tmp_path / "log.json").write_text("\n".join(map(json.dumps, log)))
    c = files.commits(spark, str(tmp_path / "log.json"))
    assert [r["commit_hash"] for r in c.collect()] == ["b", "a"] and files.head(c).first()["commit_hash"] == "b"
    assert files.commits(spark, str(tmp_path / "log.json"), file_path="a.py", since="2024-02").count() == 1
    contents = spark.createDataFrame([("r", "b", "a.py", "x = 1")], "repo_id string, commit_hash string, file_path string, source string")
    assert files.snapshots(c, contents).first()["snapshot_id"] == "r::b::a.py"
    import re

    rule = re.compile(files.gitignore(["*.log", "/out/", "# note", "docs/**/tmp"]))
    assert rule.search("a/b.log") and rule.search("out/x") and rule.search("docs/a/tmp") and not rule.search("a/out.py")
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"query": "q", "relevant_docs": ["d"], "relevant_chunks": [1]}]}))
    assert files.evaluation_set(spark, str(tmp_path / "q.json")).count() == 2
    sinks.write_csv(c.select("commit_hash"), str(tmp_path / "out"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).count() == 2
    assert sinks.safe_name("a b/c.md") == "a_b_c.md"


def test_commits(engine, spark):
    rows = [("r", "c1", "fix parser", ["a.py"]), ("r", "c2", "add docs", []), ("s", "c1", "fix parser", ["b.py"])]
    c = spark.createDataFrame(rows, "repo_id string, commit_hash string, message string, files_changed array<string>")
    assert engine.add_commits(c) == 3
    assert engine.add_commits(c.where("commit_hash = 'c2'"), "r", prune=True) == 2
    assert {r["id"] for r in engine.search_commits(queries(spark, "docs")).collect()} == {"r::c2", "s::c1"}
    assert [r["id"] for r in engine.search_commits(queries(spark, "docs"), repo_id="s").collect()] == ["s::c1"]


def test_knowledge_is_written_back(engine, spark):
    def model(prompts):
        def say(p):
            if "JSON object" in p:
                return None if "bad" in p else '{"summary": "s", "keywords": ["k", "l"]}'
            return '[{"question": "why?", "answer": "so"}, {"question": "", "answer": "x"}]' if "questions" in p else "Topic: My Name"

        return prompts.map(say)

    engine.model = model
    engine.add_texts(spark.createDataFrame([(1, "good text"), (2, "bad text")], "id int, text string"))
    assert engine.enrich() == {"enriched": 1, "skipped": 0, "failed": 1}
    assert engine.enrich() == {"enriched": 0, "skipped": 1, "failed": 1}
    assert {r["ka_keywords"] for r in engine.chunks().collect()} == {"k,l", ""}
    assert engine.build_qa() == 2 and engine.build_qa() == 2
    assert engine.search_qa(queries(spark, "why?")).where("rank = 1").first()["answer"] == "so"
    assert engine.assign_topics() == 2
    assert {r["topics"] for r in engine.chunks().collect()} == {"topic_my_name"}
    d = spark.createDataFrame([(1, "+x"), (2, "")], "id int, diff string")
    assert {r["id"]: r["summary"] for r in engine.diff_summaries(d).collect()} == {1: "Topic: My Name", 2: ""}


def test_clearing_memory(engine, spark):
    g = engine.memory
    t = spark.sql("select 's' session_id, 1L id, timestamp'2024-01-01' turn_time, 'q' question, array('x') topics")
    g.store("conversation", "turns", t)
    assert g.retrieve("user_profile", "top_interests").count() == 1
    assert g.clear("user_profile") == 1 and g.clear("user_profile") == 0
    assert g.retrieve("user_profile", "top_interests").count() == 0
    assert g.retrieve("timeline", "days").count() == 1
    assert g.clear("timeline") == 1 and g.retrieve("timeline", "days").count() == 0
    assert g.retrieve("conversation", "turns").count() == 1
    g.store("research", "sessions", spark.sql("select 'r' research, 'active' status, array('t') tags, timestamp'2024-01-01' updated_at"))
    g.store("research", "notes", spark.sql("select 'r' research, 'n' note, timestamp'2024-02-01' created_at"))
    assert str(g.retrieve("research", "sessions").first()["updated_at"]).startswith("2024-02-01")
    assert g.delete_note("r", "n") == 1 and g.retrieve("research", "notes").count() == 0
    assert g.delete_session("s") == 1


def test_paged_source(spark, tmp_path):
    import json

    from strataloom.sources import paged

    (tmp_path / "start.json").write_text(json.dumps({"results": [{"id": 1}, {"id": 2}], "has_more": True, "next_cursor": "c2"}))
    (tmp_path / "c2.json").write_text(json.dumps({"results": [{"id": 3}], "has_more": False}))
    spark.dataSource.register(paged.PagedSource)
    read = spark.read.format("paged").option("paths", str(tmp_path))
    assert [(r["cursor"], r["position"], json.loads(r["raw"])["id"]) for r in read.load().orderBy("cursor", "position").collect()] == [(None, 0, 1), (None, 1, 2), ("c2", 0, 3)]
    assert read.option("start_cursor", "c2").load().count() == 1
    waits, answers = [], iter([paged.TooManyRequests(3), {"results": []}])

    def call():
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert paged.with_retries(call, sleep=waits.append) == {"results": []} and waits == [3]
    with pytest.raises(paged.TooManyRequests):
        paged.with_retries(lambda: (_ for _ in ()).throw(paged.TooManyRequests(0)), sleep=waits.append)


def test_small_files(tmp_path):
    from strataloom.sources import files, sinks

    (tmp_path / "a.ini").write_text("[s]\nk = v\n")
    assert files.read_ini(str(tmp_path / "a.ini")) == {"s": {"k": "v"}}
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "HEAD").write_text("ref: refs/heads/main\n")
    assert files.branch(str(tmp_path)) == "main" and files.branch(str(tmp_path / "no")) == ""
    sinks.write_yaml({"a": [1, "é"]}, str(tmp_path / "a.yaml"))
    assert "é" in (tmp_path / "a.yaml").read_text(encoding="utf-8")


def test_table_index(engine, spark):
    from strataloom.app.engine import TableIndex

    t = TableIndex(engine.store, "t")
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, content_hash string")
    assert t.ingest(rows, "x")["added"] == 2 and t.update(rows, "x")["skipped"] == 2
    assert t.reindex(rows, "x") == {"added": 2, "modified": 0, "skipped": 0, "deleted": 2}
    assert t.delete("x") == {"deleted": 2} and t.delete("y") == {"deleted": 0}
