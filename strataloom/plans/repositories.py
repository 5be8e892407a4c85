"""Queries of lookups, repository and commit indexes, stored knowledge and graph views, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import text as X
from strataloom.operators import chunking, code, evaluate, history, lexical, lookups, memory, rerank, repos
from strataloom.operators import knowledge as kn
from strataloom.plans import knowledge as K
from strataloom.plans import search as S
from strataloom.plans.catalog import Catalog
from strataloom.sources import paged
from strataloom.sources.tables import chunks_in_force, in_force, table

catalog = Catalog()
add = catalog.add

# ---------------------------------------------------------------- lookups

PART_SYMBOLS = "sym AS (SELECT 'p' || p_partkey AS symbol_id, p_name AS symbol_name, p_type AS symbol_type, CASE WHEN p_partkey >= 10 THEN 'p' || (p_partkey // 10) ELSE '' END AS parent_symbol FROM part)"


def part_symbols(spark: SparkSession, directory: str) -> DataFrame:
    """Parts as symbols; a part is below the one with a tenth of its number."""
    up = F.when(F.col("p_partkey") >= 10, F.concat(F.lit("p"), F.floor(F.col("p_partkey") / 10))).otherwise("")
    return table(spark, directory, "part").select(F.concat(F.lit("p"), "p_partkey").alias("symbol_id"), F.col("p_name").alias("symbol_name"), F.col("p_type").alias("symbol_type"), up.alias("parent_symbol"))


@add("symbol_find", f"""WITH {PART_SYMBOLS} SELECT 'part' AS how, symbol_id, symbol_name FROM sym WHERE contains(lower(symbol_name), 'wid')
    UNION ALL SELECT 'exact', symbol_id, symbol_name FROM sym WHERE symbol_name = 'cold widget' UNION ALL SELECT 'children', symbol_id, symbol_name FROM sym WHERE parent_symbol = 'p5'""")
def symbol_find(spark: SparkSession, directory: str) -> DataFrame:
    s = part_symbols(spark, directory)
    found = {"part": lookups.find_symbols(s, "WID"), "exact": lookups.find_symbols(s, "cold widget", True), "children": lookups.children_of(s, "p5")}
    a, b, c = (df.select(F.lit(how).alias("how"), "symbol_id", "symbol_name") for how, df in found.items())
    return a.unionByName(b).unionByName(c)


@add("symbol_counts", f"WITH {PART_SYMBOLS} SELECT symbol_type, count(*) AS n FROM sym GROUP BY 1")
def symbol_counts(spark: SparkSession, directory: str) -> DataFrame:
    return lookups.counts_by(part_symbols(spark, directory), "symbol_type")


@add("edge_lookup", f"WITH {K.EDGE_SQL} SELECT * FROM edge WHERE edge_type IN ('CALLS', 'EXTENDS') AND line_no = 2")
def edge_lookup(spark: SparkSession, directory: str) -> DataFrame:
    return lookups.by_values(K.lines(spark, directory), edge_type=["CALLS", "EXTENDS"], line_no=2, src_id=None, dst_id="")


@add("evolution_alive", f"WITH {K.EVOLUTION_SQL} SELECT file_path, symbol_name, introduced_in FROM ev WHERE deleted_in = ''")
def evolution_alive(spark: SparkSession, directory: str) -> DataFrame:
    return lookups.alive(history.evolutions(K.turn_snapshots(spark, directory))).select("file_path", "symbol_name", "introduced_in")


@add("snapshot_history", f"WITH {K.SNAP_SQL} SELECT session_id AS file_path, c AS snapshot_id, row_number() OVER (PARTITION BY session_id ORDER BY seq, c) - 1 AS position FROM s")
def snapshot_history(spark: SparkSession, directory: str) -> DataFrame:
    return lookups.snapshot_history(K.turn_snapshots(spark, directory), "seq").select("file_path", "snapshot_id", "position")


@add("tracked_files", "SELECT DISTINCT trim(session_id) AS value FROM conversation_turns WHERE trim(session_id) != ''")
def tracked_files(spark: SparkSession, directory: str) -> DataFrame:
    return lookups.distinct_over({"turns": table(spark, directory, "conversation_turns").withColumnRenamed("session_id", "file_path")}, "file_path")


@add("repository_ids", "SELECT trim(x) AS value FROM (SELECT workspace_id AS x FROM chunks UNION SELECT source FROM documents UNION SELECT workspace_id FROM pages) WHERE trim(x) != '' GROUP BY 1")
def repository_ids(spark: SparkSession, directory: str) -> DataFrame:
    name = {"chunks": "workspace_id", "documents": "source", "pages": "workspace_id"}
    return lookups.distinct_over({t: table(spark, directory, t).select(F.col(c).alias("repo_id")) for t, c in name.items()}, "repo_id")


@add("page_lookup", """WITH p AS (SELECT id, arg_max({'w': workspace_id, 't': title}, updated_time) AS x FROM pages WHERE id IS NOT NULL GROUP BY id)
    SELECT id, x.t AS title FROM p WHERE x.w IN (SELECT id FROM workspaces WHERE notion_workspace_id IS NULL)""")
def page_lookup(spark: SparkSession, directory: str) -> DataFrame:
    p = in_force(table(spark, directory, "pages"), "id", "updated_time", ["workspace_id", "title"])
    w = table(spark, directory, "workspaces").where("notion_workspace_id is null").select(F.col("id").alias("workspace_id"))
    return lookups.by_ids(p, "workspace_id", w).select("id", "title")


@add("store_merge", "SELECT coalesce(s_suppkey, p_partkey) AS id, coalesce(s_name, p_name) AS name FROM part FULL JOIN supplier ON p_partkey = s_suppkey")
def store_merge(spark: SparkSession, directory: str) -> DataFrame:
    p = table(spark, directory, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return lookups.merge_stores(p, table(spark, directory, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), key="id")


@add("code_block_list", "SELECT doc_id AS chunk_id FROM documents WHERE source_type = 'code' AND contains(lower(text), 'return') ORDER BY doc_id LIMIT 500")
def code_block_list(spark: SparkSession, directory: str) -> DataFrame:
    d = table(spark, directory, "documents").where("source_type = 'code'")
    b = d.select(F.col("doc_id").alias("chunk_id"), F.lit("notes").alias("repo_id"), F.lit("").alias("file_path"), F.lit("").alias("name"), F.lit("module").alias("chunk_type"), F.col("text").alias("content"))
    return lookups.code_blocks(b, "notes", text="RETURN").select("chunk_id")


@add("test_rows", "SELECT doc_id, (doc_id % 3 < 2 OR doc_id % 5 = 0) AS is_test FROM documents")
def test_rows(spark: SparkSession, directory: str) -> DataFrame:
    path = F.when(F.col("doc_id") % 3 == 0, "tests/a.py").when(F.col("doc_id") % 3 == 1, "src\\a_test.py").otherwise("src/a.py")
    return table(spark, directory, "documents").select("doc_id", lookups.is_test(path, F.col("doc_id") % 5 == 0).alias("is_test"))


@add("language_rows", "SELECT doc_id FROM documents WHERE lower(lang) = 'de'")
def language_rows(spark: SparkSession, directory: str) -> DataFrame:
    return lookups.by_language(table(spark, directory, "documents").withColumnRenamed("lang", "language"), "DE").select("doc_id")


@add("metadata_fields", """WITH c AS (SELECT chunk_uid, arg_max({'t': page_title, 'c': created_time, 'i': chunk_id}, indexed_at) AS x FROM chunks WHERE chunk_uid IS NOT NULL GROUP BY 1)
    SELECT chunk_uid AS id, coalesce(x.t, '') AS title, coalesce(strftime(x.c, '%Y-%m-%dT%H:%M:%S+00:00'), '') AS created, coalesce(CAST(x.i AS VARCHAR), '') AS position FROM c""")
def metadata_fields(spark: SparkSession, directory: str) -> DataFrame:
    c = chunks_in_force(spark, directory, "page_title", "created_time", "chunk_id")
    return lookups.metadata(c, {"id": "chunk_uid", "title": "page_title", "created": "created_time", "position": "chunk_id"})


@add("stored_artifacts", """WITH c AS (SELECT chunk_uid, arg_max({'k': ka_keywords}, indexed_at) AS x FROM chunks WHERE chunk_uid IS NOT NULL GROUP BY 1)
    SELECT chunk_uid, array_to_string(list_filter(list_transform(string_split(coalesce(x.k, ''), ','), lambda y: trim(y)), lambda y: y != ''), '|') AS keywords FROM c""")
def stored_artifacts(spark: SparkSession, directory: str) -> DataFrame:
    return lookups.artifact(chunks_in_force(spark, directory, "ka_keywords"), "chunk_uid").select("chunk_uid", F.array_join("keywords", "|").alias("keywords"))


@add("page_listing", """WITH p AS (SELECT id, arg_max({'w': workspace_id, 't': title}, updated_time) AS x FROM pages WHERE id IS NOT NULL GROUP BY id)
    SELECT id, row_number() OVER (PARTITION BY x.w ORDER BY coalesce(x.t, ''), id) AS place, (row_number() OVER (PARTITION BY x.w ORDER BY coalesce(x.t, ''), id) - 1) // 20 AS page FROM p""")
def page_listing(spark: SparkSession, directory: str) -> DataFrame:
    p = in_force(table(spark, directory, "pages"), "id", "updated_time", ["workspace_id", "title"])
    return lookups.listing(p, "workspace_id", [X.text_of(F.col("title")), F.col("id")], 20).select("id", "place", "page")


@add("page_count", "SELECT count(*) AS n, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM documents")
def page_count(spark: SparkSession, directory: str) -> DataFrame:
    return lookups.page_count(table(spark, directory, "documents"), 20)


@add("event_rate", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events")
def event_rate(spark: SparkSession, directory: str) -> DataFrame:
    return lookups.rate(table(spark, directory, "events"), "user_id", "ts", 3600).select("event_id", "recent")


@add("block_kinds", f"""SELECT block_type, block_type IN {lookups.HEADINGS} AS heading, block_type IN {lookups.TEXT_BEARING} AS text, count(*) AS n FROM chunks WHERE block_type IS NOT NULL GROUP BY ALL""")
def block_kinds(spark: SparkSession, directory: str) -> DataFrame:
    kind = F.col("block_type")
    c = table(spark, directory, "chunks").where("block_type is not null")
    return c.select(kind, lookups.is_heading(kind).alias("heading"), lookups.is_text_bearing(kind).alias("text")).groupBy("block_type", "heading", "text").agg(F.count("*").alias("n"))


@add("section_labels", """WITH c AS (SELECT chunk_uid, arg_max({'s': section, 't': page_title, 'i': chunk_id}, indexed_at) AS x FROM chunks WHERE chunk_uid IS NOT NULL GROUP BY 1)
    SELECT chunk_uid, coalesce(nullif(trim(x.s), ''), nullif(trim(x.t), ''), 'page ' || (x.i + 1), '') AS label, substr(sha256(chunk_uid), 1, 12) AS short FROM c""")
def section_labels(spark: SparkSession, directory: str) -> DataFrame:
    c = chunks_in_force(spark, directory, "section", "page_title", "chunk_id")
    return c.select("chunk_uid", X.section_label(F.col("section"), F.col("page_title"), F.col("chunk_id")).alias("label"), X.short_hash(F.sha2("chunk_uid", 256)).alias("short"))


@add("normalized_events", "SELECT event_id, trim(event_type) AS event_type FROM events WHERE trim(event_type) IN ('error', 'click', 'view')")
def normalized_events(spark: SparkSession, directory: str) -> DataFrame:
    e = table(spark, directory, "events").withColumn("event_type", F.concat(F.lit(" "), "event_type"))
    return lookups.normalized_events(e, "event_type", False, ("error", "click", "view")).select("event_id", "event_type")


# ---------------------------------------------------------------- repositories and commits

HASH_Q = f"q AS (SELECT doc_id AS query_id, {S.HASHED.format('text')} AS h FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL)"
L2 = "round(1 / (1 + list_sum(list_transform(list_zip(q.h, c.h), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))), 4)"
ROUTE = f"""{HASH_Q}, w AS (SELECT id AS repo_id, {S.HASHED.format("coalesce(name, '')")} AS h FROM workspaces),
    route AS (SELECT q.query_id, c.repo_id, {L2} AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY score DESC, c.repo_id) AS rank FROM q, w c QUALIFY rank <= 3)"""


def hashed(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Workspaces as repositories, documents as their blocks, and every hundredth document as a query."""
    w = table(spark, directory, "workspaces").select(F.col("id").alias("repo_id"), X.hash_embedding(X.text_of(F.col("name"))).alias("embedding"))
    d = table(spark, directory, "documents").where("text is not null").select("doc_id", F.col("source").alias("repo_id"), X.hash_embedding(F.col("text")).alias("embedding"))
    return w, d, d.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))


@add("repository_search", f"WITH {ROUTE} SELECT * FROM route")
def repository_search(spark: SparkSession, directory: str) -> DataFrame:
    w, _, q = hashed(spark, directory)
    return repos.search_index(w, q, "repo_id", 3)


@add("hierarchical_search", f"""WITH {ROUTE}, d AS (SELECT doc_id, source, {S.HASHED.format('text')} AS h FROM documents WHERE text IS NOT NULL)
    SELECT q.query_id, c.doc_id, {L2} AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY score DESC, c.doc_id) AS rank
    FROM q JOIN (SELECT query_id AS routed, repo_id FROM route) r ON r.routed = q.query_id JOIN d c ON c.source = r.repo_id QUALIFY rank <= 5""")
def hierarchical_search(spark: SparkSession, directory: str) -> DataFrame:
    """The three nearest workspaces of each query, and of their documents the five nearest."""
    w, d, q = hashed(spark, directory)
    return repos.hierarchical_search(w, d, q, "doc_id", 5, 3)


@add("commit_search", f"""WITH {HASH_Q}, c AS (SELECT source || '::' || doc_id AS id, {S.HASHED.format('text')} AS h FROM documents WHERE source_type = 'commit' AND length(text) > 0 AND source IS NOT NULL)
    SELECT q.query_id, c.id, {L2} AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY score DESC, c.id) AS rank FROM q, c QUALIFY rank <= 10""")
def commit_search(spark: SparkSession, directory: str) -> DataFrame:
    d = table(spark, directory, "documents").where("source_type = 'commit' and length(text) > 0 and source is not null")
    c = d.select(F.col("source").alias("repo_id"), F.col("doc_id").cast("string").alias("commit_hash"), F.col("text").alias("message"), F.array().cast("array<string>").alias("files_changed"))
    return repos.search_index(repos.commit_index(c, X.hash_embedding), hashed(spark, directory)[2], "id", 10)


FILES = """f AS (SELECT source AS repo_id, 'src/d' || doc_id || CASE WHEN source_type = 'code' THEN '.py' ELSE '.md' END AS p, CASE WHEN source_type = 'code' THEN 'Python' ELSE 'Markdown' END AS l FROM documents WHERE source IS NOT NULL)"""


@add("repository_overview", f"""WITH {FILES}, g AS (SELECT repo_id, string_agg(l || ' ' || n, ', ' ORDER BY n DESC, l) AS langs FROM (SELECT repo_id, l, count(*) AS n FROM f GROUP BY ALL) GROUP BY repo_id)
    SELECT repo_id, 'repository: ' || repo_id || chr(10) || 'files: ' || count(*) || '  source: ' || count(*) || chr(10) || 'languages: ' || any_value(langs) || chr(10) || string_agg('  ' || p, chr(10) ORDER BY p) AS text, count(*) AS n_files
    FROM f JOIN g USING (repo_id) GROUP BY repo_id""")
def repository_overview(spark: SparkSession, directory: str) -> DataFrame:
    path = F.concat(F.lit("src/d"), "doc_id", F.when(F.col("source_type") == "code", ".py").otherwise(".md"))
    f = table(spark, directory, "documents").where("source is not null").select(F.col("source").alias("repo_id"), path.alias("file_path"), X.path_language(path).alias("language"))
    return repos.overviews(f)


# ---------------------------------------------------------------- stored knowledge

QA = "qa AS (SELECT id, min(session_id) AS session_id, coalesce(min(question), '') AS question, coalesce(min(answer_summary), '') AS answer FROM conversation_turns WHERE id IS NOT NULL AND session_id IS NOT NULL GROUP BY id)"


@add("qa_search", f"""WITH {QA}, c AS (SELECT session_id || '::' || id AS id, question, answer, {S.HASHED.format('question')} AS h FROM qa),
    q AS (SELECT query_id, {S.HASHED.format('query')} AS h FROM ({S.QUERIES}) WHERE query IS NOT NULL)
    SELECT q.query_id, c.id, c.question, c.answer, {L2} AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY score DESC, c.id) AS rank FROM q, c QUALIFY rank <= 5""")
def qa_search(spark: SparkSession, directory: str) -> DataFrame:
    t = table(spark, directory, "conversation_turns").where("id is not null and session_id is not null")
    t = t.groupBy(F.col("id").alias("pos")).agg(F.min("session_id").alias("doc_id"), X.text_of(F.min("question")).alias("question"), X.text_of(F.min("answer_summary")).alias("answer"))
    q = S.asked(spark, directory).where("query is not null").select("query_id", X.hash_embedding(F.col("query")).alias("vector"))
    return repos.qa_search(repos.qa_index(None, t, X.hash_embedding), q)


@add("enrichment_status", """WITH c AS (SELECT chunk_uid, arg_max({'k': ka_keywords, 't': page_title}, indexed_at) AS x FROM chunks WHERE chunk_uid IS NOT NULL GROUP BY 1)
    SELECT CASE WHEN coalesce(x.k, '') != '' THEN 'skipped' WHEN coalesce(x.t, '') = '' THEN 'failed' ELSE 'enriched' END AS status, count(*) AS n FROM c GROUP BY 1""")
def enrichment_status(spark: SparkSession, directory: str) -> DataFrame:
    """Titles stand for the summaries of a model."""
    c = chunks_in_force(spark, directory, "ka_keywords", "page_title").withColumn("ka_summary", F.lit(""))
    answers = c.select("chunk_uid", F.to_json(F.struct(F.col("page_title").alias("summary"))).alias("answer"))
    return lookups.counts_by(kn.enrich_stored(c, "chunk_uid", answers), "status")


@add("topic_assignment", """SELECT vec_id, CASE label WHEN 0 THEN 'topic_first_one' WHEN 1 THEN 'topic_second' ELSE CASE WHEN label < 6 THEN 'topic_cluster_' || label ELSE 'kept' END END AS topics FROM embeddings""")
def topic_assignment(spark: SparkSession, directory: str) -> DataFrame:
    e = table(spark, directory, "embeddings").select("vec_id", "label", F.lit("kept").alias("topics"))
    labels = spark.createDataFrame([(0, "Topic: First one"), (1, "second")], "topic int, label string")
    return kn.assign_topics(e.drop("label"), "vec_id", e.where("label < 6").select("vec_id", F.col("label").alias("topic")), labels)


@add("model_rerank", f"""WITH {S.bm25_sql(10)}, m AS (SELECT query_id, doc_id, CAST(((rank - 1) * 7) % 5 AS DOUBLE) AS score, rank AS r FROM bm25)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r) AS rank FROM m QUALIFY rank <= 5""")
def model_rerank(spark: SparkSession, directory: str) -> DataFrame:
    """A stand-in for a model, which scores a list by its places only."""

    def model(prompt: str) -> str:
        n = 0
        while f"\n\n[{n}] " in prompt:
            n += 1
        return json.dumps([i * 7 % 5 for i in range(n)])

    rows = lexical.with_text(S.bm25(spark, directory), table(spark, directory, "documents"), "doc_id", "text").withColumn("query", F.lit("q"))
    return rerank.model_rerank(rows, "query_id", "doc_id", "query", "text", "rank", model, 5)


@add("eval_modes", f"""WITH {S.LISTS}, {S.UNION},
    lab AS (SELECT q.vec_id AS query_id, c.vec_id FROM v q JOIN v c ON q.label = c.label AND q.vec_id != c.vec_id WHERE q.vec_id % 100 = 0),
    n AS (SELECT query_id, count(*) AS n FROM lab GROUP BY 1),
    j AS (SELECT list_id, r.query_id, rank, CASE WHEN lab.vec_id IS NULL THEN 0 ELSE 1 END AS rel FROM lists r LEFT JOIN lab USING (query_id, vec_id) WHERE rank <= 5),
    m AS (SELECT list_id, query_id, sum(rel) AS hits, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(rel / log2(rank + 1)) AS gain FROM j GROUP BY ALL)
    SELECT mode, query_id, round(coalesce(hits, 0) / n, 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr,
           round(CASE WHEN hits > 0 THEN gain / list_sum(list_transform(range(1, CAST(hits AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg
    FROM (SELECT unnest(['cosine', 'l2', 'broken']) AS mode) CROSS JOIN n LEFT JOIN m ON m.list_id = mode AND m.query_id = n.query_id""".replace("mode, query_id, round", "mode, n.query_id AS query_id, round"))
def eval_modes(spark: SparkSession, directory: str) -> DataFrame:
    """Two ways to search and one that fails, judged by equal labels, at 5."""
    v = table(spark, directory, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    labels = q.join(v.select(F.col("vec_id").alias("key"), "label"), "label").where("key != query_id").select("query_id", "key")
    modes = {m: (lambda m=m: S.nearest(spark, directory, m, 20).withColumnRenamed("vec_id", "key")) for m in ("cosine", "l2")}
    return evaluate.by_mode({**modes, "broken": lambda: v.select("no_such_column")}, labels, 5)


# ---------------------------------------------------------------- graph views

RELATIONS = K.catalog.oracles["relation_rank"]


def relation_lists(spark: SparkSession, directory: str) -> DataFrame:
    r = K.relation_rank(spark, directory)
    return r.groupBy(F.col("source").alias("chunk_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "target", "edge_type", "direction", "score", "evidence", "explain"))).alias("related")).withColumn("score", F.lit(1.0))  # ten rows a source


@add("graph_edges", f"SELECT source || '|' || target || '|' || edge_type || '|' || direction AS id, source, target, edge_type, direction, score FROM ({RELATIONS})")
def graph_edges(spark: SparkSession, directory: str) -> DataFrame:
    return repos.graph_payload(relation_lists(spark, directory))[1]


@add("graph_nodes", f"""WITH r AS ({RELATIONS}) SELECT id, id AS label, max(score) AS score, bool_or(p) AS is_primary
    FROM (SELECT DISTINCT source AS id, 1.0 AS score, true AS p FROM r UNION ALL SELECT target, score, false FROM r) GROUP BY id""")
def graph_nodes(spark: SparkSession, directory: str) -> DataFrame:
    return repos.graph_payload(relation_lists(spark, directory))[0]


@add("graph_figures", f"""SELECT count(DISTINCT source) AS primaries, count(DISTINCT source) AS with_relations, 1.0 AS hit_rate, count(*) AS "references" FROM ({RELATIONS})""")
def graph_figures(spark: SparkSession, directory: str) -> DataFrame:
    return repos.graph_payload(relation_lists(spark, directory))[2]


@add("edge_histogram", f"WITH {K.EDGE_SQL} SELECT edge_type, count(*) AS n, (SELECT count(*) FROM edge) > 300 AS truncated FROM edge GROUP BY 1")
def edge_histogram(spark: SparkSession, directory: str) -> DataFrame:
    return repos.edge_histogram(K.lines(spark, directory), 300)


@add("graph_readability", """WITH p AS (SELECT p_partkey, p_size AS n, p_size * (p_partkey % 7) AS e, CASE p_partkey % 3 WHEN 0 THEN 0.045 WHEN 1 THEN 0.015 ELSE 0.03 END + CASE WHEN p_partkey % 2 = 0 THEN 0.06 ELSE 0.015 END AS part FROM part),
    h AS (SELECT p_partkey, n, CAST(round_even(n * least(0.45, greatest(0.0, (n / 85.0 - 0.35) * 0.14 + e / greatest(1.0, n * 2.0) * 0.08 + part)), 0) AS BIGINT) AS hidden FROM p)
    SELECT p_partkey, CAST(n - hidden AS BIGINT) AS readable, hidden FROM h""")
def graph_readability(spark: SparkSession, directory: str) -> DataFrame:
    k = F.col("p_partkey")
    layout = F.when(k % 3 == 0, "cose").when(k % 3 == 1, "breadthfirst").otherwise("grid")
    return table(spark, directory, "part").select("p_partkey", evaluate.readability(F.col("p_size"), F.col("p_size") * (k % 7), layout, k % 2 == 0).alias("x")).select("p_partkey", "x.readable", "x.hidden")


@add("related_blocks")
def related_blocks(spark: SparkSession, directory: str) -> DataFrame:
    """Parts as blocks of their brand's file, orders as callers: every hundredth part's relations."""
    p = table(spark, directory, "part").groupBy("p_partkey").agg(F.min("p_brand").alias("b"), F.min("p_name").alias("n"), F.min("p_size").alias("s"))
    blocks = p.select(F.concat(F.lit("p"), "p_partkey").alias("chunk_id"), F.lit("parts").alias("repo_id"), F.col("b").alias("file_path"), F.col("n").alias("name"), F.lit("function").alias("chunk_type"), (F.col("p_partkey") * 10).alias("start_line"), (F.col("p_partkey") * 10 + F.col("s")).alias("end_line"))
    asked = blocks.where(F.substring("chunk_id", 2, 20).cast("bigint") % 100 == 0)
    r = repos.related_blocks(asked, blocks, K.lines(spark, directory))
    return r.select("chunk_id", "related_count", F.array_join(F.transform("related", lambda x: x["target"]), "|").alias("targets"))


# ---------------------------------------------------------------- samples: fixed sources and their fixed results

SAMPLE = '''import os
from pkg.base import Base, helper as h


class Shape(Base):
    """A shape."""

    def area(self):
        return h(self.side)

    def _hide(self):
        return self.area()


def build(n):
    s = Shape()
    return os.path.join(str(n))


from typing import Protocol


class Port(Protocol):
    limit: int
'''


def sample(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("r", "pkg/shape.py", SAMPLE), ("r", "pkg/bad.py", "def ("), ("r", "pkg/none.py", None)], "repo_id string, file_path string, source string")


def values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) t({columns})"


@add("sample_code_edges", values(
    "src_id, dst_id, edge_type, line_no",
    "'r::pkg/shape.py::module::<module>', 'import::os', 'IMPORTS', 1",
    "'r::pkg/shape.py::module::<module>', 'import::pkg.base.Base', 'IMPORTS', 2",
    "'r::pkg/shape.py::module::<module>', 'import::pkg.base.helper', 'IMPORTS', 2",
    "'r::pkg/shape.py::class::Shape', 'import::pkg.base.Base', 'EXTENDS', 5",
    "'r::pkg/shape.py::module::<module>', 'import::pkg.base.helper', 'CALLS', 9",
    "'r::pkg/shape.py::module::<module>', 'import::os.path.join', 'CALLS', 17",
    "'r::pkg/shape.py::module::<module>', 'import::typing.Protocol', 'IMPORTS', 20",
    "'r::pkg/shape.py::class::Port', 'import::typing.Protocol', 'IMPLEMENTS', 23",
))
def sample_code_edges(spark: SparkSession, directory: str) -> DataFrame:
    return code.edges(sample(spark)).select("src_id", "dst_id", "edge_type", F.col("line_no").cast("int").alias("line_no"))


@add("sample_code_symbols", values(
    "symbol_name, symbol_type, start_line, end_line, parent_symbol, visibility",
    "'Shape', 'class', 5, 12, '', 'public'",
    "'Shape.area', 'method', 8, 9, 'r::pkg/shape.py::class::Shape', 'public'",
    "'Shape._hide', 'method', 11, 12, 'r::pkg/shape.py::class::Shape', 'private'",
    "'build', 'function', 15, 17, '', 'public'",
    "'Port', 'class', 23, 24, '', 'public'",
))
def sample_code_symbols(spark: SparkSession, directory: str) -> DataFrame:
    s = code.symbols(code.chunks(sample(spark)))
    return s.select("symbol_name", "symbol_type", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "parent_symbol", "visibility")


@add("sample_code_chunks", values(
    "name, chunk_type, start_line, docstring, first",
    "'<module>', 'module', 1, '', 'import os'",
    "'Shape', 'class', 5, 'A shape.', 'class Shape(Base):'",
    "'Shape.area', 'method', 8, '', 'def area(self):'",
    "'Shape._hide', 'method', 11, '', 'def _hide(self):'",
    "'build', 'function', 15, '', 'def build(n):'",
    "'Port', 'class', 23, '', 'class Port(Protocol):'",
))
def sample_code_chunks(spark: SparkSession, directory: str) -> DataFrame:
    c = code.chunks(sample(spark))
    return c.select("name", "chunk_type", F.col("start_line").cast("int").alias("start_line"), F.coalesce("docstring", F.lit("")).alias("docstring"), F.trim(F.substring_index("content", "\n", 1)).alias("first"))


@add("sample_file_texts", "SELECT 'r' AS repo_id, 'pkg/shape.py' AS file_path, array_to_string(['File: pkg/shape.py', 'class Shape', 'method Shape.area', 'method Shape._hide', 'function build', 'class Port'], chr(10)) AS text")
def sample_file_texts(spark: SparkSession, directory: str) -> DataFrame:
    return code.file_texts(code.chunks(sample(spark)))


@add("sample_parse_stats", "SELECT 'r' AS repo_id, 2 AS files, 1 AS parsed, 1 AS failed, 6 AS chunks, 8 AS edges")
def sample_parse_stats(spark: SparkSession, directory: str) -> DataFrame:
    s = sample(spark)
    return code.parse_stats(s, code.chunks(s), code.edges(s))


TEXTS = [(1, "aaaa bbbb cccc dddd"), (2, "one two\n\nthree four\n\nfive"), (3, "short"), (4, None), (5, ""), (6, "abcdefghijklmnopqrstuvwxyz")]
MARKDOWN = [(1, "before\n# A\ntext a\n## B\ntext b\n# C\ntext c"), (2, "no heading"), (3, None)]


@add("sample_recursive", values(
    "doc_id, chunk_id, content",
    "1, 0, 'aaaa bbbb'", "1, 1, 'bbbb cccc'", "1, 2, 'cccc dddd'",
    "2, 0, 'one two'", "2, 1, 'three'", "2, 2, 'four'", "2, 3, 'five'", "3, 0, 'short'",
    "6, 0, 'abcdefghij'", "6, 1, 'fghijklmno'", "6, 2, 'klmnopqrst'", "6, 3, 'pqrstuvwxy'", "6, 4, 'uvwxyz'",
))
def sample_recursive(spark: SparkSession, directory: str) -> DataFrame:
    return chunking.recursive(spark.createDataFrame(TEXTS, "doc_id bigint, text string"), "doc_id", "text", 10, 5)


@add("sample_sections", values(
    "doc_id, sec_no, level, heading, hierarchy, content",
    "1, 0, 0, '', '', 'before'", "1, 1, 1, 'A', 'A', 'text a'", "1, 2, 2, 'B', 'A > B', 'text b'", "1, 3, 1, 'C', 'C', 'text c'", "2, 0, 0, '', '', 'no heading'",
))
def sample_sections(spark: SparkSession, directory: str) -> DataFrame:
    return chunking.markdown_sections(spark.createDataFrame(MARKDOWN, "doc_id bigint, text string"), "doc_id", "text")


@add("sample_headings", values(
    "doc_id, chunk_id, heading, content", "1, 0, '', 'before'", "1, 1, 'A', 'text a'", "1, 2, 'B', 'text b'", "1, 3, 'C', 'text c'", "2, 0, '', 'no heading'",
))
def sample_headings(spark: SparkSession, directory: str) -> DataFrame:
    return chunking.heading_aware(spark.createDataFrame(MARKDOWN, "doc_id bigint, text string"), "doc_id", "text", 40, 0)


@add("sample_page_blocks", values(
    "page_id, chunk_id, section, content",
    "'p', 0, 'Top', 'Top'", "'p', 1, 'Top', '[Section: Top]' || chr(10) || chr(10) || 'one'", "'p', 2, 'Top', '[Section: Top]' || chr(10) || chr(10) || 'x' || chr(10) || 'y'",
    "'p', 3, 'Top', '[Section: Top]' || chr(10) || chr(10) || '```' || chr(10) || 'f()' || chr(10) || '```'", "'p', 4, 'Sub', 'Sub'", "'p', 5, 'Sub', '[Section: Sub]' || chr(10) || chr(10) || 'two'",
))
def sample_page_blocks(spark: SparkSession, directory: str) -> DataFrame:
    rows = [("p", 0, "heading_1", "Top"), ("p", 1, "paragraph", "one"), ("p", 2, "bulleted_list_item", "x"), ("p", 3, "bulleted_list_item", "y"), ("p", 4, "code", "f()"), ("p", 5, "heading_2", "Sub"), ("p", 6, "paragraph", "two"), ("p", 7, "divider", None)]
    return chunking.page_blocks(spark.createDataFrame(rows, "page_id string, `order` int, block_type string, content string"))


@add("file_diff", values(
    "id, diff",
    "1, '--- a/f.py' || chr(10) || '+++ b/f.py' || chr(10) || '@@ -1,3 +1,3 @@' || chr(10) || ' a' || chr(10) || '-b' || chr(10) || '+x' || chr(10) || ' c'",
    "2, '--- /dev/null' || chr(10) || '+++ b/f.py' || chr(10) || '@@ -0,0 +1 @@' || chr(10) || '+new'",
    "3, ''",
))
def file_diff(spark: SparkSession, directory: str) -> DataFrame:
    """A changed file, one of a first commit, and one that is the same."""
    rows = [(1, "f.py", "a\nb\nc", "a\nx\nc"), (2, "f.py", None, "new"), (3, "f.py", "same", "same")]
    return history.unified_diffs(spark.createDataFrame(rows, "id int, file_path string, before string, after string"), "id", "file_path", "before", "after")


@add("block_order", values(
    "id, depth, place",
    "'a', 0, 0", "'a1', 1, 1", "'a2', 1, 2", "'a2x', 2, 3", "'b', 0, 4", "'b1', 1, 5",
))
def block_order(spark: SparkSession, directory: str) -> DataFrame:
    """Blocks of a page in the order of a depth-first walk."""
    rows = [("a2x", "a2", 0), ("b", None, 1), ("a", None, 0), ("a2", "a", 1), ("a1", "a", 0), ("b1", "b", 0)]
    b = paged.tree_order(spark.createDataFrame([("p", *r) for r in rows], "page_id string, id string, parent_id string, position int"), "page_id", "id", "parent_id", "position")
    return b.select("id", "depth", "place")


@add("timeline_block", f"""WITH {K.DAYS}, last AS (SELECT CAST(date AS VARCHAR) AS date, topics, n FROM day JOIN n USING (date) ORDER BY date DESC LIMIT 5)
    SELECT 'Recent Activity:' || chr(10) || string_agg('  ' || date || ': ' || array_to_string(string_split(topics, '|')[1:5], ', ') || ' (' || n || CASE WHEN n = 1 THEN ' question)' ELSE ' questions)' END, chr(10) ORDER BY date) AS block FROM last""")
def timeline_block(spark: SparkSession, directory: str) -> DataFrame:
    d = K.timeline_daily(spark, directory)
    return memory.timeline_block(d.withColumn("topics", F.split("topics", r"\|")))


@add("first_links", """WITH c AS (SELECT chunk_uid, arg_max({'p': page_id, 'i': chunk_id, 't': tags}, indexed_at) AS x FROM chunks WHERE chunk_uid IS NOT NULL GROUP BY 1),
    f AS (SELECT x.p AS page_id, arg_min({'t': x.t}, (x.i, chunk_uid)).t AS tags FROM c WHERE x.p IS NOT NULL GROUP BY 1),
    l AS (SELECT page_id, list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda y: trim(y)), lambda y: y != '') AS v FROM f)
    SELECT page_id, u.i - 1 AS place, v[u.i] AS linked, CAST(NULL AS DOUBLE) AS score FROM l, unnest(range(1, len(v) + 1)) u(i)""")
def first_links(spark: SparkSession, directory: str) -> DataFrame:
    """Tags stand for the ids of linked pages."""
    return kn.first_links(chunks_in_force(spark, directory, "page_id", "chunk_id", "tags"), "page_id", ["chunk_id", "chunk_uid"], "tags")


@add("sample_symbol_texts", values(
    "symbol_id, text",
    "'r::pkg/shape.py::class::Shape', 'class Shape' || chr(10) || 'A shape.'", "'r::pkg/shape.py::method::Shape.area', 'method Shape.area'", "'r::pkg/shape.py::method::Shape._hide', 'method Shape._hide'",
    "'r::pkg/shape.py::function::build', 'function build'", "'r::pkg/shape.py::class::Port', 'class Port'",
))
def sample_symbol_texts(spark: SparkSession, directory: str) -> DataFrame:
    c = code.chunks(sample(spark))
    return code.symbol_texts(code.symbols(c), c)


@add("sample_research_block", "SELECT 'r' AS research, array_to_string(['Research: r (active)', 'Queries:', '  - q2', '  - q3', 'Notes:', '  - late', '  - early'], chr(10)) AS block UNION ALL SELECT 's', 'Research: s (archived)'")
def sample_research_block(spark: SparkSession, directory: str) -> DataFrame:
    sessions = spark.createDataFrame([("r", "active", ["q1", "q2", "q3"]), ("s", "archived", [])], "research string, status string, queries array<string>")
    notes = spark.createDataFrame([("r", "early", "2024-01-01"), ("r", "late", "2024-01-02"), ("r", "oldest", "2023-01-01")], "research string, note string, created_at string")
    return memory.research_block(sessions, notes, 2)
