"""Queries of links, graphs, histories, memory, chunking and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import text as X
from strataloom.operators import chunking, code, evaluate, graph, history, knn, memory
from strataloom.operators import knowledge as kn
from strataloom.plans.catalog import Catalog
from strataloom.session import checkpoint_dir
from strataloom.sources.tables import chunks_in_force, in_force, table
from strataloom.streaming import state

catalog = Catalog()
add = catalog.add

# ---------------------------------------------------------------- links and topics


@add("label_centroids", "SELECT label, p.i - 1 AS pos, round(avg(CAST(embedding[p.i] AS DOUBLE)), 6) AS value FROM embeddings, unnest(range(1, 65)) p(i) GROUP BY ALL")
def label_centroids(spark: SparkSession, directory: str) -> DataFrame:
    c = knn.centroids(table(spark, directory, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("pos", "v")).select("label", F.col("pos").cast("bigint").alias("pos"), F.round("v", 6).alias("value"))


COSINE = "round(list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(c.v, c.v)), 4)"
VECTORS = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
LINKS = f"""{VECTORS},
    links AS (SELECT q.vec_id, c.vec_id AS neighbour, {COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, c.vec_id) AS rank
    FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.label != c.label AND {COSINE} >= 0.2 QUALIFY rank <= 5)"""


def links(spark: SparkSession, directory: str) -> DataFrame:
    v = table(spark, directory, "embeddings")
    return kn.link_chunks(v, "vec_id", "label", "embedding", v.where("vec_id % 100 = 0"), 5, 0.2)


@add("link_chunks", f"WITH {LINKS} SELECT * FROM links")
def link_chunks(spark: SparkSession, directory: str) -> DataFrame:
    return links(spark, directory)


@add("related_chunks", f"WITH {LINKS} SELECT vec_id, neighbour, score, rank, substr(CAST(label AS VARCHAR), 1, 200) AS text FROM links JOIN (SELECT vec_id AS neighbour, label FROM v) USING (neighbour)")
def related_chunks(spark: SparkSession, directory: str) -> DataFrame:
    v = table(spark, directory, "embeddings").select("vec_id", F.col("label").cast("string").alias("text"))
    return kn.related(links(spark, directory), v, "vec_id", "text")


@add(
    "link_docs",
    f"""WITH {VECTORS}, p AS (SELECT label, i, avg(v[i]) AS x FROM v, unnest(range(1, 65)) u(i) GROUP BY ALL),
    m AS (SELECT label, list(x ORDER BY i) AS v FROM p GROUP BY label)
    SELECT q.label, c.label AS neighbour, {COSINE} AS score, row_number() OVER (PARTITION BY q.label ORDER BY score DESC, c.label) AS rank
    FROM m q, m c WHERE q.label != c.label AND {COSINE} >= -0.5 QUALIFY rank <= 5""",
)
def link_docs(spark: SparkSession, directory: str) -> DataFrame:
    return kn.link_docs(table(spark, directory, "embeddings"), "label", "embedding", 5, -0.5)


@add("kmeans_topics")
def kmeans_topics(spark: SparkSession, directory: str) -> DataFrame:
    return kn.topics(table(spark, directory, "embeddings"), "vec_id", "embedding", 8).select("vec_id", "topic")


@add(
    "cluster_representatives",
    f"""WITH {VECTORS}, p AS (SELECT label, i, avg(v[i]) AS x FROM v, unnest(range(1, 65)) u(i) GROUP BY ALL), m AS (SELECT label, list(x ORDER BY i) AS c FROM p GROUP BY label)
    SELECT label, vec_id, round(sqrt(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 4) AS distance,
    row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM v JOIN m USING (label) QUALIFY rank <= 5""",
)
def cluster_representatives(spark: SparkSession, directory: str) -> DataFrame:
    return knn.representatives(table(spark, directory, "embeddings"), "label", "vec_id", "embedding")


# ---------------------------------------------------------------- graphs

#: lineitem as edges: an order calls a part; returnflag gives the type, linenumber the line
EDGE_SQL = """edge AS (SELECT 'o' || l_orderkey AS src_id, 'p' || l_partkey AS dst_id,
    CASE l_returnflag WHEN 'A' THEN 'CALLS' WHEN 'N' THEN 'IMPORTS' ELSE 'EXTENDS' END AS edge_type, CAST(l_linenumber AS BIGINT) AS line_no FROM lineitem)"""


def lines(spark: SparkSession, directory: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "CALLS").when(F.col("l_returnflag") == "N", "IMPORTS").otherwise("EXTENDS")
    return table(spark, directory, "lineitem").select(
        F.concat(F.lit("o"), "l_orderkey").alias("src_id"), F.concat(F.lit("p"), "l_partkey").alias("dst_id"), kind.alias("edge_type"), F.col("l_linenumber").cast("bigint").alias("line_no")
    )


HOP_SQL = f"""{EDGE_SQL}, a AS (SELECT DISTINCT dst_id AS source FROM edge WHERE CAST(substr(dst_id, 2) AS BIGINT) % 100 = 0),
    hop AS (
        SELECT DISTINCT source, dst_id AS target, edge_type, 'outgoing' AS direction, line_no FROM a JOIN edge ON source = src_id WHERE source != dst_id
        UNION SELECT DISTINCT source, src_id, edge_type, 'incoming', line_no FROM a JOIN edge ON source = dst_id WHERE source != src_id
    )"""


def hops(spark: SparkSession, directory: str) -> DataFrame:
    e = lines(spark, directory)
    a = e.select("dst_id").distinct().where(F.substring("dst_id", 2, 20).cast("bigint") % 100 == 0).select(F.col("dst_id").alias("source"), F.col("dst_id").alias("anchor"))
    return graph.expand(a, e).select("source", "target", "edge_type", "direction", "line_no")


@add("edges_1hop", f"WITH {HOP_SQL} SELECT * FROM hop")
def edges_1hop(spark: SparkSession, directory: str) -> DataFrame:
    return hops(spark, directory)


@add(
    "relation_rank",
    f"""WITH {HOP_SQL}, w AS (SELECT *, CASE edge_type WHEN 'CALLS' THEN 0.95 WHEN 'EXTENDS' THEN 0.90 ELSE 0.75 END AS weight FROM hop),
    g AS (SELECT source, target, count(*) AS evidence, arg_max(edge_type, weight) AS edge_type, max(weight) AS weight, min(line_no) AS line, string_agg(DISTINCT edge_type, ',' ORDER BY edge_type) AS edge_types FROM w GROUP BY ALL),
    s AS (SELECT source, target, edge_type, evidence, edge_types, round(weight + 0.02 + least(0.08, 0.02 * (evidence - 1)) - least(0.08, abs(line - 4) / 500.0 * 0.08), 4) AS score FROM g)
    SELECT source, target, edge_type, 'incoming' AS direction, evidence, edge_types, score, 'incoming ' || lower(edge_type) || ' relation' || CASE WHEN evidence > 1 THEN ' | evidence=' || evidence ELSE '' END AS explain,
    row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS rank FROM s QUALIFY rank <= 10""",
)
def relation_rank(spark: SparkSession, directory: str) -> DataFrame:
    rows = hops(spark, directory).withColumns({"distance": F.lit(0), "hop": F.lit(1), "source_file": F.lit(""), "target_file": F.lit(""), "source_line": F.lit(4)})
    return graph.rank_relations(rows, 10)


@add("node_degree", f"WITH {EDGE_SQL} SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in, count(*) AS degree FROM (SELECT src_id AS node, 1 AS o, 0 AS i FROM edge UNION ALL SELECT dst_id, 0, 1 FROM edge) GROUP BY node")
def node_degree(spark: SparkSession, directory: str) -> DataFrame:
    return graph.degrees(lines(spark, directory), "src_id", "dst_id")


@add("edge_counts", f"WITH {EDGE_SQL} SELECT edge_type, line_no, count(*) AS n FROM edge GROUP BY GROUPING SETS ((edge_type), (line_no))")
def edge_counts(spark: SparkSession, directory: str) -> DataFrame:
    lines(spark, directory).createOrReplaceTempView("strataloom_edges")
    return spark.sql("SELECT edge_type, line_no, count(*) AS n FROM strataloom_edges GROUP BY GROUPING SETS ((edge_type), (line_no))")


@add(
    "nearby_blocks",
    """WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS key, min(l_suppkey) AS l_suppkey, CAST(min(l_partkey) AS BIGINT) AS line FROM lineitem GROUP BY 1),
    j AS (SELECT a.key, c.key AS other, abs(a.line - c.line) AS distance FROM b a JOIN b c ON a.l_suppkey = c.l_suppkey AND a.key != c.key)
    SELECT key, other, distance, row_number() OVER (PARTITION BY key ORDER BY distance, other) AS rank FROM j QUALIFY rank <= 3""",
)
def nearby_blocks(spark: SparkSession, directory: str) -> DataFrame:
    """Of every line, the three parts nearest by number with the same supplier."""
    b = table(spark, directory, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key")).agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").cast("bigint").alias("line"))
    return graph.nearby(b, "key", ["l_suppkey"], "line", 3)


@add("connected_components", """WITH RECURSIVE e AS (SELECT DISTINCT page_id AS a, workspace_id AS b FROM chunks WHERE page_id IS NOT NULL AND workspace_id IS NOT NULL),
    m AS (SELECT b, min(a) AS low FROM e GROUP BY b), two AS (SELECT e.a, min(m.low) AS low FROM e JOIN m USING (b) GROUP BY e.a),
    m2 AS (SELECT b, min(low) AS low FROM e JOIN two USING (a) GROUP BY b), three AS (SELECT e.a, min(m2.low) AS low FROM e JOIN m2 USING (b) GROUP BY e.a),
    m3 AS (SELECT b, min(low) AS low FROM e JOIN three USING (a) GROUP BY b), four AS (SELECT e.a, min(m3.low) AS low FROM e JOIN m3 USING (b) GROUP BY e.a),
    m4 AS (SELECT b, min(low) AS low FROM e JOIN four USING (a) GROUP BY b)
    SELECT b AS node, low AS first_page FROM m4""")
def connected_components(spark: SparkSession, directory: str) -> DataFrame:
    """Pages and workspaces that chunks join: of every workspace the smallest page of its component."""
    e = table(spark, directory, "chunks").where("page_id is not null and workspace_id is not null").select(F.concat(F.lit("0"), "page_id").alias("a"), F.concat(F.lit("1"), "workspace_id").alias("b")).distinct()
    c = graph.components(e, "a", "b").where("node like '1%'")
    return c.select(F.substring("node", 2, 100).alias("node"), F.substring("component", 2, 100).alias("first_page"))


@add(
    "graph_limits",
    """WITH n AS (SELECT n_nationkey AS id FROM nation ORDER BY n_regionkey, n_nationkey LIMIT 10),
    e AS (SELECT c_custkey AS id, c_nationkey AS source, c_custkey % 25 AS target FROM customer)
    SELECT id, source, target FROM e WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n) ORDER BY source, id LIMIT 60""",
)
def graph_limits(spark: SparkSession, directory: str) -> DataFrame:
    nodes = table(spark, directory, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("o"))
    edges = table(spark, directory, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("source"), (F.col("c_custkey") % 25).alias("target"), F.col("c_nationkey").alias("o"))
    return graph.limit_graph(nodes, edges, "o", 10, 60)[1].select("id", "source", "target")


@add("graph_integrity", "SELECT (SELECT count(*) FROM (SELECT id FROM pages GROUP BY id HAVING count(*) > 1)) AS duplicate_nodes, (SELECT count(DISTINCT chunk_uid) FROM chunks WHERE page_id IS NOT NULL AND page_id NOT IN (SELECT id FROM pages)) AS dangling_edges")
def graph_integrity(spark: SparkSession, directory: str) -> DataFrame:
    edges = table(spark, directory, "chunks").where("page_id is not null").select(F.col("chunk_uid").alias("id"), F.col("page_id").alias("source"), F.col("page_id").alias("target"))
    return graph.integrity(table(spark, directory, "pages").select("id"), edges)


@add("import_resolution", """WITH i AS (SELECT p_partkey AS import_id, replace(p_name, ' ', '.') AS target FROM part),
    m AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS path FROM part UNION SELECT DISTINCT array_to_string(string_split(p_name, ' ')[1:2], '.') FROM part WHERE p_size < 10)
    SELECT import_id, arg_max(path, len(string_split(path, '.'))) AS module_id, CAST(max(len(string_split(path, '.'))) AS BIGINT) AS depth FROM i LEFT JOIN m ON target = path OR starts_with(target, path || '.') GROUP BY import_id""")
def import_resolution(spark: SparkSession, directory: str) -> DataFrame:
    p = table(spark, directory, "part")
    words = F.split("p_name", " ")
    imports = p.select(F.col("p_partkey").alias("import_id"), F.replace("p_name", F.lit(" "), F.lit(".")).alias("target"))
    modules = p.select(words[0].alias("path")).union(p.where("p_size < 10").select(F.array_join(F.slice(words, 1, 2), "."))).distinct().select(F.col("path").alias("module_id"), "path")
    return graph.resolve_imports(imports, modules)


# ---------------------------------------------------------------- histories

TURN_SQL = "t AS (SELECT session_id, seq, id, any_value(topics) AS topics, any_value(answer_summary) AS a FROM conversation_turns GROUP BY ALL)"
SNAP_SQL = f"""{TURN_SQL}, one AS (SELECT session_id, seq, min(id) AS id, arg_min(topics, id) AS topics, arg_min(a, id) AS a FROM t GROUP BY ALL),
    s AS (SELECT session_id, seq, CAST(id AS VARCHAR) AS c, coalesce(CAST(from_json(topics, '["VARCHAR"]') AS VARCHAR[]), []) AS symbols, substr(sha256(coalesce(a, '')), 1, 1) AS h FROM one)"""


def turn_snapshots(spark: SparkSession, directory: str) -> DataFrame:
    """Turns as snapshots: a session is a file, a turn a commit, its topics the symbols, all with the answer's hash digit."""
    t = table(spark, directory, "conversation_turns").groupBy("session_id", "seq").agg(F.min("id").alias("id"), F.min_by("topics", "id").alias("topics"), F.min_by("answer_summary", "id").alias("a"))
    symbols = F.coalesce(F.from_json("topics", "array<string>"), F.array().cast("array<string>"))
    h = F.substring(F.sha2(F.coalesce("a", F.lit("")), 256), 1, 1)
    return t.select(
        F.lit("r").alias("repo_id"), F.col("session_id").alias("file_path"), "seq", F.col("id").cast("string").alias("commit_hash"), F.col("id").cast("string").alias("snapshot_id"), symbols.alias("symbols"),
        F.map_from_arrays(F.array_distinct(symbols), F.transform(F.array_distinct(symbols), lambda _: h)).alias("symbol_hashes"),
    )


EVOLUTION_SQL = f"""{SNAP_SQL}, nx AS (SELECT *, lead(c) OVER (PARTITION BY session_id ORDER BY seq) AS nc FROM s),
    x AS (SELECT session_id, seq, c, nc, h, unnest(list_distinct(symbols)) AS sym FROM nx),
    y AS (SELECT *, h != lag(h) OVER (PARTITION BY session_id, sym ORDER BY seq) AS changed FROM x),
    ev AS (SELECT session_id AS file_path, sym AS symbol_name, arg_min(c, seq) AS introduced_in, coalesce(string_agg(c, ',' ORDER BY seq) FILTER (WHERE changed), '') AS modified_in, coalesce(arg_max({{'n': nc}}, seq).n, '') AS deleted_in FROM y GROUP BY ALL)"""


@add("symbol_evolution", f"WITH {EVOLUTION_SQL} SELECT * FROM ev")
def symbol_evolution(spark: SparkSession, directory: str) -> DataFrame:
    e = history.evolutions(turn_snapshots(spark, directory))
    return e.select("file_path", "symbol_name", "introduced_in", F.array_join("modified_in", ",").alias("modified_in"), "deleted_in")


@add("symbol_diff", f"""WITH {SNAP_SQL}, l AS (SELECT session_id, seq, symbols, coalesce(lag(symbols) OVER (PARTITION BY session_id ORDER BY seq), []) AS b FROM s)
    SELECT session_id AS file_path, seq, array_to_string(list_sort(list_distinct(list_filter(symbols, lambda x: NOT list_contains(b, x)))), ',') AS added,
    array_to_string(list_sort(list_distinct(list_filter(b, lambda x: NOT list_contains(symbols, x)))), ',') AS removed FROM l""")
def symbol_diff(spark: SparkSession, directory: str) -> DataFrame:
    d = history.symbol_diff(turn_snapshots(spark, directory))
    return d.select("file_path", "seq", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@add("file_churn", f"WITH {SNAP_SQL} SELECT session_id AS file_path, count(DISTINCT c) AS snapshots FROM s GROUP BY 1")
def file_churn(spark: SparkSession, directory: str) -> DataFrame:
    return history.churn(turn_snapshots(spark, directory)).select("file_path", "snapshots")


@add("affected_symbols", f"""WITH {EVOLUTION_SQL}, z AS (SELECT symbol_name, unnest(string_split(introduced_in || ',' || deleted_in || ',' || modified_in, ',')) AS commit_hash FROM ev)
    SELECT commit_hash, string_agg(DISTINCT symbol_name, ',' ORDER BY symbol_name) AS symbols FROM z WHERE commit_hash != '' GROUP BY 1""")
def affected_symbols(spark: SparkSession, directory: str) -> DataFrame:
    a = history.affected_symbols(history.evolutions(turn_snapshots(spark, directory)))
    return a.select("commit_hash", F.array_join("symbols", ",").alias("symbols"))


# ---------------------------------------------------------------- memory


def turns(spark: SparkSession, directory: str) -> DataFrame:
    """Turns, each id once, with their topics as an array."""
    t = table(spark, directory, "conversation_turns").groupBy("id").agg(*[F.max(c).alias(c) for c in ("session_id", "seq", "turn_time", "question", "topics")])
    return t.withColumn("topics", F.coalesce(F.from_json("topics", "array<string>"), F.array().cast("array<string>")))


TURNS = """turn AS (SELECT id, max(session_id) AS session_id, max(seq) AS seq, max(turn_time) AS turn_time, max(question) AS question,
    coalesce(CAST(from_json(max(topics), '["VARCHAR"]') AS VARCHAR[]), []) AS topics FROM conversation_turns GROUP BY id)"""


@add("turn_numbers", f"WITH {TURNS} SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn_time, id) AS seq FROM turn")
def turn_numbers(spark: SparkSession, directory: str) -> DataFrame:
    return memory.number_turns(turns(spark, directory).drop("seq"), "session_id", ["turn_time", "id"]).select("id", "session_id", "seq")


@add("recent_turns", f"WITH {TURNS}, n AS (SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn_time, id) AS seq FROM turn) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 20")
def recent_turns(spark: SparkSession, directory: str) -> DataFrame:
    return memory.last_turns(turn_numbers(spark, directory), "session_id", 20)


@add("session_topics", f"""WITH {TURNS}, x AS (SELECT session_id, id, u.p, topics[u.p] AS t FROM turn, unnest(range(1, len(topics) + 1)) u(p) WHERE trim(topics[u.p]) != ''),
    o AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY session_id, lower(trim(t)) ORDER BY id DESC, p) = 1),
    f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC, p) AS r FROM o QUALIFY r <= 10)
    SELECT session_id, string_agg(t, '|' ORDER BY r) AS topics FROM f GROUP BY 1""")
def session_topics(spark: SparkSession, directory: str) -> DataFrame:
    s = memory.session_topics(turns(spark, directory), "session_id", "id", "topics")
    return s.select("session_id", F.array_join("topics", "|").alias("topics"))


def interest_sql(rows: str, topic: str) -> str:
    return f"""SELECT {topic} AS topic, n, list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(least(n, 200)), lambda i: 0.0::DOUBLE)), lambda w, x: round(w * 0.9 + 1, 4)) AS weight
    FROM (SELECT {topic}, count(*) AS n FROM {rows} GROUP BY 1)"""


@add("interest_topics", f"WITH {TURNS}, x AS (SELECT unnest(topics) AS tp FROM turn) {interest_sql('x', 'tp')}")
def interest_topics(spark: SparkSession, directory: str) -> DataFrame:
    seen = turns(spark, directory).select("turn_time", F.explode("topics").alias("topic"))
    return memory.interests(seen, "topic", "turn_time").select("topic", "n", "weight")


@add("interest_users", interest_sql("events", "user_id"))
def interest_users(spark: SparkSession, directory: str) -> DataFrame:
    return memory.interests(table(spark, directory, "events"), "user_id", "ts").select(F.col("user_id").alias("topic"), "n", "weight")


DAYS = """d AS (SELECT CAST(ts AS DATE) AS date, event_type, min((event_id)) AS f FROM events GROUP BY ALL),
    day AS (SELECT date, string_agg(event_type, '|' ORDER BY f) AS topics FROM d GROUP BY 1), n AS (SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1)"""


def event_days(spark: SparkSession, directory: str) -> DataFrame:
    e = table(spark, directory, "events").select("ts", "event_id", F.array("event_type").alias("topics"), F.array(F.col("user_id").cast("string")).alias("doc_ids"))
    return memory.timeline(e, "ts", ["event_id"], "topics", "doc_ids")


@add("timeline_daily", f"WITH {DAYS} SELECT CAST(date AS VARCHAR) AS date, topics, n FROM day JOIN n USING (date)")
def timeline_daily(spark: SparkSession, directory: str) -> DataFrame:
    return event_days(spark, directory).select(F.col("date").cast("string").alias("date"), F.array_join("topics", "|").alias("topics"), "n")


@add("timeline_recent", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-13' AND DATE '2024-01-20' GROUP BY 1")
def timeline_recent(spark: SparkSession, directory: str) -> DataFrame:
    return memory.recent(event_days(spark, directory), F.lit("2024-01-20").cast("date"), 7).select(F.col("date").cast("string").alias("date"), "n")


@add("yearly_topics", "SELECT event_type AS topic, count(DISTINCT CAST(ts AS DATE)) AS days FROM events WHERE year(ts) = 2024 GROUP BY 1")
def yearly_topics(spark: SparkSession, directory: str) -> DataFrame:
    return memory.yearly_topics(event_days(spark, directory), 2024)


@add("research_sessions", f"""WITH {TURNS}, q AS (SELECT session_id, id, coalesce(question, '') AS q, topics FROM turn), o AS (SELECT session_id, id, u.p, topics[u.p] AS t FROM q, unnest(range(1, len(topics) + 1)) u(p)),
    f AS (SELECT session_id, t, min((id, p)) AS f FROM o GROUP BY ALL)
    SELECT session_id, queries, coalesce(docs, '') AS doc_ids FROM (SELECT session_id, string_agg(q, '|' ORDER BY id) AS queries FROM q GROUP BY 1) LEFT JOIN (SELECT session_id, string_agg(t, '|' ORDER BY f) AS docs FROM f GROUP BY 1) USING (session_id)""")
def research_sessions(spark: SparkSession, directory: str) -> DataFrame:
    t = turns(spark, directory).withColumn("question", F.coalesce("question", F.lit("")))
    r = memory.research_sessions(t, "session_id", ["id"], "question", "topics", "turn_time")
    return r.select("session_id", F.array_join("queries", "|").alias("queries"), F.array_join("doc_ids", "|").alias("doc_ids"))


@add("latency_p95", "SELECT event_type, count(value) AS n, list_sort(list(greatest(value, 0)))[CAST(floor((count(value) - 1) * 0.95) AS BIGINT) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_p95(spark: SparkSession, directory: str) -> DataFrame:
    return evaluate.lower_p95(table(spark, directory, "events"), "event_type", "value")


@add("latency_p95_recent", "WITH e AS (SELECT * FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 300) SELECT event_type, count(*) AS n, list_sort(list(greatest(value, 0)))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS p95 FROM e GROUP BY 1")
def latency_p95_recent(spark: SparkSession, directory: str) -> DataFrame:
    last = evaluate.last_samples(table(spark, directory, "events").where("value is not null"), "event_type", F.col("event_id"))
    return evaluate.lower_p95(last, "event_type", "value")


# ---------------------------------------------------------------- chunking and code


@add("chunk_fixed", """SELECT doc_id, u.i AS chunk_id, substr(text, u.i * 400 + 1, 500) AS content FROM documents, unnest(range(0, greatest(1, CAST(ceil((length(text) - 100) / 400.0) AS BIGINT)))) u(i) WHERE length(text) > 0""")
def chunk_fixed(spark: SparkSession, directory: str) -> DataFrame:
    return chunking.fixed(table(spark, directory, "documents"), "doc_id", "text")


@add("chunk_recursive")
def chunk_recursive(spark: SparkSession, directory: str) -> DataFrame:
    return chunking.recursive(table(spark, directory, "documents"), "doc_id", "text")


@add("chunk_headings")
def chunk_headings(spark: SparkSession, directory: str) -> DataFrame:
    return chunking.heading_aware(table(spark, directory, "documents"), "doc_id", "text")


@add("markdown_sections")
def markdown_sections(spark: SparkSession, directory: str) -> DataFrame:
    return chunking.markdown_sections(table(spark, directory, "documents"), "doc_id", "text")


@add("chunk_semantic")
def chunk_semantic(spark: SparkSession, directory: str) -> DataFrame:
    return chunking.semantic(table(spark, directory, "documents"), "doc_id", "text", X.hash_embedding)


@add("chunk_page_blocks")
def chunk_page_blocks(spark: SparkSession, directory: str) -> DataFrame:
    """Chunks of the tables as blocks of their pages."""
    c = chunks_in_force(spark, directory, "page_id", "chunk_id", "block_type", "content")
    kind = F.when(F.coalesce("block_type", F.lit("")) == "", "paragraph").otherwise(F.col("block_type"))
    return chunking.page_blocks(c.select("page_id", F.col("chunk_id").alias("order"), kind.alias("block_type"), "content"))


def sources(spark: SparkSession, directory: str) -> DataFrame:
    d = table(spark, directory, "documents").where("source_type = 'code'")
    return d.select(F.lit("notes").alias("repo_id"), F.concat(F.lit("doc"), "doc_id", F.lit(".py")).alias("file_path"), F.col("text").alias("source"))


@add("code_chunks")
def code_chunks(spark: SparkSession, directory: str) -> DataFrame:
    return code.chunks(sources(spark, directory))


@add("code_edges")
def code_edges(spark: SparkSession, directory: str) -> DataFrame:
    return code.edges(sources(spark, directory))


@add("code_symbols")
def code_symbols(spark: SparkSession, directory: str) -> DataFrame:
    return code.symbols(code.chunks(sources(spark, directory)))


@add("code_file_texts")
def code_file_texts(spark: SparkSession, directory: str) -> DataFrame:
    return code.file_texts(code.chunks(sources(spark, directory)))


@add("code_parse_stats")
def code_parse_stats(spark: SparkSession, directory: str) -> DataFrame:
    s = sources(spark, directory)
    return code.parse_stats(s, code.chunks(s), code.edges(s))


@add("manifest_hash", "WITH f AS (SELECT page_id, version, arg_max(content_hash, id) AS h FROM document_versions GROUP BY ALL) SELECT page_id AS repo_id, sha256(string_agg(coalesce(h, ''), '' ORDER BY version)) AS content_hash, count(*) AS n_files FROM f WHERE page_id IS NOT NULL AND version IS NOT NULL GROUP BY 1")
def manifest_hash(spark: SparkSession, directory: str) -> DataFrame:
    v = table(spark, directory, "document_versions").where("page_id is not null and version is not null").groupBy("page_id", "version").agg(F.max_by("content_hash", "id").alias("content_hash"))
    return code.manifest_hash(v.select(F.col("page_id").alias("repo_id"), F.col("version").alias("file_path"), "content_hash"))


# ---------------------------------------------------------------- streams


def events_stream(spark: SparkSession, directory: str) -> DataFrame:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{directory}/events.parquet")
    folder = path.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    schema = table(spark, directory, "events").schema
    reader = spark.readStream.schema(schema)
    return reader.parquet(f"{directory}/events.parquet") if folder else reader.option("pathGlobFilter", "events.parquet").parquet(directory)


@add("stream_interests", interest_sql("events", "event_type"))
def stream_interests(spark: SparkSession, directory: str) -> DataFrame:
    """The interest state of every event type after the whole stream."""
    s = state.interest_stream(events_stream(spark, directory), "event_type", "ts")
    out = state.collected(s, f"{checkpoint_dir(spark)}/interests-{uuid.uuid4()}")
    return out.groupBy("event_type").agg(F.max("n").alias("n"), F.max_by("weight", "n").alias("weight")).withColumnRenamed("event_type", "topic")


@add("stream_timeline", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n FROM events GROUP BY 1")
def stream_timeline(spark: SparkSession, directory: str) -> DataFrame:
    s = state.timeline_stream(events_stream(spark, directory), "ts")
    out = state.collected(s, f"{checkpoint_dir(spark)}/timeline-{uuid.uuid4()}")
    return out.groupBy(F.col("date").cast("string").alias("date")).agg(F.max("n").alias("n"))


@add("pages_in_force", "SELECT id, arg_max(coalesce(title, ''), updated_time) AS title FROM pages GROUP BY id")
def pages_in_force(spark: SparkSession, directory: str) -> DataFrame:
    return in_force(table(spark, directory, "pages"), "id", "updated_time", ["title"]).withColumn("title", F.coalesce("title", F.lit("")))
