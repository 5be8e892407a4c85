"""Queries of search, fusion, filters and listings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import text as X
from strataloom.operators import evaluate, facets, filters, fusion, index, knn, lexical, pipeline, rerank
from strataloom.plans.catalog import Catalog
from strataloom.sources.tables import in_force, table

catalog = Catalog()
add = catalog.add

TOKEN = r"[^ \t\r\n\f\x0B\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]+"
TOKENS = rf"regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}')"
QUERIES = "SELECT id AS query_id, min(question) AS query FROM conversation_turns WHERE id % 100 = 0 GROUP BY id"


def asked(spark: SparkSession, directory: str) -> DataFrame:
    """The query set: questions of the turns whose id is divisible by 100."""
    return table(spark, directory, "conversation_turns").where("id % 100 = 0").groupBy(F.col("id").alias("query_id")).agg(F.min("question").alias("query"))


def bm25_sql(k: int, keep: str = "true") -> str:
    return f"""
    doc AS (SELECT doc_id, {TOKENS} AS t FROM documents),
    post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM doc) GROUP BY doc_id, term),
    total AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM doc),
    df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, total),
    idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
    q AS (SELECT query_id, term, count(*) AS q FROM (SELECT query_id, unnest({TOKENS.replace('text', 'query')}) AS term FROM ({QUERIES})) GROUP BY ALL),
    scored AS (
        SELECT query_id, doc_id, round(sum(q * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM q JOIN idf USING (term) JOIN post USING (term), total
        WHERE doc_id IN (SELECT doc_id FROM documents WHERE {keep})
        GROUP BY query_id, doc_id
    ),
    bm25 AS (
        SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
        FROM scored WHERE score > 0 QUALIFY rank <= {k}
    )"""


@add("term_df", f"SELECT term, count(DISTINCT doc_id) AS df, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term")
def term_df(spark: SparkSession, directory: str) -> DataFrame:
    post = lexical.postings(table(spark, directory, "documents"), "doc_id", "text")
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@add(
    "code_term_df",
    r"""SELECT term, count(*) AS n FROM (SELECT unnest(list_transform(regexp_extract_all(regexp_replace(text, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x))) AS term
    FROM documents WHERE source_type = 'code') GROUP BY term""",
)
def code_term_df(spark: SparkSession, directory: str) -> DataFrame:
    code = table(spark, directory, "documents").where("source_type = 'code'")
    return code.select(F.explode(X.code_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def bm25(spark: SparkSession, directory: str, k: int = 10, keep=None) -> DataFrame:
    return lexical.search(table(spark, directory, "documents"), asked(spark, directory), "doc_id", "text", k, keep=keep)


@add("bm25_topk", f"WITH {bm25_sql(10)} SELECT query_id, doc_id, score, rank FROM bm25")
def bm25_topk(spark: SparkSession, directory: str) -> DataFrame:
    return bm25(spark, directory)


@add("bm25_filtered", f"WITH {bm25_sql(10, "source_type = 'note'")} SELECT query_id, doc_id, score, rank FROM bm25")
def bm25_filtered(spark: SparkSession, directory: str) -> DataFrame:
    return bm25(spark, directory, keep=filters.where({"source_type": {"$eq": "note"}}))


def knn_sql(metric: str, k: int = 5, keep: str = "true", extra: str = "") -> str:
    l2 = "round(1 / (1 + list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 4)"
    cos = "round(list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(c.v, c.v)), 4)"
    return f"""
    v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    {metric} AS (
        SELECT q.vec_id AS query_id, c.vec_id, {l2 if metric == 'l2' else cos} AS score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, c.vec_id) AS rank
        FROM v q, v c WHERE q.vec_id % 100 = 0 AND ({keep}) {extra} QUALIFY rank <= {k}
    )"""


def nearest(spark: SparkSession, directory: str, metric: str, k: int = 5, **options) -> DataFrame:
    vectors = table(spark, directory, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    return knn.search(vectors, queries, "vec_id", "embedding", k, metric=metric, **options)


@add("knn_l2_topk", f"WITH {knn_sql('l2')} SELECT * FROM l2")
def knn_l2_topk(spark: SparkSession, directory: str) -> DataFrame:
    return nearest(spark, directory, "l2")


@add("knn_cosine_topk", f"WITH {knn_sql('cosine')} SELECT * FROM cosine")
def knn_cosine_topk(spark: SparkSession, directory: str) -> DataFrame:
    return nearest(spark, directory, "cosine")


@add("knn_filtered", f"WITH {knn_sql('l2', keep='c.label < 5')} SELECT * FROM l2")
def knn_filtered(spark: SparkSession, directory: str) -> DataFrame:
    return nearest(spark, directory, "l2", keep=F.col("label") < 5)


@add("mmr_topk")
def mmr_topk(spark: SparkSession, directory: str) -> DataFrame:
    found = nearest(spark, directory, "cosine", 20).join(table(spark, directory, "embeddings").select("vec_id", "embedding"), "vec_id")
    return knn.mmr(found, "query_id", "vec_id", "embedding", "score")


def both_lists(spark: SparkSession, directory: str) -> DataFrame:
    a = nearest(spark, directory, "cosine", 20).withColumn("list_id", F.lit("cosine"))
    return a.unionByName(nearest(spark, directory, "l2", 20).withColumn("list_id", F.lit("l2")))


LISTS = knn_sql("cosine", 20) + ", l2 AS (" + knn_sql("l2", 20).split("l2 AS (", 1)[1]
UNION = "lists AS (SELECT 'cosine' AS list_id, * FROM cosine UNION ALL SELECT 'l2', * FROM l2)"


@add(
    "rrf_two_lists",
    f"""WITH {LISTS}, {UNION},
    fused AS (SELECT query_id, vec_id, round(sum(CASE list_id WHEN 'cosine' THEN 0.7 ELSE 0.3 END / (60 + rank)), 6) AS score FROM lists GROUP BY ALL)
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM fused QUALIFY rank <= 10""",
)
def rrf_two_lists(spark: SparkSession, directory: str) -> DataFrame:
    return fusion.rrf(both_lists(spark, directory), "query_id", "vec_id", {"cosine": 0.7, "l2": 0.3}, 10)


@add(
    "dedup_best",
    f"""WITH {LISTS}, {UNION},
    first AS (SELECT * EXCLUDE rank FROM lists QUALIFY row_number() OVER (PARTITION BY query_id, vec_id ORDER BY list_id, rank) = 1)
    SELECT query_id, vec_id, list_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM first""",
)
def dedup_best(spark: SparkSession, directory: str) -> DataFrame:
    return fusion.dedup_best(both_lists(spark, directory), "query_id", "vec_id")


@add(
    "list_overlap",
    f"""WITH {LISTS} SELECT query_id, count(c.vec_id) AS n_a, count(l.vec_id) AS n_b, count(c.vec_id + l.vec_id) AS n_both, count(*) AS n_any
    FROM cosine c FULL JOIN l2 l USING (query_id, vec_id) GROUP BY query_id""",
)
def list_overlap(spark: SparkSession, directory: str) -> DataFrame:
    return fusion.overlap(nearest(spark, directory, "cosine", 20), nearest(spark, directory, "l2", 20), "query_id", "vec_id")


@add(
    "rank_change",
    f"""WITH {LISTS} SELECT query_id, vec_id, c.rank AS rank_before, l.rank AS rank_after,
    CASE WHEN c.rank IS NULL THEN '★' WHEN c.rank > l.rank THEN '▲' || (c.rank - l.rank) WHEN c.rank < l.rank THEN '▼' || (l.rank - c.rank) ELSE '—' END AS change
    FROM l2 l LEFT JOIN cosine c USING (query_id, vec_id)""",
)
def rank_change(spark: SparkSession, directory: str) -> DataFrame:
    return fusion.rank_change(nearest(spark, directory, "cosine", 20), nearest(spark, directory, "l2", 20), "query_id", "vec_id")


@add("score_stats", f"WITH {LISTS}, {UNION} SELECT list_id, count(*) AS n, min(score) AS lowest, round(avg(score), 6) AS mean, max(score) AS highest FROM lists GROUP BY list_id")
def score_stats(spark: SparkSession, directory: str) -> DataFrame:
    return fusion.score_stats(both_lists(spark, directory))


@add("score_buckets", f"WITH {LISTS}, {UNION} SELECT list_id, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'middle' ELSE 'low' END AS bucket, count(*) AS n FROM lists GROUP BY ALL")
def score_buckets(spark: SparkSession, directory: str) -> DataFrame:
    return both_lists(spark, directory).groupBy("list_id", fusion.score_bucket(F.col("score")).alias("bucket")).agg(F.count("*").alias("n"))


HASHED = "list_transform(range(16), lambda i: CAST(('0x' || substr(sha256({0}), 2 * i + 1, 2)) AS INTEGER) / 255.0::DOUBLE)"


@add("hash_embedding", f"SELECT doc_id, u.i - 1 AS pos, CAST(h[u.i] AS DOUBLE) AS value FROM (SELECT doc_id, {HASHED.format('text')} AS h FROM documents WHERE text IS NOT NULL), unnest(range(1, 17)) u(i)")
def hash_embedding(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(X.hash_embedding(F.col("text"))).alias("pos", "value")).withColumn("pos", F.col("pos").cast("bigint"))


@add(
    "hybrid_search",
    f"""WITH {bm25_sql(20)},
    dv AS (SELECT doc_id, {HASHED.format('text')} AS v FROM documents WHERE text IS NOT NULL),
    qv AS (SELECT query_id, {HASHED.format('query')} AS v FROM ({QUERIES}) WHERE query IS NOT NULL),
    near AS (
        SELECT query_id, doc_id, round(1 / (1 + list_sum(list_transform(list_zip(qv.v, dv.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 4) AS score,
               row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
        FROM qv, dv QUALIFY rank <= 20
    ),
    fused AS (
        SELECT query_id, doc_id, round(sum(w / (60 + rank)), 6) AS score
        FROM (SELECT query_id, doc_id, rank, 0.7 AS w FROM near UNION ALL SELECT query_id, doc_id, rank, 0.3 FROM bm25) GROUP BY ALL
    )
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused QUALIFY rank <= 10""",
)
def hybrid_search(spark: SparkSession, directory: str) -> DataFrame:
    """Vector and lexical lists of 20, fused 7 to 3, the first 10."""
    docs = table(spark, directory, "documents").where("text is not null").withColumn("vector", X.hash_embedding(F.col("text")))
    lexical_side = pipeline.Lexical(table(spark, directory, "documents"), "doc_id", "text")
    vector_side = pipeline.Nearest(docs, "doc_id", "vector", X.hash_embedding)
    found = pipeline.document_pipeline([vector_side, lexical_side], docs, "doc_id", "text", weights=[0.7, 0.3])
    return found.run(asked(spark, directory).where("query is not null"), top_k=10, fetch_k=20).withColumnRenamed("key", "doc_id")


@add("reranked_search")
def reranked_search(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").where("text is not null")
    p = pipeline.document_pipeline([pipeline.Lexical(docs, "doc_id", "text")], docs, "doc_id", "text", rerank.lexical_overlap)
    return p.run(asked(spark, directory), top_k=5, fetch_k=20).withColumnRenamed("key", "doc_id")


@add(
    "context_blocks",
    f"""WITH {bm25_sql(3)} SELECT query_id, string_agg('[' || doc_id || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS context
    FROM bm25 JOIN documents USING (doc_id) GROUP BY query_id""",
)
def context_blocks(spark: SparkSession, directory: str) -> DataFrame:
    rows = lexical.with_text(bm25(spark, directory, 3), table(spark, directory, "documents"), "doc_id", "text").withColumn("tag", F.col("doc_id").cast("string"))
    return pipeline.context(rows, "query_id", "rank", "text", "tag")


SCOPE = rerank.parse_scope("repo:Brand#1 path:steel module:\"anodized\" small parts")


@add(
    "scope_rerank",
    """WITH s AS (
        SELECT p_brand, p_partkey, p_retailprice / 3000.0 AS score0, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part
    ), b AS (
        SELECT s.p_brand, s.p_partkey, r, round(round(score0, 4) + least(0.45, CASE WHEN contains(lower(p.p_brand), 'brand#1') THEN 0.18 ELSE 0 END
            + CASE WHEN contains(lower(p_type), 'steel') THEN 0.10 ELSE 0 END
            + CASE WHEN contains(lower(p_type), 'anodized') OR lower(p_name) = 'anodized' THEN 0.12 ELSE 0 END), 4) AS score
        FROM s JOIN part p USING (p_partkey)
    ) SELECT p_brand, p_partkey, score, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, r) AS rank FROM b""",
)
def scope_rerank(spark: SparkSession, directory: str) -> DataFrame:
    """Parts as code rows: the brand as repository, the type as path, the name as name."""
    from pyspark.sql import Window

    rows = table(spark, directory, "part").select("p_brand", "p_partkey", "p_type", "p_name", F.round(F.col("p_retailprice") / 3000.0, 4).alias("score"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    return rerank.scope_rerank(rows, SCOPE, "p_brand", "p_type", "p_name", "score", "rank", ["p_brand"]).select("p_brand", "p_partkey", "score", "rank")


@add(
    "eval_metrics",
    f"""WITH {knn_sql('cosine', 10, extra='AND q.vec_id != c.vec_id')},
    lab AS (SELECT q.vec_id AS query_id, c.vec_id FROM v q JOIN v c ON q.label = c.label AND q.vec_id != c.vec_id WHERE q.vec_id % 100 = 0),
    n AS (SELECT query_id, count(*) AS n FROM lab GROUP BY 1),
    j AS (SELECT r.query_id, rank, CASE WHEN lab.vec_id IS NULL THEN 0 ELSE 1 END AS rel FROM cosine r LEFT JOIN lab USING (query_id, vec_id)),
    m AS (SELECT query_id, sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS hits, min(CASE WHEN rel = 1 THEN rank END) AS first,
          sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END / log2(rank + 1)) AS gain FROM j GROUP BY 1)
    SELECT query_id, round(coalesce(hits, 0) / n, 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr,
           round(CASE WHEN hits > 0 THEN gain / list_sum(list_transform(range(1, CAST(hits AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg
    FROM n LEFT JOIN m USING (query_id)""",
)
def eval_metrics(spark: SparkSession, directory: str) -> DataFrame:
    """Ten nearest others of the query vectors, judged by equal labels, at 5."""
    vectors = table(spark, directory, "embeddings")
    ranked = nearest(spark, directory, "cosine", 11).where("vec_id != query_id")
    ranked = lexical.top(ranked.drop("rank"), ["query_id"], "score", "vec_id", 10).withColumnRenamed("vec_id", "key")
    q = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    labels = q.join(vectors.select(F.col("vec_id").alias("key"), "label"), "label").where("key != query_id").select("query_id", "key")
    return evaluate.metrics(ranked, labels, 5)


@add(
    "search_filter",
    """SELECT doc_id FROM documents WHERE coalesce(document_type, '') = 'markdown' AND contains(coalesce(source, ''), 'a')
    AND strftime(created_time, '%Y-%m-%dT%H:%M:%S+00:00') BETWEEN '2024-03-01T00:00:00+00:00' AND '2024-06-30T23:59:59+00:00'""",
)
def search_filter(spark: SparkSession, directory: str) -> DataFrame:
    spec = filters.SearchFilter(document_type="markdown", tag="a", created_after="2024-03-01", created_before="2024-06-30")
    stamp = F.date_format("created_time", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    names = {"document_type": F.col("document_type"), "tags": F.col("source"), "created_time": stamp}
    return table(spark, directory, "documents").where(filters.where(spec.to_where(), names)).select("doc_id")


@add(
    "path_rules",
    r"""WITH p AS (SELECT DISTINCT source_url FROM pages WHERE source_url IS NOT NULL),
    n AS (SELECT source_url, lower(replace(trim(source_url), '\', '/')) AS s FROM p)
    SELECT source_url, regexp_matches(s, '(^|/)(tests?|testing|spec|__tests__)(/|$)|(^|/)test_[^/]+$|(^|/)[^/]+_test\.py$|(^|/)testing_[^/]+\.py$|\.test\.(js|ts|jsx|tsx)$|\.spec\.(js|ts|jsx|tsx)$') AS is_test,
    CASE WHEN s LIKE '%.md' THEN 'markdown' WHEN s LIKE '%.pdf' THEN 'pdf' ELSE 'text' END AS document_type,
    regexp_replace(regexp_replace(s, '\.[^./]*$', ''), '/', '.', 'g') AS module FROM n""",
)
def path_rules(spark: SparkSession, directory: str) -> DataFrame:
    p, u = table(spark, directory, "pages").where("source_url is not null").select("source_url").distinct(), F.col("source_url")
    return p.select(u, X.is_test_path(u).alias("is_test"), X.document_type(u).alias("document_type"), X.module_path(u).alias("module"))


@add("topic_slugs", """WITH t AS (SELECT DISTINCT page_title AS title FROM chunks WHERE page_title IS NOT NULL)
    SELECT title, 'topic_' || left(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(trim(title)), '^(topic_|topic:|label:|category:)', '')), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'), 40) AS slug FROM t""")
def topic_slugs(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "chunks").where("page_title is not null").select(F.col("page_title").alias("title")).distinct().withColumn("slug", X.slug(F.col("title")))


@add("facet_tags", """SELECT value, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(list_transform(string_split(tags, ','), lambda x: trim(x)), lambda x: x != ''))) AS value FROM chunks) GROUP BY value""")
def facet_tags(spark: SparkSession, directory: str) -> DataFrame:
    return facets.list_values(table(spark, directory, "chunks"), "tags")


@add("facet_workspaces", "SELECT DISTINCT trim(workspace_id) AS value FROM chunks WHERE trim(workspace_id) != ''")
def facet_workspaces(spark: SparkSession, directory: str) -> DataFrame:
    return facets.distinct_values(table(spark, directory, "chunks"), "workspace_id")


@add("page_titles", """SELECT page_id, coalesce(arg_min(nullif(trim(page_title), ''), (chunk_id, nullif(trim(page_title), ''))) FILTER (WHERE trim(page_title) != ''), page_id) AS title FROM chunks WHERE page_id IS NOT NULL GROUP BY page_id""")
def page_titles(spark: SparkSession, directory: str) -> DataFrame:
    return facets.titles(table(spark, directory, "chunks"), "page_id", "page_title", "chunk_id")


@add("page_info", """WITH c AS (SELECT chunk_uid, arg_max({'p': page_id, 'i': chunk_id, 's': source_type, 'w': workspace_id}, indexed_at) AS x FROM chunks GROUP BY 1)
    SELECT x.p AS page_id, count(*) AS n_chunks, arg_min(x.s, x.i) AS source_type, arg_min(x.w, x.i) AS workspace_id FROM c GROUP BY 1""")
def page_info(spark: SparkSession, directory: str) -> DataFrame:
    chunks = in_force(table(spark, directory, "chunks"), "chunk_uid", "indexed_at", ["page_id", "chunk_id", "source_type", "workspace_id"])
    return facets.doc_info(chunks, "page_id", "chunk_id", ["source_type", "workspace_id"])


@add("collection_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("chunks", "pages", "documents")))
def collection_counts(spark: SparkSession, directory: str) -> DataFrame:
    return facets.counts({t: table(spark, directory, t) for t in ("chunks", "pages", "documents")})


@add("browse_documents", "SELECT doc_id, source_type FROM documents WHERE length(trim(coalesce(text, ''))) > 0 AND source_type = 'qa' ORDER BY doc_id LIMIT 500")
def browse_documents(spark: SparkSession, directory: str) -> DataFrame:
    return facets.browse(table(spark, directory, "documents"), "doc_id", "text", F.col("source_type") == "qa").select("doc_id", "source_type")


@add("knowledge_browser", """SELECT chunk_uid, count(*) AS n FROM chunks WHERE coalesce(document_type, '') = 'notion'
    AND list_contains(list_transform(string_split(coalesce(topics, ''), ','), lambda x: trim(x)), 'vector search') AND (contains(lower(coalesce(content, '')), 'page') OR contains(lower(coalesce(page_title, '')), 'page')
    OR contains(lower(coalesce(tags, '')), 'page') OR contains(lower(coalesce(topics, '')), 'page') OR contains(lower(coalesce(ka_keywords, '')), 'page')) GROUP BY 1""")
def knowledge_browser(spark: SparkSession, directory: str) -> DataFrame:
    keep = filters.knowledge_facets("page", document_type="notion", topics="vector search")
    return table(spark, directory, "chunks").where(keep).groupBy("chunk_uid").agg(F.count("*").alias("n"))


STATES = """old AS (SELECT id, arg_min(content_hash, (updated_time, content_hash)) AS h FROM pages WHERE updated_time < TIMESTAMP '2024-06-01' GROUP BY id),
    new AS (SELECT id, arg_max(content_hash, (updated_time, content_hash)) AS h FROM pages WHERE updated_time >= TIMESTAMP '2024-03-01' GROUP BY id)"""


def states(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the pages: first ones before June and last ones from March on."""
    p = table(spark, directory, "pages")
    o = F.struct("updated_time", "content_hash")
    old = p.where("updated_time < timestamp'2024-06-01'").groupBy("id").agg(F.min_by("content_hash", o).alias("h"))
    new = p.where("updated_time >= timestamp'2024-03-01'").groupBy("id").agg(F.max_by("content_hash", o).alias("h"))
    return old, new


@add("hash_diff", f"""WITH {STATES} SELECT id, coalesce(o.h, '') AS old_hash, coalesce(n.h, '') AS new_hash,
    CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'deleted' WHEN coalesce(o.h, '') = coalesce(n.h, '') THEN 'skipped' ELSE 'modified' END AS change
    FROM old o FULL JOIN new n USING (id)""")
def hash_diff(spark: SparkSession, directory: str) -> DataFrame:
    changes = index.diff(*states(spark, directory), "id", "h")
    fill = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return changes.select("id", fill("old_hash"), fill("new_hash"), "change")


@add("upsert_apply", f"WITH {STATES} SELECT id, CASE WHEN n.id IS NULL THEN o.h ELSE n.h END AS h FROM old o FULL JOIN new n USING (id)")
def upsert_apply(spark: SparkSession, directory: str) -> DataFrame:
    return index.upsert(*states(spark, directory), "id")


@add("insert_ignore", f"WITH {STATES} SELECT id, h FROM old UNION ALL SELECT id, h FROM new WHERE id NOT IN (SELECT id FROM old)")
def insert_ignore(spark: SparkSession, directory: str) -> DataFrame:
    return index.insert_ignore(*states(spark, directory), "id")


@add("delete_by_key", f"WITH {STATES} SELECT id, h FROM old WHERE NOT coalesce(h < '8', false)")
def delete_by_key(spark: SparkSession, directory: str) -> DataFrame:
    return index.delete(states(spark, directory)[0], F.col("h") < "8")


@add("merge_fields", f"WITH {STATES} SELECT o.id, coalesce(n.h, o.h) AS h FROM old o LEFT JOIN new n USING (id)")
def merge_fields(spark: SparkSession, directory: str) -> DataFrame:
    old, new = states(spark, directory)
    return index.merge_fields(old, new, "id")


@add("version_append", """WITH v AS (SELECT DISTINCT page_id, version, content_hash FROM document_versions WHERE page_id IS NOT NULL),
    last AS (SELECT page_id, max(version) AS top, arg_max(content_hash, (version, content_hash)) AS last FROM v GROUP BY 1),
    inc AS (SELECT id AS page_id, content_hash, updated_time AS t FROM pages WHERE id IS NOT NULL AND content_hash IS NOT NULL GROUP BY ALL),
    f AS (SELECT inc.*, top, coalesce(lag(content_hash) OVER (PARTITION BY page_id ORDER BY t, content_hash), last) AS before FROM inc LEFT JOIN last USING (page_id))
    SELECT page_id, content_hash, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY page_id ORDER BY t, content_hash) AS BIGINT) AS version FROM f WHERE before IS NULL OR before != content_hash""")
def version_append(spark: SparkSession, directory: str) -> DataFrame:
    v = table(spark, directory, "document_versions").where("page_id is not null").select("page_id", "version", "content_hash").distinct()
    v = v.groupBy("page_id", "version").agg(F.max("content_hash").alias("content_hash"))
    inc = table(spark, directory, "pages").where("id is not null and content_hash is not null").select(F.col("id").alias("page_id"), "content_hash", F.col("updated_time").alias("created_at")).distinct()
    return index.append_versions(v, inc).select("page_id", "content_hash", "version")


@add("block_hash", """WITH c AS (SELECT chunk_uid, arg_max({'p': page_id, 'i': chunk_id, 'c': content}, indexed_at) AS x FROM chunks GROUP BY 1)
    SELECT x.p AS page_id, sha256(string_agg(coalesce(x.c, ''), '' ORDER BY x.i, coalesce(x.c, ''))) AS content_hash FROM c GROUP BY 1""")
def block_hash(spark: SparkSession, directory: str) -> DataFrame:
    chunks = in_force(table(spark, directory, "chunks"), "chunk_uid", "indexed_at", ["page_id", "chunk_id", "content"])
    return index.block_hash(chunks, "page_id", "chunk_id", "content")
