"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import bpe, collision_knn, density_peaks, language, mojibake, packing, splitting
from strataloom.plans.catalog import Catalog
from strataloom.session import cut
from strataloom.sources.tables import chunks_in_force, pages_in_force, table

catalog = Catalog()
add = catalog.add

SIZE, LIMIT, NEAREST = 64, 0.85, 5

#: Brute force: every pair of usable vectors in force.
PAIRS_SQL = """
    latest AS (SELECT chunk_uid, arg_max({'e': embedding}, indexed_at) AS x FROM chunks WHERE chunk_uid IS NOT NULL GROUP BY 1),
    raw AS (SELECT chunk_uid AS id, CAST(x.e AS DOUBLE[]) AS v FROM latest WHERE len(x.e) = 64),
    usable AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM raw WHERE NOT list_bool_or(list_transform(v, lambda y: isnan(y))) AND list_bool_or(list_transform(v, lambda y: y != 0))),
    pair AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) AS c FROM usable a, usable b WHERE a.id != b.id AND list_dot_product(a.v, b.v) >= 0.85 * a.n * b.n)
"""


def _clusters(spark: SparkSession, directory: str) -> DataFrame:
    return density_peaks.cluster(chunks_in_force(spark, directory, "embedding"), "chunk_uid", "embedding", SIZE, LIMIT)


@add(
    "p1_found",
    f"""WITH RECURSIVE {PAIRS_SQL},
    reach AS (SELECT a, b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a),
    cluster AS (SELECT a, least(a, min(b)) AS low FROM reach GROUP BY a)
    SELECT low AS cluster_key, a AS chunk_uid FROM cluster QUALIFY count(*) OVER (PARTITION BY low) >= 3""",
)
def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return _clusters(spark, directory).select("cluster_key", "chunk_uid")


@add("p1_profiles")
def p1_profiles(spark: SparkSession, directory: str) -> DataFrame:
    """Every cluster's size, its most typical chunks and their topics."""
    return density_peaks.profiles(_clusters(spark, directory), "chunk_uid", chunks_in_force(spark, directory, "topics"), "topics")


@add(
    "p3_found",
    f"""WITH {PAIRS_SQL},
    best AS (SELECT a, b FROM pair QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
    SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM best""",
)
def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    near = collision_knn.neighbours(chunks_in_force(spark, directory, "embedding"), "chunk_uid", "embedding", SIZE, LIMIT, NEAREST)
    return near.select(F.least("chunk_uid", "other").alias("chunk_a"), F.greatest("chunk_uid", "other").alias("chunk_b")).distinct()


def _segments(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Chunks with a language, and their segments."""
    model = language.fit(table(spark, directory, "language_samples"))
    chunks = chunks_in_force(spark, directory, "content", "content_type", "language", "page_id")
    chunks = chunks.where(~F.coalesce(F.col("content_type") == "code", F.lit(False)))
    label = language.label_language(F.col("language"))
    keyed = chunks.select(F.struct("chunk_uid", "page_id", label.alias("label")).alias("k"), "content")
    found = language.segments(keyed, "k", "content", model)
    return chunks, cut(found.select("k.*", "seg_no", "start", "end", "lang_code", "confidence"))


@add("p5_found")
def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    found = _segments(spark, directory)[1]
    several = found.where("seg_no = 1").select("chunk_uid")
    mixed = found.join(several, "chunk_uid", "left_semi")
    plain = found.where(~F.col("label").eqNullSafe(F.col("lang_code"))).join(several, "chunk_uid", "left_anti")
    chunks = mixed.unionByName(plain).select(F.lit("chunk").alias("kind"), F.col("chunk_uid").alias("record_key"), "seg_no", "lang_code")
    return chunks.unionByName(_page_cases(spark, directory, found))


def _page_languages(found: DataFrame) -> DataFrame:
    """(page_id, lang_code, share): the language of most characters of each page's chunks."""
    chars = found.groupBy("page_id", "lang_code").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    return chars.groupBy("page_id").agg(F.max_by("lang_code", F.struct("n", "lang_code")).alias("lang_code"), (F.max("n") / F.sum("n")).alias("share"))


def _page_cases(spark: SparkSession, directory: str, found: DataFrame) -> DataFrame:
    pages = pages_in_force(spark, directory, "language").select("id", language.label_language(F.col("language")).alias("label"))
    wrong = pages.join(_page_languages(found), F.col("id") == F.col("page_id")).where(~F.col("label").eqNullSafe(F.col("lang_code")))
    return wrong.select(F.lit("page").alias("kind"), F.col("id").alias("record_key"), F.lit(0).cast("bigint").alias("seg_no"), "lang_code")


@add("p5_languages")
def p5_languages(spark: SparkSession, directory: str) -> DataFrame:
    """The language of every page, chunk and segment, with a confidence; a chunk's is that of most of its characters."""
    found = _segments(spark, directory)[1]
    segments = found.select(F.lit("segment").alias("kind"), "chunk_uid", "seg_no", "lang_code", "confidence")
    whole = found.groupBy("chunk_uid").agg(
        F.max_by("lang_code", F.struct((F.col("end") - F.col("start")).alias("n"), "lang_code")).alias("lang_code"),
        F.round(F.sum((F.col("end") - F.col("start")) * F.col("confidence")) / F.sum(F.col("end") - F.col("start")), 4).alias("confidence"),
    )
    chunks = whole.select(F.lit("chunk").alias("kind"), "chunk_uid", F.lit(0).cast("bigint").alias("seg_no"), "lang_code", "confidence")
    pages = _page_languages(found).select(F.lit("page").alias("kind"), F.col("page_id").alias("chunk_uid"), F.lit(0).cast("bigint").alias("seg_no"), "lang_code", F.round("share", 4).alias("confidence"))
    return segments.unionByName(chunks).unionByName(pages).withColumnRenamed("chunk_uid", "record_key")


def _sections(spark: SparkSession, directory: str) -> DataFrame:
    chunks = chunks_in_force(spark, directory, "content", "content_type", "section", "heading_path")
    return splitting.split_sections(chunks, "chunk_uid", "content", "section", "heading_path", F.col("content_type") == "code")


@add("p6_found")
def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    return _sections(spark, directory).select("chunk_uid", F.col("sec_start").alias("start_pos"))


@add("p6_pieces")
def p6_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """The pieces of every oversized content, with their section and heading path."""
    return splitting.pieces(_sections(spark, directory), "chunk_uid")


@add("p7_ids")
def p7_ids(spark: SparkSession, directory: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, directory, "documents"), "doc_id", "text")


@add("p8_containers")
def p8_containers(spark: SparkSession, directory: str) -> DataFrame:
    """Where each document, or part of one larger than a container, lies."""
    sizes = cut(bpe.encode_corpus(table(spark, directory, "documents"), "doc_id", "text", ids=False))
    return packing.pack(sizes, "doc_id", "n_tokens")


@add("p9_found")
def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents").select("doc_id", "text", "source", "source_type")
    found = mojibake.restore(documents, "doc_id", "text", "source", "source_type", table(spark, directory, "language_samples"))
    return found.select("doc_id", F.coalesce(F.md5("restored"), F.lit("")).alias("text_md5"))
