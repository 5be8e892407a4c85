"""Queries of the general operators on the tables of knowledge pages and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import hierarchy, packed
from strataloom.plans.catalog import Catalog
from strataloom.sources.tables import chunks_in_force, pages_in_force

catalog = Catalog()
add = catalog.add

PAGES_SQL = """
    page AS (
        SELECT id, arg_max(coalesce(parent_page_id, ''), coalesce(updated_time, TIMESTAMP '1900-01-01')) AS ref
        FROM pages WHERE id IS NOT NULL GROUP BY id
    ),
    keyed AS (
        SELECT id, regexp_replace(lower(id), 'urn:uuid:|[^0-9a-f]', '', 'g') AS k,
               regexp_replace(lower(ref), 'urn:uuid:|[^0-9a-f]', '', 'g') AS rk
        FROM page
    ),
    edge AS (
        SELECT c.id, p.id AS parent FROM keyed c LEFT JOIN keyed p ON length(c.rk) = 32 AND c.rk = p.k
    ),
    line AS (
        SELECT id, id AS tip, [id] AS seen, false AS loop FROM edge
        UNION ALL
        SELECT l.id, e.parent, list_append(l.seen, e.parent), list_contains(l.seen, e.parent)
        FROM line l JOIN edge e ON l.tip = e.id
        WHERE e.parent IS NOT NULL AND NOT l.loop
    ),
    ended AS (
        SELECT id, arg_max(tip, len(seen)) AS tip, max(len(seen)) - 1 AS steps, arg_max(loop, len(seen)) AS loop, arg_max(seen, len(seen)) AS seen
        FROM line GROUP BY id
    )
"""


def tree(spark: SparkSession, directory: str) -> DataFrame:
    return hierarchy.hierarchy(pages_in_force(spark, directory, "parent_page_id"))


@add(
    "p2_found",
    f"""
    WITH RECURSIVE {PAGES_SQL}
    SELECT e.id AS page_id,
           CASE WHEN loop THEN list_min(list_slice(seen, list_position(seen, tip), len(seen))) ELSE tip END AS root_id,
           CAST(CASE WHEN loop THEN -1 ELSE steps END AS BIGINT) AS depth
    FROM ended e JOIN edge ON edge.id = e.id AND edge.parent IS NOT NULL
    """,
)
def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return tree(spark, directory).where("parent is not null").select(F.col("id").alias("page_id"), "root_id", "depth")


#: Every page's line of parents up to its top: its root, or the page of a cycle that the line meets.
LINES_SQL = f"""{PAGES_SQL},
    below AS (
        SELECT id, CASE WHEN loop THEN list_slice(seen, 1, list_position(seen, tip)) ELSE seen END AS seen FROM ended
    )"""


def page_paths(spark: SparkSession, directory: str) -> DataFrame:
    return hierarchy.paths(hierarchy.resolve_parents(pages_in_force(spark, directory, "parent_page_id"), "id", "parent_page_id"))


@add(
    "p2_paths",
    f"""
    WITH RECURSIVE {LINES_SQL},
    sizes AS (
        SELECT u.a AS id, count(*) AS n FROM (SELECT unnest(seen) AS a FROM below) u GROUP BY 1
    )
    SELECT b.id AS page_id, array_to_string(list_reverse(seen), '/') AS path, CAST(n AS BIGINT) AS subtree_size
    FROM below b JOIN sizes USING (id)
    """,
)
def p2_paths(spark: SparkSession, directory: str) -> DataFrame:
    """Every page's path from its top and the number of pages below it, itself included."""
    return page_paths(spark, directory).select(F.col("id").alias("page_id"), F.array_join("path", "/").alias("path"), "subtree_size")


@add(
    "p2_descendants",
    f"""
    WITH RECURSIVE {LINES_SQL}
    SELECT seen[i] AS page_id, id AS descendant, CAST(i - 1 AS BIGINT) AS distance FROM (SELECT id, seen, unnest(generate_series(1, len(seen))) AS i FROM below)
    """,
)
def p2_descendants(spark: SparkSession, directory: str) -> DataFrame:
    """Every page with each page below it and the steps between, itself at 0."""
    return hierarchy.descendants(page_paths(spark, directory)).withColumnRenamed("ancestor", "page_id")


@add("p4_found")
def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    fields = ["tags", "topics", "ka_keywords"]
    return packed.unpack(chunks_in_force(spark, directory, *fields), "chunk_uid", fields, least=2).select("chunk_uid", "field", "pos", "item")
