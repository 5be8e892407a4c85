"""Dependency graphs as edge tables: expansion, ranking of relations, degrees, components, limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as X
from strataloom.session import cut

#: Weights of edge types, bonuses of directions, and the parts of a relation's score.
EDGE_WEIGHT = {"CALLS": 0.95, "EXTENDS": 0.90, "IMPLEMENTS": 0.88, "IMPORTS": 0.75, "NEARBY": 0.55}
DIRECTION_BONUS = {"outgoing": 0.03, "incoming": 0.02, "undirected": 0.01}
OTHER_WEIGHT, SAME_FILE, EVIDENCE_STEP, EVIDENCE_MOST = 0.40, 0.05, 0.02, 0.08
HOP_STEP, NEAR_MOST, NEAR_LINES, LINE_MOST, LINE_LINES = 0.15, 0.25, 200, 0.08, 500
#: Limits of nodes and edges by preset, and the node counts up to which a preset is chosen.
PRESETS = {"small": (30, 60), "medium": (80, 160), "large": (150, 300)}
PRESET_UP_TO = {"small": 35, "medium": 100}


def _table(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def expand(anchors: DataFrame, edges: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """(source, target, edge_type, direction, line_no): edges of anchors both ways, each once; anchors of a source are no targets.

    ``anchors(source, anchor)`` and ``edges(src_id, dst_id, edge_type, line_no)``; one equi-join a direction.
    """
    e = edges.where(F.col("edge_type").isin(list(types))) if types is not None else edges
    e = e.select("src_id", "dst_id", "edge_type", F.coalesce("line_no", F.lit(0)).alias("line_no"))
    out = anchors.join(e, F.col("anchor") == F.col("src_id")).select("source", F.col("dst_id").alias("target"), "edge_type", F.lit("outgoing").alias("direction"), "line_no")
    back = anchors.join(e, F.col("anchor") == F.col("dst_id")).select("source", F.col("src_id").alias("target"), "edge_type", F.lit("incoming").alias("direction"), "line_no")
    both = out.unionByName(back).where(F.length(F.trim("target")) > 0).distinct()
    return both.join(anchors.select("source", F.col("anchor").alias("target")), ["source", "target"], "left_anti").where("target != source")


def anchors(rows: DataFrame, source: str, repo: str, path: str, kind: str, name: str) -> DataFrame:
    """(source, anchor): a block, its module and, of a method, its class."""
    module = X.composite_id(F.col(repo), F.col(path), F.lit("module"), F.lit("<module>"))
    cls = F.when((F.col(kind) == "method") & F.col(name).contains("."), X.composite_id(F.col(repo), F.col(path), F.lit("class"), F.substring_index(F.col(name), ".", 1)))
    return rows.select(F.col(source).alias("source"), F.explode(F.array_distinct(F.array_compact(F.array(F.col(source), module, cls)))).alias("anchor"))


def nearby(blocks: DataFrame, key: str, group: Sequence[str], line: str, k: int = 3, queries: DataFrame | None = None) -> DataFrame:
    """(key, other, distance, rank): the k blocks of the same file that start nearest, ties to the smaller key. Keys are unique.

    Windows find them without a self-join: of the k rows after, and of the k before in an order where the smaller
    keys of one line come last, everything nearer, or as near with a smaller key, is among them; of the query's own line the first k + 1 rows.
    """
    up, down = Window.partitionBy(*group).orderBy(line, key), Window.partitionBy(*group).orderBy(F.col(line), F.desc(key))
    at = lambda f, i, w: F.struct(f(key, i).over(w).alias("other"), f(line, i).over(w).alias("l"))
    own = Window.partitionBy(*group, line).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same = [F.struct(F.nth_value(key, i).over(own).alias("other"), F.col(line).alias("l")) for i in range(1, k + 2)]
    rows = blocks.select(key, line, *group)
    places = F.array(*[at(F.lead, i, up) for i in range(1, k + 1)], *[at(F.lag, i, down) for i in range(1, k + 1)], *same)
    rows = rows.select(key, line, places.alias("near"))
    if queries is not None:
        rows = rows.join(queries.select(key), key, "left_semi")
    d = F.abs(F.col("x.l") - F.col(line))
    long = rows.select(key, line, F.explode(F.array_distinct("near")).alias("x")).where(F.col("x.other").isNotNull() & (F.col("x.other") != F.col(key))).select(key, F.col("x.other").alias("other"), d.cast("bigint").alias("distance"))
    r = Window.partitionBy(key).orderBy("distance", "other")
    return long.withColumn("rank", F.row_number().over(r).cast("bigint")).where(F.col("rank") <= k)


def rank_relations(relations: DataFrame, most: int | None = None) -> DataFrame:
    """(source, target, edge_type, direction, evidence, edge_types, score, explain, rank): one row a source and target.

    ``relations(source, target, edge_type, direction, line_no, distance, hop, source_file, target_file, source_line)``.
    The heaviest edge type and direction stand for the rest; more evidence adds, hops, distance and line gaps take off.
    """
    w, b = _table(EDGE_WEIGHT), _table(DIRECTION_BONUS)
    weight, bonus = F.coalesce(F.try_element_at(w, F.col("edge_type")), F.lit(0.0)), F.coalesce(F.try_element_at(b, F.col("direction")), F.lit(0.0))
    positive = lambda c: F.min(F.when(F.col(c) > 0, F.col(c)))
    g = relations.groupBy("source", "target").agg(
        F.count("*").alias("evidence"),
        F.max_by("edge_type", F.struct(weight, "edge_type")).alias("edge_type"),
        F.max_by("direction", F.struct(bonus, "direction")).alias("direction"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("edge_type", F.lit("")))), ",").alias("edge_types"),
        positive("line_no").alias("line"),
        positive("distance").alias("near"),
        F.min(F.greatest(F.coalesce("hop", F.lit(1)), F.lit(1))).alias("hop"),
        F.min("source_file").alias("source_file"),
        F.min("target_file").alias("target_file"),
        F.min("source_line").alias("source_line"),
    )
    same = (F.coalesce("source_file", F.lit("")) != "") & (F.col("source_file") == F.col("target_file"))
    score = (
        F.coalesce(F.try_element_at(w, F.col("edge_type")), F.lit(OTHER_WEIGHT))
        + F.coalesce(F.try_element_at(b, F.col("direction")), F.lit(0.0))
        + F.when(same, SAME_FILE).otherwise(0.0)
        + F.least(F.lit(EVIDENCE_MOST), EVIDENCE_STEP * (F.col("evidence") - 1))
        - HOP_STEP * (F.col("hop") - 1)
        - F.when(F.col("near").isNotNull(), F.least(F.lit(NEAR_MOST), F.col("near") / NEAR_LINES * NEAR_MOST)).otherwise(0.0)
        - F.when(
            (F.col("source_line") > 0) & F.col("line").isNotNull(), F.least(F.lit(LINE_MOST), F.abs(F.col("line") - F.col("source_line")) / LINE_LINES * LINE_MOST)
        ).otherwise(0.0)
    )
    explain = F.concat_ws(
        " | ",
        F.concat(F.col("direction"), F.lit(" "), F.lower("edge_type"), F.lit(" relation")),
        F.when(same, "same file"),
        F.when((F.col("edge_type") == "NEARBY") & (F.col("near") > 0), F.concat(F.lit("line distance="), F.col("near").cast("string"))),
        F.when(F.col("evidence") > 1, F.concat(F.lit("evidence="), F.col("evidence").cast("string"))),
    )
    order = Window.partitionBy("source").orderBy(F.desc("score"), "target_file", "target")
    out = g.withColumn("score", F.round(score, 4)).withColumn("explain", explain)
    out = out.select("source", "target", "edge_type", "direction", "evidence", "edge_types", "score", "explain", "target_file", F.row_number().over(order).cast("bigint").alias("rank"))
    out = out.drop("target_file")
    return out.where(F.col("rank") <= most) if most else out


def degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, n_out, n_in, degree): both ends in one pass, combined before the shuffle."""
    end = lambda c, o: F.struct(F.col(c).cast("string").alias("node"), F.lit(o).alias("o"), F.lit(1 - o).alias("i"))
    ends = edges.select(F.explode(F.array(end(src, 1), end(dst, 0))).alias("x"))
    return ends.groupBy(F.col("x.node").alias("node")).agg(F.sum("x.o").alias("n_out"), F.sum("x.i").alias("n_in"), F.count("*").alias("degree"))


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component): the smallest node of each weakly connected set; rounds follow the logarithm of its size.

    Large-star and small-star rounds: every node takes its larger, then its smaller neighbours to the smallest it
    knows. The number of edges never grows; a hub's edges are grouped by a combining minimum.
    """
    e = cut(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u is not null and v is not null").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        star = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        star = cut(star.distinct())
        low2 = star.groupBy("u").agg(F.min("v").alias("m"))
        new = star.join(low2, "u").where("v >= m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        new = cut(new.where("u >= v").distinct())
        if new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty():
            return new.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        e = new


def limit_graph(nodes: DataFrame, edges: DataFrame, order: str, most_nodes: int, most_edges: int) -> tuple[DataFrame, DataFrame]:
    """The first nodes, and the first edges of which both ends are kept. ``order`` is a column of both; top-k sorts, no full ones."""
    kept = nodes.orderBy(order, "id").limit(most_nodes)
    ids = F.broadcast(kept.select("id"))  # at most most_nodes rows
    inside = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept, inside.orderBy(order, "id").limit(most_edges)


def preset(n_nodes: int) -> tuple[int, int]:
    name = next((p for p, up in PRESET_UP_TO.items() if n_nodes < up), "large")
    return PRESETS[name]


def sparse_edges(most: int) -> int:
    return max(10, round(0.45 * most))


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: duplicate node ids and edges with a missing end, both 0 in a valid graph."""
    dup = nodes.groupBy("id").count().where("count > 1").agg(F.count("*").alias("duplicate_nodes"))
    ends = edges.select("id", F.explode(F.array("source", "target")).alias("end"))
    lost = ends.join(nodes.select(F.col("id").alias("end")), "end", "left_anti").select("id").distinct().agg(F.count("*").alias("dangling_edges"))
    return dup.crossJoin(lost)


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(import_id, module_id, depth): the module of the longest prefix of each dotted import, null where none matches.

    ``imports(import_id, target)``, ``modules(module_id, path)`` with dotted paths. An equi-join on exploded prefixes.
    """
    parts = F.split("target", r"\.")
    n = F.size("p")
    pre = imports.select("import_id", parts.alias("p")).select("import_id", F.posexplode(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice("p", F.lit(1), i), "."))).alias("d", "path"))
    hit = pre.join(modules, "path").groupBy("import_id").agg(F.max_by("module_id", F.struct(F.col("d"), F.col("module_id"))).alias("module_id"), (F.max("d") + 1).cast("bigint").alias("depth"))
    return imports.select("import_id").join(hit, "import_id", "left")


def resolve_targets(targets: DataFrame, blocks: DataFrame) -> DataFrame:
    """(target, repo_id, chunk_id, strategy) of every ``targets(target, repo_id, line)``; nulls where no block fits.

    A target is tried as the id of a block, as the dotted path of an import, and by the file with the name or the
    kind of its id; the first way that fits counts, and of its blocks the nearest to the line, then the shortest.
    ``blocks(chunk_id, repo_id, file_path, name, chunk_type, start_line, end_line)``; equi-joins only.
    """
    t = targets.select("target", "repo_id", F.coalesce("line", F.lit(0)).alias("line")).distinct()
    b = blocks.select("chunk_id", "repo_id", "file_path", "name", "chunk_type", "start_line", "end_line")
    p = t.withColumn("p", X.parse_id(F.col("target")))
    dotted = F.regexp_replace(F.regexp_replace("file_path", r"(/__init__)?\.[^./]*$", ""), "/", ".")
    full = F.when(F.col("chunk_type") == "module", dotted).otherwise(F.concat(dotted, F.lit("."), F.col("name")))
    tries = [
        t.join(b.drop("repo_id"), F.col("target") == F.col("chunk_id")).withColumn("way", F.lit(0)),
        t.withColumn("path", F.regexp_extract("target", "^import::(.*)$", 1)).where("path != ''").join(b.withColumn("path", full), ["repo_id", "path"]).withColumn("way", F.lit(1)),
        p.select("target", "repo_id", "line", F.col("p.file_path").alias("file_path"), F.col("p.name").alias("name")).join(b, ["repo_id", "file_path", "name"]).withColumn("way", F.lit(2)),
        p.select("target", "repo_id", "line", F.col("p.file_path").alias("file_path"), F.col("p.chunk_type").alias("chunk_type")).join(b, ["repo_id", "file_path", "chunk_type"]).withColumn("way", F.lit(3)),
    ]
    cols = ["target", "repo_id", "line", "chunk_id", "start_line", "end_line", "way"]
    found = tries[0].select(*cols)
    for x in tries[1:]:
        found = found.unionByName(x.select(*cols))
    order = F.struct("way", F.abs(F.col("start_line") - F.col("line")), F.col("end_line") - F.col("start_line"), "start_line", "chunk_id")
    best = found.groupBy("target", "repo_id", "line").agg(F.min_by(F.struct("chunk_id", "way"), order).alias("x"))
    names = F.array(*[F.lit(w) for w in ("exact", "import", "name", "kind")])
    return t.join(best, ["target", "repo_id", "line"], "left").select("target", "repo_id", F.col("x.chunk_id").alias("chunk_id"), F.try_element_at(names, F.col("x.way") + 1).alias("strategy"))
