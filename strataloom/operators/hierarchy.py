"""Parent-child rows to full hierarchies: depth, root, path, subtree size, descendants, cycles.

Method: bottom-up leaf peeling. Every round peels all current leaves, which send their subtree sizes to their
parents. A chain of depth d would need d rounds, so each round also contracts unary chains: a node with
one live child is taken out and its child is hung to its parent with a longer link, which carries the ids and
the weight of the nodes it jumps over. The residue no round can peel contains the cycles.
Every node notes the anchor it was taken out against and, if it was jumped over, the child that goes on. The reverse
peel order then assigns roots, depths and paths along anchors, and sizes along children; as these always
outlive their nodes, their lines are no longer than the rounds, and doubling follows them in O(log rounds) joins.

Descendants come as pairs, not as a list with each page: a list at the root would be one row that holds a third of the table.
Every join meets unique ids, or deals hot ones to several tasks (skew.lookup).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.skew import lookup
from strataloom.session import cut, shuffle_width


def hex_key(col: Column) -> Column:
    """The 32 hex digits of an id in lower case, however it is written; null when it has not exactly 32."""
    bare = F.regexp_replace(F.lower(col), r"urn:uuid:|[^0-9a-f]", "")
    return F.when(F.length(bare) == 32, bare)


def resolve_parents(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, parent): one row per id; parent is the id it refers to, or null for a root.

    A reference means an id if both are equal after trimming or have the same 32 hex digits.
    Null, empty and dangling references give a null parent. Several rows with one id
    keep the smallest non-null parent. Other columns are ignored.
    """
    base = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{parent_col}`").alias("ref")).where("id is not null")
    key = lambda c: F.nullif(F.coalesce(hex_key(c), F.trim(c, F.lit(" \t\r\n"))), F.lit(""))
    base = cut(base.select("id", key(F.col("id")).alias("k"), key(F.col("ref")).alias("rk")))
    known = base.groupBy(F.col("k").alias("rk")).agg(F.min("id").alias("parent"))
    found = lookup(base.select("id", "rk"), known, "rk", "id").select("id", "parent")
    return base.select("id", F.lit(None).cast(base.schema["id"].dataType).alias("parent")).unionByName(found).groupBy("id").agg(F.min("parent").alias("parent"))


def peel(edges: DataFrame, lists: bool = False, max_rounds: int = 500) -> DataFrame:
    """A row a node of (id, parent), contracted bottom-up: how and against what it was taken out.

    (id, act, par, anchor, dist, via, low, w, kid, add). ``act`` is leaf or skip, with the link to ``anchor`` of length ``dist`` over the ids
    ``via``, empty unless ``lists``; or root, or cycle, one node of each, with the smallest id of its cycle in ``low``. ``par`` is the
    parent given. ``w`` counts the node and all that its leaves sent; of a node that was jumped over, ``add`` plus the subtree
    size of ``kid`` is its subtree size, else ``add`` is ``w``. A round is one write: children are counted, leaves leave, and of
    unary nodes those whose hash of the round is below that of their parent and of their child, so no two in a row.
    The round's number is a column, not a constant, so that all rounds run the same compiled code.
    """
    kind = edges.schema["id"].dataType
    none = F.array().cast(f"array<{kind.simpleString()}>")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    state = edges.select("id", F.col("parent").alias("par"), "parent", one.alias("len"), F.col("id").alias("low"), one.alias("w"), zero.alias("lw"), none.alias("via"), F.lit(0).alias("k"), F.lit("keep").alias("act"))
    rounds: list[DataFrame] = []
    for _ in range(max_rounds):
        kept = F.col("act") == "keep"
        up = (
            state.where("act in ('keep', 'leaf') and parent is not null and parent != id")
            .groupBy(F.col("parent").alias("pid"))
            .agg(F.count_if(kept).alias("n"), F.max(F.when(kept, F.struct("id", "lw"))).alias("child"), F.sum(F.when(~kept, F.col("w") + F.col("lw"))).alias("sent"))
        )
        live = state.where(kept).drop("act", "kid", "add")
        loop = F.coalesce(F.col("parent") == F.col("id"), F.lit(False))
        n = F.coalesce("n", F.lit(0))
        coin = lambda c: F.xxhash64(c, F.col("k"))
        act = (
            F.when(F.col("parent").isNull(), F.when(n == 0, "root").otherwise("keep"))
            .when(loop, F.when(n == 0, "cycle").otherwise("keep"))
            .when(n == 0, "leaf")
            .when((n == 1) & (coin(F.col("id")) < coin(F.col("parent"))) & (coin(F.col("id")) < coin(F.col("child.id"))), "skip")
            .otherwise("keep")
        )
        role = live.join(up.hint("merge"), F.col("id") == F.col("pid"), "left").select(
            *[c for c in live.columns if c != "w"], (F.col("w") + F.coalesce("sent", F.lit(0))).alias("w"), act.alias("act"), F.col("child.id").alias("kid"), F.col("child.lw").alias("klw")
        )
        skips = role.where("act = 'skip'").select(F.col("kid").alias("to"), F.col("id").alias("sid"), F.col("parent").alias("sp"), F.col("len").alias("sl"), F.col("low").alias("slow"), F.col("w").alias("sw"), F.col("lw").alias("slw"), F.col("via").alias("svia"))
        # the child of a skipped node is hung to that node's parent
        moved = F.col("sid").isNotNull()
        skipped = F.col("act") == "skip"
        state = cut(
            role.join(skips.hint("merge"), F.col("id") == F.col("to"), "left").select(
                "id",
                "par",
                F.when(moved, F.col("sp")).otherwise(F.col("parent")).alias("parent"),
                (F.col("len") + F.coalesce("sl", F.lit(0))).alias("len"),
                F.when(moved, F.least("low", "slow")).otherwise(F.col("low")).alias("low"),
                "w",
                F.when(moved, F.col("lw") + F.col("sw") + F.col("slw")).otherwise(F.col("lw")).alias("lw"),
                (F.when(moved, F.concat("svia", F.array("sid"), "via")).otherwise(F.col("via")) if lists else F.col("via")).alias("via"),
                (F.col("k") + 1).alias("k"),
                "act",
                F.when(skipped, F.col("kid")).alias("kid"),
                F.when(skipped, F.col("w") + F.col("klw")).otherwise(F.col("w")).alias("add"),
            )
        )
        rounds.append(state)
        if state.where("act = 'keep'").isEmpty():
            break
    else:
        raise RuntimeError(f"{max_rounds} rounds did not contract the hierarchy")
    every = reduce(DataFrame.unionByName, rounds).where("act != 'keep'")
    out = every.select("id", "act", "par", F.col("parent").alias("anchor"), F.col("len").alias("dist"), "via", "low", "w", "kid", "add")
    return cut(out.coalesce(shuffle_width(edges.sparkSession)))


#: Nodes that can be the anchor of another: all that ever had a child. The many leaves of a tree needn't move.
HAD_CHILDREN = "act != 'leaf' or w > 1"


def roots_and_depths(edges: DataFrame) -> DataFrame:
    """(id, parent, root_id, depth) of every node of ``edges(id, parent)``.

    ``parent`` must be an id of the table or null. Where the line of parents runs into a
    cycle, depth is -1 and root_id the smallest id on that cycle. Roots have depth 0.
    An empty table gives an empty result.
    """
    nodes = peel(edges)
    end = F.col("act").isin("root", "cycle")
    now = nodes.select(
        "id", "par", "act", "w", F.when(~end, F.col("anchor")).alias("anchor"), F.when(end, F.when(F.col("act") == "cycle", F.col("low")).otherwise(F.col("id"))).alias("root_id"),
        F.when(F.col("act") == "cycle", -1).when(end, 0).otherwise(F.col("dist")).cast("bigint").alias("depth"),
    )
    while True:
        done, left = now.where("root_id is not null"), now.where("root_id is null")
        if left.isEmpty():
            return done.select("id", F.col("par").alias("parent"), "root_id", "depth")
        up = now.where(HAD_CHILDREN).select(F.col("id").alias("anchor"), F.col("anchor").alias("a2"), F.col("root_id").alias("r2"), F.col("depth").alias("d2"))
        further = lookup(left.drop("root_id"), up, "anchor", "id").select(
            "id", "par", "act", "w", F.col("a2").alias("anchor"), F.col("r2").alias("root_id"), F.when(F.col("d2") < 0, F.col("d2")).otherwise(F.col("depth") + F.col("d2")).alias("depth")
        )
        now = cut(done.unionByName(further).coalesce(shuffle_width(edges.sparkSession)))


def hierarchy(df: DataFrame, id_col: str = "id", parent_col: str = "parent_page_id") -> DataFrame:
    """(id, parent, root_id, depth) of every distinct id; see resolve_parents and roots_and_depths."""
    return roots_and_depths(resolve_parents(df, id_col, parent_col))


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """The rows of ``peel`` with ``size``, the nodes below each, itself included, and ``ring``, whether it lies on a cycle.

    A node that was jumped over adds what its leaves sent to the size of the child that went on, along a line of children
    no longer than the rounds. Between nodes of a cycle nothing counts: each has the finite trees that hang from it.
    """
    now = nodes.select("id", "kid", "add", (F.col("act") == "cycle").alias("ring"))
    jumped = now.where("kid is not null")
    while not jumped.isEmpty():
        up = now.select(F.col("id").alias("kid"), F.col("kid").alias("k2"), F.col("add").alias("a2"), F.col("ring").alias("r2"))
        further = jumped.join(up.hint("merge"), "kid").select("id", F.col("k2").alias("kid"), (F.col("add") + F.col("a2")).alias("add"), F.col("r2").alias("ring"))
        now = cut(now.where("kid is null").unionByName(further).coalesce(shuffle_width(nodes.sparkSession)))
        jumped = now.where("kid is not null")
    known = now.select("id", F.col("add").alias("size"), "ring")
    return nodes.join(known.hint("merge"), "id").withColumn("size", F.when(F.col("ring"), F.col("w")).otherwise(F.col("size")))


def paths(edges: DataFrame) -> DataFrame:
    """(id, path, subtree_size) of every node of ``edges(id, parent)``: ids from the top to the node, and the nodes below it, itself included.

    The links between nodes of a cycle are left out: such a node is the top of what hangs from it. Paths are put
    together from the ids that links jumped over, anchor by anchor; they cost the sum of all depths, the size of the result.
    """
    width = shuffle_width(edges.sparkSession)
    nodes = subtree_sizes(peel(edges, lists=True))
    top = F.col("ring") | (F.col("act") == "root")
    now = cut(nodes.select("id", "size", F.when(~top, F.col("anchor")).alias("anchor"), F.when(top, F.array("id")).otherwise(F.concat("via", F.array("id"))).alias("path")))
    while True:
        done, left = now.where("anchor is null"), now.where("anchor is not null")
        if left.isEmpty():
            return done.select("id", "path", F.col("size").alias("subtree_size"))
        up = now.where("size > 1").select(F.col("id").alias("anchor"), F.col("anchor").alias("a2"), F.col("path").alias("p2"))
        further = lookup(left, up, "anchor", "id").select("id", "size", F.col("a2").alias("anchor"), F.concat("p2", "path").alias("path"))
        now = cut(done.unionByName(further).coalesce(width))


def descendants(paths_: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every pair on a path of ``paths``, each node with itself at 0; nothing moves."""
    n = F.size("path")
    return paths_.select(F.col("id").alias("descendant"), n.alias("n"), F.posexplode("path").alias("p", "ancestor")).select("ancestor", "descendant", (F.col("n") - 1 - F.col("p")).cast("bigint").alias("distance"))
