"""Parent-child rows to full hierarchies (problem 6).

Nodes are placed into bounded fragments, each fragment contracts its local
parent chains to their exits, the quotient forest of fragment exits is solved
the same way until it fits one task, and fragment results are expanded again.
A chain that never leaves its fragment nor ends is a local cycle; one that
shows up only in the quotient is a global cycle.  Numbers of descendants are
subtree sums over the same fragments, so no list of them is made to count.

Defined results: a null, blank or unknown parent makes a root; ids are matched
without regard to letter case and surrounding blanks; a node put more than
once counts once (with its smallest spelling and, should the rows disagree,
its greatest parent); nodes on or below a cycle have no root and depth -1;
rows without an id are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.session import materialize, parallelism

#: Nodes that one task holds (about 100 bytes each in numpy); a quotient of no
#: more is the recursion's base.
TASK_NODES = 500_000
#: Children up to which a parent draws them into its own fragment.
DRAW = 1_000


def id_key(c: Column) -> Column:
    """An id without letter case and surrounding blanks; null where blank."""
    key = F.lower(F.regexp_replace(c.cast("string"), r"(?U)^[\s\u200B\uFEFF]+|[\s\u200B\uFEFF]+$", ""))
    return F.when(key != "", key)


def _gather(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    parts = [pdf for pdf in batches if len(pdf)]
    return pd.concat(parts, ignore_index=True) if parts else None


def _chase(v: np.ndarray, p: np.ndarray, has: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(parent, exit, dist, local): places of each node's parent and of its
    chain's last local node, by pointer doubling; ``local`` where the parent is
    here.  A chain whose exit is local too never ends."""
    order = np.argsort(v, kind="stable")
    parent = order[np.clip(np.searchsorted(v, p, sorter=order), 0, len(v) - 1)]
    local = has & (v[parent] == p)
    parent = np.where(local, parent, np.arange(len(v)))
    jump, dist = parent, np.where(local, w, 0)
    for _ in range(int(len(v)).bit_length() + 1):
        onward = jump[jump]
        if (onward == jump).all():
            break
        dist = dist + dist[jump]
        jump = onward
    return parent, jump, dist, local


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Local chains to exits, one fragment set per task.

    In: v, p (null: root), w (length of the link).  Out: v, exit, dist (sum of
    links to the exit), up (the exit's parent, null for a root), link (the
    length from exit to up), cyc.
    """
    pdf = _gather(batches)
    if pdf is None:
        return
    v, w = pdf["v"].to_numpy(np.int64), pdf["w"].to_numpy(np.int64)
    has, p = pdf["p"].notna().to_numpy(), pdf["p"].fillna(-1).to_numpy(np.int64)
    _, jump, dist, local = _chase(v, p, has, w)
    cyc = local[jump]  # still on the way after more steps than there are nodes
    up = pd.Series(p[jump], dtype="Int64").where(has[jump] & ~cyc)
    yield pd.DataFrame({"v": v, "exit": v[jump], "dist": np.where(cyc, 0, dist), "up": up, "link": w[jump], "cyc": cyc})


def _totals(inner: bool):
    """Sums of c over each node's local subtree.  In: frag, v, p, c and, with
    ``inner``, which links are local; else that is found here, and exits too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = _gather(batches)
        if pdf is None:
            return
        v, c = pdf["v"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64).copy()
        has, p = pdf["p"].notna().to_numpy(), pdf["p"].fillna(-1).to_numpy(np.int64)
        parent, jump, depth, local = _chase(v, p, has & pdf["inner"].to_numpy(bool) if inner else has, np.ones(len(v), np.int64))
        order = np.argsort(-depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[order])) + 1
        for nodes in np.split(order, cuts):  # the deepest first
            if depth[nodes[0]]:
                np.add.at(c, parent[nodes], c[nodes])
        if inner:
            yield pd.DataFrame({"v": v, "total": c})
        else:
            up = pd.Series(p[jump], dtype="Int64").where(has[jump])
            yield pd.DataFrame({"frag": pdf["frag"], "v": v, "p": pdf["p"].astype("Int64"), "c": pdf["c"], "total": c, "exit": v[jump], "up": up, "inner": local})

    return run


def _place(edges: DataFrame, fragments: int, level: int) -> DataFrame:
    """Nodes to fragments: a node joins its parent's fragment if a coin of both
    says so and the parent has few children, else it has its own."""
    many = edges.groupBy("p").count().where(F.col("count") > DRAW).select("p", F.lit(True).alias("_many"))
    coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(level)), F.lit(2))
    drawn = F.col("p").isNotNull() & F.col("_many").isNull() & (coin("v") == 0) & (coin("p") == 1)
    placed = edges.join(many, "p", "left").withColumn("_at", F.when(drawn, F.col("p")).otherwise(F.col("v")))
    return placed.repartition(fragments, F.xxhash64("_at", F.lit(level))).drop("_at", "_many")


def _fragments(n: int, task_nodes: int, level: int, spark) -> int:
    """Tasks that share n nodes; one only for a quotient that fits it."""
    return 1 if level and n <= task_nodes else max(parallelism(spark), -(-2 * n // task_nodes))


def solve_forest(edges: DataFrame, task_nodes: int = TASK_NODES, level: int = 0) -> DataFrame:
    """(v, p, w) with unique v and every p among them -> (v, root, depth).

    ``root`` is null and ``depth`` -1 on and below cycles; ``w`` is the length
    of the link to p.  Each level keeps only fragments that others lead to and
    makes a quarter of the links local at least, in expectation, so that the
    sizes of the levels form a geometric series.
    """
    edges = edges.select("v", "p", "w")
    fragments = _fragments(edges.count(), task_nodes, level, edges.sparkSession)
    placed = edges.repartition(1) if fragments == 1 else _place(edges, fragments, level)
    local = placed.mapInPandas(_contract, "v long, exit long, dist long, up long, link long, cyc boolean")
    if fragments == 1:
        return local.select(
            "v",
            F.when(~F.col("cyc"), F.col("exit")).alias("root"),
            F.when(F.col("cyc"), -1).otherwise(F.col("dist")).cast("long").alias("depth"),
        )
    local = materialize(local)
    exits = local.where("exit = v and up is not null").select(F.col("v").alias("x"), "up", "link")
    into = local.select(F.col("v").alias("up"), F.col("exit").alias("y"), F.col("dist").alias("d"), "cyc")
    links = materialize(
        exits.join(into, "up").select(
            "x", F.when(~F.col("cyc"), F.col("y")).alias("y"), (F.col("d") + F.col("link")).alias("w")
        )
    )
    # The quotient forest: only fragments that some other fragment leads to.
    # One that leads onto a local cycle gets a link to itself.
    used = links.where("y is not null").select(F.col("y").alias("v")).distinct()
    onward = links.select(F.col("x").alias("v"), F.coalesce("y", "x").alias("p"), "w")
    quotient = materialize(used.join(onward, "v", "left").select("v", "p", F.coalesce("w", F.lit(0)).alias("w")))
    solved = solve_forest(quotient, task_nodes, level + 1).select(F.col("v").alias("y"), "root", "depth")
    tops = links.join(solved, "y", "left").select(
        F.col("x").alias("exit"),
        "root",
        F.when(F.col("root").isNull(), -1).otherwise(F.col("depth") + F.col("w")).alias("depth"),
    )
    return local.join(tops, "exit", "left").select(
        "v",
        F.when(~F.col("cyc"), F.when(F.col("up").isNull(), F.col("exit")).otherwise(F.col("root"))).alias("root"),
        F.when(F.col("cyc") | (F.col("depth") < 0), -1)
        .when(F.col("up").isNull(), F.col("dist"))
        .otherwise(F.col("depth") + F.col("dist"))
        .cast("long")
        .alias("depth"),
    )


def subtree_sums(nodes: DataFrame, task_nodes: int = TASK_NODES, level: int = 0) -> DataFrame:
    """(v, p, c) of a forest without cycles -> (v, total): the sum of c over v
    and all below it.

    Each fragment's sum goes to the fragment its exit leads to; the quotient
    forest of the fragments that others lead to is summed the same way, and
    what arrives at a node is then added to all above it in its fragment."""
    nodes = nodes.select("v", "p", "c")
    fragments = _fragments(nodes.count(), task_nodes, level, nodes.sparkSession)
    placed = nodes.repartition(1) if fragments == 1 else _place(nodes, fragments, level)
    schema = "frag int, v long, p long, c long, total long, exit long, up long, inner boolean"
    local = placed.select(F.spark_partition_id().alias("frag"), "v", "p", "c").mapInPandas(_totals(False), schema)
    if fragments == 1:
        return local.select("v", "total")
    local = materialize(local)
    exits = local.where("exit = v").select(F.col("v").alias("x"), "up", F.col("total").alias("own"))
    links = materialize(
        exits.join(local.select(F.col("v").alias("up"), F.col("exit").alias("y")), "up", "left").select("x", "up", "y", "own")
    )
    used = links.where("y is not null").select(F.col("y").alias("x")).distinct()
    ends = links.join(used, "x", "left_anti")  # fragments that none leads to
    given = ends.where("y is not null").groupBy(F.col("y").alias("x")).agg(F.sum("own").alias("_c"))
    quotient = used.join(links, "x").join(given, "x", "left")
    quotient = materialize(quotient.select(F.col("x").alias("v"), F.col("y").alias("p"), (F.col("own") + F.coalesce("_c", F.lit(0))).alias("c")))
    solved = subtree_sums(quotient, task_nodes, level + 1).select(F.col("v").alias("x"), "total")
    sums = links.join(solved, "x", "left").select("up", F.coalesce("total", "own").alias("s")).where("up is not null")
    arrived = sums.groupBy(F.col("up").alias("v")).agg(F.sum("s").alias("_s"))
    full = local.join(arrived, "v", "left").select("frag", "v", "p", "inner", (F.col("c") + F.coalesce("_s", F.lit(0))).alias("c"))
    return full.repartition(fragments, "frag").mapInPandas(_totals(True), "v long, total long")


def parent_links(rows: DataFrame, node: str, parent: str, hierarchy: str) -> DataFrame:
    """(hierarchy, key, node_id, parent key or null), one row for each node."""
    return (
        rows.select(F.col(node).cast("string").alias("node_id"), id_key(F.col(parent)).alias("parent"))
        .withColumn("key", id_key(F.col("node_id")))
        .where("key is not null")
        .groupBy("key")
        .agg(F.min("node_id").alias("node_id"), F.max("parent").alias("parent"))
        .select(F.lit(hierarchy).alias("hierarchy"), "key", "node_id", "parent")
    )


def numbered_forest(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (v, hierarchy, node_id) and edges (v, p, w) over long numbers."""
    nodes = materialize(links.withColumn("v", F.monotonically_increasing_id()))
    ends = nodes.select("hierarchy", F.col("key").alias("parent"), F.col("v").alias("p"))
    known = nodes.where("parent is not null").select("v", "hierarchy", "parent").join(ends, ["hierarchy", "parent"])
    roots = nodes.select("v").join(known.select("v", "p"), "v", "left")
    edges = materialize(roots.select("v", "p", F.lit(1).cast("long").alias("w")))
    return nodes.select("v", "hierarchy", "node_id"), edges


def resolve_hierarchy(links: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """(hierarchy, node_id, root_id, depth) for each node of ``parent_links``."""
    nodes, edges = numbered_forest(links)
    solved = solve_forest(edges, task_nodes)
    names = nodes.select(F.col("v").alias("root"), F.col("node_id").alias("root_id"))
    return (
        nodes.join(solved, "v")
        .join(names, "root", "left")
        .select("hierarchy", "node_id", F.coalesce("root_id", F.lit("")).alias("root_id"), "depth")
    )


def descendant_counts(links: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """(hierarchy, node_id, descendants): how many nodes are below each node;
    null on and below cycles."""
    nodes, edges = numbered_forest(links)
    sound = materialize(solve_forest(edges, task_nodes)).where("depth >= 0").select("v")
    sums = subtree_sums(edges.join(sound, "v").select("v", "p", F.lit(1).cast("long").alias("c")), task_nodes)
    return nodes.join(sums, "v", "left").select("hierarchy", "node_id", (F.col("total") - 1).alias("descendants"))


def ancestor_pairs(edges: DataFrame, solved: DataFrame) -> DataFrame:
    """(v, ancestor, distance) for every node that is on no cycle, itself at 0.

    Grown by doubling: pairs up to distance 2^k join the pairs at exactly 2^k,
    so a hierarchy of depth d takes log2(d) joins.  The result is as large as
    the sum of all depths; each node's descendants are its rows by ancestor.
    """
    sound = solved.where("depth >= 0").select("v", "depth")
    hop = materialize(edges.where("p is not null").join(sound, "v", "left_semi").select("v", F.col("p").alias("a")))
    pairs = sound.select("v", F.col("v").alias("a"), F.lit(0).cast("long").alias("distance"))
    deepest = sound.agg(F.max("depth")).first()[0] or 0
    step = 1
    while step <= deepest:
        reach = pairs.join(hop.select(F.col("v").alias("a"), F.col("a").alias("b")), "a")
        grown = reach.select("v", F.col("b").alias("a"), (F.col("distance") + step).alias("distance"))
        pairs = materialize(pairs.unionByName(grown))
        hop = materialize(hop.join(hop.select(F.col("v").alias("a"), F.col("a").alias("b")), "a").select("v", F.col("b").alias("a")))
        step *= 2
    return pairs.select("v", F.col("a").alias("ancestor"), "distance")


def descendant_pairs(links: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """(hierarchy, node_id, descendant_id): each node with every other node that
    is below it, on and below cycles too.

    The result is as large as the sum of all depths; a cycle's is the square of
    its length, as each of its nodes is below all others."""
    nodes, edges = numbered_forest(links)
    solved = materialize(solve_forest(edges, task_nodes))
    pairs = ancestor_pairs(edges, solved).where("distance > 0").select("v", F.col("ancestor").alias("a"))
    # Where the way up never ends, pairs meet pairs until none is new.
    loops = materialize(edges.join(solved.where("depth < 0"), "v", "left_semi").select("v", F.col("p").alias("a")))
    known, count = 0, loops.count()
    while count > known:
        longer = loops.join(loops.select(F.col("v").alias("a"), F.col("a").alias("b")), "a").select("v", F.col("b").alias("a"))
        loops = materialize(loops.unionByName(longer).distinct())
        known, count = count, loops.count()
    names = nodes.select(F.col("v").alias("a"), "hierarchy", "node_id")
    below = nodes.select("v", F.col("node_id").alias("descendant_id"))
    return pairs.unionByName(loops.where("v != a")).join(names, "a").join(below, "v").select("hierarchy", "node_id", "descendant_id")


def expand_hierarchy(links: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """Per node: root, depth, full path from the root, number of descendants.

    ``path`` is an array of node ids, the node itself last; empty on cycles,
    where ``descendants`` is null.
    """
    nodes, edges = numbered_forest(links)
    solved = materialize(solve_forest(edges, task_nodes))
    pairs = ancestor_pairs(edges, solved)
    sound = solved.where("depth >= 0").select("v")
    below = subtree_sums(edges.join(sound, "v").select("v", "p", F.lit(1).cast("long").alias("c")), task_nodes)
    names = nodes.select(F.col("v").alias("ancestor"), F.col("node_id").alias("name"))
    paths = (
        pairs.join(names, "ancestor")
        .groupBy("v")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "name"))), lambda x: x["name"]).alias("path"))
    )
    return (
        nodes.join(solved, "v")
        .join(paths, "v", "left")
        .join(below, "v", "left")
        .select(
            "hierarchy",
            "node_id",
            F.coalesce(F.try_element_at("path", F.lit(1)), F.lit("")).alias("root_id"),
            "depth",
            F.coalesce("path", F.array().cast("array<string>")).alias("path"),
            (F.col("total") - 1).alias("descendants"),
        )
    )
