"""Closures and walks over edge tables."""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almagest.plans import cut


def closure(edges: DataFrame, *, max_depth: int | None = None, reflexive: bool = True) -> DataFrame:
    """(node, above, depth): every node above each node with the fewest steps; circles end by themselves.

    ``edges`` has node, up. Each round joins the pairs at exactly the distance reached so far with all known ones, which
    doubles it; ``max_depth`` bounds the steps. With ``reflexive`` each node is above itself at depth 0.
    """
    e = cut(edges.select("node", "up").filter("node is not null and up is not null").distinct())
    known = e.select("node", F.col("up").alias("above"), F.lit(1).alias("depth")).filter("node <> above")
    reach, some = 1, not e.isEmpty()
    while some and (max_depth is None or reach < max_depth):
        far = known.filter(F.col("depth") == reach).select("node", F.col("above").alias("_mid"))
        on = known.select(F.col("node").alias("_mid"), "above", F.col("depth").alias("_d"))
        fresh = far.join(on, "_mid").filter("node <> above").groupBy("node", "above").agg((F.min("_d") + reach).alias("depth"))
        if max_depth is not None:
            fresh = fresh.filter(F.col("depth") <= max_depth)
        fresh = cut(fresh.join(known, ["node", "above"], "left_anti"))
        if fresh.isEmpty():
            break
        known, reach = cut(known.unionByName(fresh)), reach * 2
    if not reflexive:
        return known
    own = e.select("node").unionByName(e.select(F.col("up").alias("node"))).distinct()
    return known.unionByName(own.select("node", F.col("node").alias("above"), F.lit(0).alias("depth")))


def follow_redirects(redirects: DataFrame, *, max_hops: int = 16) -> DataFrame:
    """(id, final): where each redirected id ends, at most ``max_hops`` away; chains that run in circles stop there.

    ``redirects`` has id, into, one row per id. Hops double with each round.
    """
    at = cut(redirects.select("id", F.col("into").alias("final")))
    hops = max_hops if at.isEmpty() else 1
    while hops < max_hops:
        nxt = at.select(F.col("id").alias("final"), F.col("final").alias("_far"))
        at = cut(at.join(nxt, "final", "left").select("id", F.coalesce("_far", "final").alias("final")))
        hops *= 2
    return at


def neighbours(edges: DataFrame, start: DataFrame, *, depth: int = 1, direction: str = "both") -> DataFrame:
    """The edges (src, dst and all other columns) within ``depth`` steps (at most 3) of the nodes in ``start`` (column node), each once, with the step they were met at."""
    if not 1 <= depth <= 3:
        raise ValueError("depth must be 1, 2 or 3")
    frontier, seen, out = start.select("node").distinct(), None, None
    for k in range(1, depth + 1):
        met = []
        if direction in ("out", "both"):
            met.append(edges.join(frontier, edges["src"] == frontier["node"], "left_semi").withColumn("step", F.lit(k)).withColumn("_n", F.col("dst")))
        if direction in ("in", "both"):
            met.append(edges.join(frontier, edges["dst"] == frontier["node"], "left_semi").withColumn("step", F.lit(k)).withColumn("_n", F.col("src")))
        found = met[0] if len(met) == 1 else met[0].unionByName(met[1])
        seen = frontier if seen is None else seen.unionByName(frontier)
        frontier = cut(found.select(F.col("_n").alias("node")).filter("node is not null").distinct().join(seen, "node", "left_anti"))
        part = found.drop("_n")
        out = part if out is None else out.unionByName(part)
    cols = [c for c in out.columns if c != "step"]
    return out.groupBy(*cols).agg(F.min("step").alias("step"))


def neighbours_each(edges: DataFrame, start: DataFrame, *, depth: int = 1) -> DataFrame:
    """(start and all columns of the edges, step): for each of the nodes in ``start`` (column node) the edges (src, dst and others) within ``depth`` steps in either direction, each once."""
    if not 1 <= depth <= 3:
        raise ValueError("depth must be 1, 2 or 3")
    cols = edges.columns
    ends = edges.withColumn("_n", F.col("src")).unionByName(edges.withColumn("_n", F.col("dst"))).distinct()
    frontier = start.select(F.col("node").alias("start"), F.col("node").alias("_n")).distinct()
    seen, out = frontier, None
    for k in range(1, depth + 1):
        found = frontier.join(ends, "_n").select("start", *cols).distinct().withColumn("step", F.lit(k))
        out = found if out is None else out.unionByName(found)
        if k < depth:
            reached = found.select("start", F.explode(F.array("src", "dst")).alias("_n")).filter("_n is not null").distinct()
            frontier = cut(reached.join(seen, ["start", "_n"], "left_anti"))
            seen = seen.unionByName(frontier)
    return out.groupBy("start", *cols).agg(F.min("step").alias("step"))


def _local_levels(edges: pd.DataFrame) -> pd.DataFrame:
    after, waits = defaultdict(list), defaultdict(int)
    for a, b in zip(edges["src"], edges["dst"], strict=True):
        after[a].append(b)
        waits[b] += 1
    level = {n: 0 for n in after if not waits[n]}
    todo = deque(level)
    while todo:
        a = todo.popleft()
        for b in after[a]:
            level[b] = max(level.get(b, 0), level[a] + 1)
            waits[b] -= 1
            if not waits[b]:
                todo.append(b)
    return pd.DataFrame([(n, x) for n, x in level.items() if not waits[n]], columns=["node", "level"])


def order_levels(edges: DataFrame, *, task_edges: int = 1_000_000) -> DataFrame:
    """(node, level): nodes of an acyclic before-after graph by the longest chain before them; nodes on or behind circles have no row.

    ``edges`` has src (before) and dst (after); nodes without an edge have no row. Up to ``task_edges`` edges are one
    task's work, whatever their depth. More are taken level by level, each round placing the nodes whose predecessors
    are all placed, until what is left fits one task or can't be placed; no depth is cut off.
    """
    node = edges.schema["src"].dataType.simpleString()
    e = cut(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    left = cut(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct())
    done, level = left.filter("false").withColumn("level", F.lit(0)), 0
    while e.count() > task_edges:
        free = cut(left.join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        if free.isEmpty():
            return done  # circles only
        done, level = done.unionByName(free.withColumn("level", F.lit(level))), level + 1
        e, left = cut(e.join(free.withColumnRenamed("node", "src"), "src", "left_anti")), cut(left.join(free, "node", "left_anti"))
    rest = e.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(_local_levels, f"node {node}, level int").select("node", (F.col("level") + level).alias("level"))
    # nodes of the current level that no edge is left to lead to or from
    alone = left.join(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct(), "node", "left_anti").withColumn("level", F.lit(level))
    return done.unionByName(alone).unionByName(rest)


def branch_chains(branches: DataFrame, *, max_depth: int = 64) -> DataFrame:
    """(branch_id, member, position, seq_limit): the branch and its ancestors, nearest first, with the last revision seen of each.

    The limit of an ancestor is the smallest fork_seq on the way to it; that of the branch itself is open (null).
    """
    b = cut(branches.select("branch_id", "parent", "fork_seq").dropDuplicates(["branch_id"]))
    linked = b.join(b.select(F.col("branch_id").alias("parent")), "parent", "left_semi")
    known = linked.select("branch_id", F.col("parent").alias("member"), F.lit(1).alias("position"), F.col("fork_seq").alias("seq_limit"))
    reach = 1
    while reach < max_depth:  # as in ``closure``: the distance doubles
        far = known.filter(F.col("position") == reach).select("branch_id", F.col("member").alias("_mid"), F.col("seq_limit").alias("_l"))
        on = known.select(F.col("branch_id").alias("_mid"), "member", "position", "seq_limit")
        fresh = cut(far.join(on, "_mid").select("branch_id", "member", (F.col("position") + reach).alias("position"), F.least("seq_limit", "_l").alias("seq_limit")).filter(F.col("position") <= max_depth))
        if fresh.isEmpty():
            break
        known, reach = cut(known.unionByName(fresh)), reach * 2
    own = b.select("branch_id", F.col("branch_id").alias("member"), F.lit(0).alias("position"), F.lit(None).cast("bigint").alias("seq_limit"))
    out = known.unionByName(own)
    nearest = W.partitionBy("branch_id", "member").orderBy("position")
    return out.withColumn("_r", F.row_number().over(nearest)).filter("_r = 1").drop("_r").select("branch_id", "member", F.col("position").cast("bigint").alias("position"), "seq_limit")
