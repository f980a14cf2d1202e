"""Consolidating pairwise matches into groups.

Union-find runs inside bounded edge partitions and keeps of each only a spanning forest, as stars (vertex -> smallest
vertex of its local tree). A vertex seen in several partitions links their trees: those links, between tree centres
only, are the edges of the next level, until one partition holds them all; then each vertex follows its centres down
to the global one.

Partitions are formed anew at each level by a random priority of the vertices: every edge goes to the home of its
ends, the vertex of least priority among an end and its neighbours, and edges of one home lie together. So each local
tree takes in a neighbourhood, and the number of centres shrinks by a constant factor per level whatever the order of
the ids (2.6 for a chain, more for denser graphs). Homes are cut into partitions by range, ties by edge, so that a
vertex with a third of all edges is spread over as many partitions as its edges fill.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.plans import cut, parts_for


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its tree) for the vertices of the edges (a, b)."""
    names, codes = np.unique(np.concatenate([a, b]), return_inverse=True)  # sorted: the smaller code is the smaller name
    up = list(range(len(names)))
    n = len(a)
    for x, y in zip(codes[:n].tolist(), codes[n:].tolist(), strict=True):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x < y:
            up[y] = x
        elif y < x:
            up[x] = y
    roots = np.array(up)
    while not np.array_equal(roots, roots[roots]):
        roots = roots[roots]
    return names, names[roots]


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars of the partition's spanning forest; between batches only the forest so far is kept."""
    v, r = np.array([], dtype=object), np.array([], dtype=object)
    for pdf in batches:
        v, r = union_find(np.concatenate([v, pdf.a.to_numpy(object)]), np.concatenate([r, pdf.b.to_numpy(object)]))
    for i in range(0, len(v), 100_000):
        yield pd.DataFrame({"v": v[i : i + 100_000], "rep": r[i : i + 100_000]})


def _gathered(edges: DataFrame, parts: int, level: int) -> DataFrame:
    """The edges in bounded partitions, those of one home side by side."""
    priority = lambda c: F.xxhash64(c, F.lit(level))
    ends = edges.select(F.col("a").alias("v"), priority("b").alias("p")).unionByName(edges.select(F.col("b").alias("v"), priority("a").alias("p")))
    home = ends.groupBy("v").agg(F.least(priority("v"), F.min("p")).alias("h"))
    # the edges of a vertex with very many of them are the left side, which adaptive execution splits
    keyed = edges.join(home.select(F.col("v").alias("a"), F.col("h").alias("_ha")), "a", "left").join(home.select(F.col("v").alias("b"), F.col("h").alias("_hb")), "b", "left")
    return keyed.withColumn("_k", F.least("_ha", "_hb")).repartitionByRange(parts, "_k", F.xxhash64("a", "b")).select("a", "b")


def forest_levels(edges: DataFrame, partition_edges: int) -> list[DataFrame]:
    """Per level (v, rep): the centre of each vertex. ``edges`` has a < b, each once."""
    levels: list[DataFrame] = []
    while (n := edges.count()) > 0:
        parts = parts_for(n, partition_edges)
        near = edges.repartition(1) if parts == 1 else _gathered(edges, parts, len(levels))
        stars = cut(near.mapInPandas(_forest, "v string, rep string"))
        levels.append(stars.groupBy("v").agg(F.min("rep").alias("rep")))
        if parts == 1:
            break
        # the partitions' number bounds a vertex' centres
        edges = cut(
            stars.groupBy("v").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("all")).filter(F.size("all") > 1)
            .select("a", F.explode("all").alias("b")).filter("a <> b").distinct()
        )
    return levels


def connected_groups(pairs: DataFrame, a: str, b: str, *, partition_edges: int = 500_000) -> DataFrame:
    """(group_id, member): every end of a pair between different ids, with the smallest id of all it is linked to.

    Pairs with a null end, and an id paired with itself, link nothing. Repeated pairs, in either direction, count once.
    Empty input gives an empty result; other columns are ignored. ``partition_edges`` bounds what one task holds.
    """
    x, y = F.col(a).cast("string"), F.col(b).cast("string")
    edges = cut(pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct())
    levels = forest_levels(edges, partition_edges)
    if not levels:
        return edges.select(F.col("a").alias("group_id"), F.col("b").alias("member"))
    found = levels[-1]
    for level in reversed(levels[:-1]):
        up = found.select(F.col("v").alias("rep"), F.col("rep").alias("_top"))
        found = level.join(up, "rep", "left").select("v", F.coalesce("_top", "rep").alias("rep"))
    return found.select(F.col("rep").alias("group_id"), F.col("v").alias("member"))
