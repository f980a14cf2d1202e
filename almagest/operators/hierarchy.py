"""Parent-child links of unknown depth to full hierarchies: paths, depths, roots, cycles.

Links are contracted inside bounded fragments: each fragment solves its own chains up to their exits (a root, or a
node that lives in another fragment). Only the nodes that other fragments point to form the quotient forest, with the
chains as weighted links; it is solved by the same step until one fragment holds it. Then fragment paths are expanded
with the solved exits. A circle inside a fragment is seen there, a circle across fragments in a later quotient.

No fragment holds more than its share of one key: the children of a parent that has very many are spread over several
fragments (those without the parent keep it as their exit), and so are the links of a node with very many parents (no
other node passes through such a node inside a fragment).
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.operators.graph import closure
from almagest.plans import cut, parts_for, small

LINK, ROOT, CYCLE = "link", "root", "cycle"
_SCHEMA = "forest string, node string, exit string, steps int, kind string, path array<string>"
#: A link row is a step to a node that may lie elsewhere, a root row a finished chain, a cycle row a node on or below a circle.


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Chains of one fragment up to their exits, the shortest per exit (ties: the smallest path)."""
    rows: dict = defaultdict(list)
    split = set()
    for f, n, x, s, k, p, w in zip(pdf.forest, pdf.node, pdf.exit, pdf.steps, pdf.kind, pdf.path, pdf.wide, strict=True):
        rows[f, n].append((x, int(s), k, tuple(p)))
        if w:
            split.add((f, n))
    below, waits = defaultdict(list), {}
    for (f, n), links in rows.items():
        local = {(f, x) for x, _, k, _ in links if k == LINK and (f, x) in rows and (f, x) not in split}
        waits[f, n] = len(local)
        for up in local:
            below[up].append((f, n))
    ready, best = [n for n, w in waits.items() if not w], {}
    while ready:
        me = ready.pop()
        mine: dict = {}
        for x, s, k, p in rows[me]:
            if k == CYCLE:
                cases = [((CYCLE, CYCLE), (0, ()))]
            elif k == LINK and (up := (me[0], x)) in best and up not in split:
                cases = [(key, (s + t, p + q[1:])) for key, (t, q) in best[up].items()]
            else:
                cases = [((k, x), (s, p))]
            for key, val in cases:
                if key not in mine or val < mine[key]:
                    mine[key] = val
        best[me] = {(CYCLE, CYCLE): (0, ())} if (CYCLE, CYCLE) in mine else mine
        for n in below[me]:
            waits[n] -= 1
            if not waits[n]:
                ready.append(n)
    out = [(f, n, x, s, k, list(p)) for (f, n), found in best.items() for (k, x), (s, p) in found.items()]
    out += [(f, n, CYCLE, 0, CYCLE, []) for (f, n) in rows if (f, n) not in best]  # never freed: on or below a local circle
    return pd.DataFrame(out, columns=["forest", "node", "exit", "steps", "kind", "path"])


def _placed(rows: DataFrame, fragment_rows: int, level: int) -> DataFrame:
    """Rows with their fragment (_g) and whether their node is spread over several (wide)."""
    n = rows.count()
    parts = parts_for(n, fragment_rows)
    if parts == 1:
        return rows.withColumns({"_g": F.lit(0), "wide": F.lit(False)})
    share = max(1, fragment_rows // 4)  # of a fragment, for one key
    # a node whose hash is odd follows its first parent if that one's hash is even: a quarter of all links is local, however many fragments there are
    side = lambda c: F.pmod(F.xxhash64("forest", c, F.lit(level)), F.lit(2))
    first = rows.groupBy("forest", "node").agg(F.min(F.when(F.col("kind") == LINK, F.col("exit"))).alias("_up"), F.count("*").alias("_rows"))
    follows = (side("node") == 1) & F.col("_up").isNotNull() & (side("_up") == 0)
    home = first.select("forest", "node", F.col("_rows") > share, F.when(F.col("_rows") > share, F.ceil(F.col("_rows") / share)).otherwise(1).alias("_own"), F.when(follows & (F.col("_rows") <= share), F.col("_up")).otherwise(F.col("node")).alias("_h")).toDF("forest", "node", "wide", "_own", "_h")
    hot = home.groupBy("forest", "_h").agg(F.ceil(F.count("*") / share).alias("_salts")).filter("_salts > 1")  # at most 4 per fragment
    home = home.join(small(hot), ["forest", "_h"], "left")
    salt = F.when(F.col("_h") == F.col("node"), F.lit(0)).otherwise(F.pmod(F.xxhash64("node", F.lit(level)), F.coalesce("_salts", F.lit(1))))
    placed = rows.join(home.withColumn("_salt", salt).drop("_salts"), ["forest", "node"])
    salt = F.when(F.col("wide"), F.pmod(F.xxhash64("exit", "kind", F.lit(level)), F.col("_own"))).otherwise(F.col("_salt"))
    return placed.withColumn("_g", F.pmod(F.xxhash64("_h", salt, F.lit(level)), F.lit(parts))).drop("_h", "_own", "_salt")


def _contract(rows: DataFrame, fragment_rows: int, level: int) -> DataFrame:
    """One row per node that lies on or below no known circle and per exit (or one cycle row)."""
    return _placed(rows, fragment_rows, level).groupBy("_g").applyInPandas(_solve, _SCHEMA)


def _resolve(rows: DataFrame, fragment_rows: int, level: int = 0) -> DataFrame:
    local = cut(_contract(rows, fragment_rows, level))
    open_ = local.filter(F.col("kind") == LINK)
    entries = open_.select("forest", F.col("exit").alias("node")).distinct()
    if open_.isEmpty():
        return local
    solved = _resolve(local.join(entries, ["forest", "node"], "left_semi"), fragment_rows, level + 1)
    up = solved.select("forest", F.col("node").alias("exit"), F.col("exit").alias("_x"), F.col("steps").alias("_s"), F.col("kind").alias("_k"), F.col("path").alias("_p"))
    grown = open_.join(up, ["forest", "exit"]).select(
        "forest", "node", F.col("_x").alias("exit"), F.when(F.col("_k") == CYCLE, F.lit(0)).otherwise(F.col("steps") + F.col("_s")).cast("int").alias("steps"), F.col("_k").alias("kind"),
        F.when(F.col("_k") == CYCLE, F.array().cast("array<string>")).otherwise(F.concat("path", F.slice("_p", 2, 2**30))).alias("path"),
    )
    every = local.filter(F.col("kind") != LINK).unionByName(grown)
    best = every.groupBy("forest", "node", "exit", "kind").agg(F.min(F.struct("steps", "path")).alias("b")).select("forest", "node", "exit", "b.steps", "kind", "b.path")
    circles = best.filter(F.col("kind") == CYCLE).select("forest", "node").distinct()
    return cut(best.join(circles, ["forest", "node"], "left_anti").unionByName(best.filter(F.col("kind") == CYCLE)))


def resolve_hierarchy(links: DataFrame, *, fragment_rows: int = 200_000) -> DataFrame:
    """(forest, node, root, depth, path) from links (forest string, node string, parents array<string>).

    One row for each node and each root it descends from, with the fewest steps and the path from the node up to the
    root (of paths equally short the smallest). A root's own row has depth 0. A node on a circle, or below one, has a
    single row with root ``cycle``, depth -1 and an empty path. Repeated rows and rows with several parents add up;
    null nodes, null or empty parents, and parents without a row of their own are ignored; a node that is its own
    parent is a circle. Empty input gives an empty result; other columns are ignored.
    """
    rows = links.select("forest", "node", "parents").filter("node is not null and forest is not null")
    nodes = rows.select("forest", "node").distinct()
    pairs = rows.select("forest", "node", F.explode("parents").alias("exit")).filter("exit is not null").distinct()
    real = pairs.join(nodes.withColumnRenamed("node", "exit"), ["forest", "exit"], "left_semi")
    up = real.select("forest", "node", "exit", F.lit(1).alias("steps"), F.lit(LINK).alias("kind"), F.array("node", "exit").alias("path"))
    tops = nodes.join(real, ["forest", "node"], "left_anti").select("forest", "node", F.col("node").alias("exit"), F.lit(0).alias("steps"), F.lit(ROOT).alias("kind"), F.array("node").alias("path"))
    solved = _resolve(cut(up.unionByName(tops)), fragment_rows)
    return solved.select("forest", "node", F.col("exit").alias("root"), F.when(F.col("kind") == CYCLE, F.lit(-1)).otherwise(F.col("steps")).cast("int").alias("depth"), "path")


def descendants(links: DataFrame) -> DataFrame:
    """(forest, node, descendant, depth): every node below each node with the fewest steps; nodes on or below circles take no part.

    As many rows as there are pairs, formed by doubling distances. Input as for ``resolve_hierarchy``; a node without
    descendants has no row.
    """
    good = resolve_hierarchy(links).filter("depth >= 0").select("forest", "node").distinct()
    edges = (
        links.select("forest", "node", F.explode("parents").alias("up")).distinct()
        .join(good, ["forest", "node"], "left_semi").join(good.withColumnRenamed("node", "up"), ["forest", "up"], "left_semi")
    )
    pairs = closure(edges.select(F.struct("forest", "node").alias("node"), F.struct("forest", F.col("up").alias("node")).alias("up")), reflexive=False)
    return pairs.select("above.forest", "above.node", F.col("node.node").alias("descendant"), F.col("depth").cast("int").alias("depth"))
