import random

import pytest
from pyspark.sql import functions as F

from almagest.operators.hierarchy import _placed, descendants, resolve_hierarchy

SCHEMA = "forest string, node string, parents array<string>, root string"


def brute(rows):
    up = {}
    for f, n, ps, _ in rows:
        if n is not None:
            up.setdefault((f, n), set()).update(p for p in ps or [] if p is not None)
    up = {k: {p for p in ps if (k[0], p) in up} for k, ps in up.items()}
    out = set()
    for f, n in up:
        dist, todo, cyclic = {n: 0}, [n], False
        while todo:
            nxt = []
            for x in todo:
                for p in up[f, x]:
                    if p not in dist:
                        dist[p] = dist[x] + 1
                        nxt.append(p)
            todo = nxt
        for x in dist:  # x is on a circle if it reaches itself
            seen, todo = set(), [x]
            while todo:
                y = todo.pop()
                for p in up[f, y]:
                    if p == x:
                        cyclic = True
                    if p not in seen:
                        seen.add(p)
                        todo.append(p)
        if cyclic:
            out.add((f, n, "cycle", -1))
        else:
            out |= {(f, n, r, d) for r, d in dist.items() if not up[f, r]}
    return out


@pytest.mark.parametrize("fragment", [3, 7, 1000])
def test_random_forests(spark, fragment):
    rng = random.Random(5)
    rows = []
    for f in ("a", "b"):
        for i in range(60):
            ps = [f"n{rng.randrange(max(1, i))}" for _ in range(rng.choice([0, 1, 1, 1, 2]))] if i else []
            rows.append((f, f"n{i}", ps or None, "clash"))
        rows += [(f, "c1", ["c2"], None), (f, "c2", ["c1", None], None), (f, "below", ["c1", "n3"], None), (f, "self", ["self"], None), (f, "lost", ["nowhere", ""], None), (f, "n5", ["n1"], None), (f, None, ["n1"], None)]
    rows += rows[:5]
    got = {(r.forest, r.node, r.root, r.depth) for r in resolve_hierarchy(spark.createDataFrame(rows, SCHEMA), fragment_rows=fragment).collect()}
    assert got == brute(rows)


def test_long_chain_paths_and_descendants(spark):
    rows = [("x", f"{i:03d}", [f"{i - 1:03d}"] if i else None, None) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    last = resolve_hierarchy(df, fragment_rows=10).filter("node = '039'").collect()
    assert [(r.root, r.depth, list(r.path)) for r in last] == [("000", 39, [f"{i:03d}" for i in range(39, -1, -1)])]
    assert {(r.node, r.descendant, r.depth) for r in descendants(df).collect()} == {(f"{i:03d}", f"{j:03d}", j - i) for i in range(40) for j in range(i + 1, 40)}


def test_hot_parent_and_node_of_very_many_parents_are_split(spark):
    hub = spark.range(20_000).select(F.lit("x").alias("forest"), F.concat(F.lit("c"), "id").alias("node"), F.array(F.lit("hub"), F.lit("top")).alias("parents"))
    wide = spark.range(20_000).groupBy().agg(F.collect_list(F.concat(F.lit("c"), "id")).alias("parents")).select(F.lit("x").alias("forest"), F.lit("wide").alias("node"), "parents")
    rest = spark.createDataFrame([("x", "hub", ["top"]), ("x", "top", None), ("x", "low", ["wide"])], "forest string, node string, parents array<string>")
    links = hub.unionByName(wide).unionByName(rest)
    rows = links.select("forest", "node", F.explode("parents").alias("exit"), F.lit("link").alias("kind"))
    for level in range(4):
        sizes = _placed(rows, 4000, level).groupBy("_g").count()
        assert sizes.agg(F.max("count")).first()[0] < 3 * 4000 and sizes.count() > 10
    got = {r.node: (r.root, r.depth) for r in resolve_hierarchy(links, fragment_rows=4000).filter("node in ('wide', 'low', 'c7', 'hub', 'top')").collect()}
    assert got == {"wide": ("top", 2), "low": ("top", 3), "c7": ("top", 1), "hub": ("top", 1), "top": ("top", 0)}


def test_empty(spark):
    assert resolve_hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0
