import random

import numpy as np

from almagest.functions.vectors import nearest_each
from almagest.operators.graph import neighbours_each, order_levels


def test_levels_of_a_chain_of_any_depth(spark):
    chain = [(i, i + 1) for i in range(3000)] + [(10, 2000), (None, 5), (7, None), (5000, 5001), (5001, 5000), (5001, 5002)]
    got = {r.node: r.level for r in order_levels(spark.createDataFrame(chain, "src int, dst int")).collect()}
    assert got == {i: i for i in range(3001)}


def test_levels_in_rounds_equal_those_of_one_task(spark):
    rng = random.Random(4)
    edges = [(a, a + rng.randrange(1, 9)) for a in range(60) for _ in range(2)] + [(100, 101), (101, 100), (101, 102)]
    df = spark.createDataFrame(edges, "src int, dst int")
    one, many = ({r.node: r.level for r in order_levels(df, task_edges=n).collect()} for n in (1000, 90))
    assert one == many and len(one) > 50 and 101 not in one
    assert order_levels(df.filter("false")).count() == 0


def test_neighbours_of_each(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "a"), ("a", "b")], "src string, dst string")
    got = {(r.start, r.src, r.dst, r.step) for r in neighbours_each(edges, spark.createDataFrame([("a",), ("d",)], "node string"), depth=2).collect()}
    assert got == {("a", "a", "b", 1), ("a", "x", "a", 1), ("a", "b", "c", 2), ("d", "c", "d", 1), ("d", "b", "c", 2)}


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, size=(300, 6)).astype(float)  # many ties
    df = spark.createDataFrame([(i, x.tolist(), int(i % 3)) for i, x in enumerate(v)] + [(999, [1.0], 0), (998, None, 0)], "vec_id bigint, embedding array<double>, label int")
    for kw in ({}, {"same": "label"}, {"by": "hamming"}):
        got = {}
        for r in nearest_each(df, df.filter("vec_id % 50 = 0"), 7, 6, block_rows=40, block_queries=2, **kw).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        for q in range(0, 300, 50):
            far = (np.sign(v - 1e-9) != np.sign(v[q] - 1e-9)).sum(1) if kw.get("by") else -(v @ v[q])
            rows = [i for i in range(300) if not kw.get("same") or i % 3 == q % 3]
            assert got[q] == set(sorted(rows, key=lambda i: (far[i], i))[:7])
