"""Registered queries take all rows of their tables: brute force over small fixtures."""

import random
from datetime import date, datetime, timedelta

import numpy as np

from almagest.catalog import QUERIES


def run(spark, path, name, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{t}.parquet")
    return QUERIES[name](spark, str(path)).collect()


def test_vector_topk_by_code_recall(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 16))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    got = run(spark, tmp_path, "vector_topk_by_code", embeddings=([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>"))
    assert {r.query_id for r in got} == set(range(0, 1500, 100)) and len(got) == 150
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-(v @ v[q]), kind="stable")[:10].tolist())) for q in range(0, 1500, 100))
    assert hits / 150 >= 0.9


def test_lookup_redirect_follows_all_merges(spark, tmp_path):
    rows = [("a", "b", 1, 1), ("b", "d", 2, 2), ("d", "c", 3, 3), ("c", "c", 0, 0), ("x", "y", 1, 4), ("y", "x", 1, 5), ("a", "z", 9, 6), (None, "q", 1, 7)]
    got = {r.id: r.final_id for r in run(spark, tmp_path, "lookup_redirect", merges=(rows, "from_id string, into_id string, requested_at long, merge_id long"))}
    assert got == {"a": "c", "b": "c", "d": "c", "x": "x", "y": "y"}


def test_history_takes_all_events(spark, tmp_path):
    events = ([(1, i, datetime(2024, 1, 1, 0, i % 60), "x") for i in (3, 7, 8, 9, 19)], "user_id long, event_id long, ts timestamp, event_type string")
    (c,) = run(spark, tmp_path, "history_conversations", events=events)
    assert (c.events, c.first_sequence, c.last_sequence, c.missing) == (5, 3, 19, 12)
    assert {(r.after, r.missing_from, r.missing_to) for r in QUERIES["history_gaps"](spark, str(tmp_path)).collect()} == {(3, 4, 6), (9, 10, 18)}


def test_recurrence_of_long_shipments(spark, tmp_path):
    lines = [(1, date(2020, 1, 1)), (1, date(2020, 12, 31)), (2, date(2020, 1, 3))]
    orders = ([(1, 1, date(2020, 1, 1)), (2, 1, date(2020, 1, 1))], "o_orderkey long, o_custkey long, o_orderdate date")
    got = {r.k: r.n for r in run(spark, tmp_path, "recurrence_occurrences", orders=orders, lineitem=(lines, "l_orderkey long, l_shipdate date"))}
    assert got == {1: 52, 2: 1}


def test_grid_join_with_wide_boxes(spark, tmp_path):
    rng = random.Random(6)
    boxes = [(f"b{i}", (x := rng.uniform(-180, 170)), (y := rng.uniform(-90, 80)), min(180.0, x + w), min(90.0, y + rng.choice([0.5, 3, 70]))) for i, w in enumerate([0.5, 4, 5, 30, 180, 360] * 5)]
    points = [(f"p{i}", (x := rng.uniform(-180, 180)), (y := rng.uniform(-90, 90)), x, y) for i in range(80)]
    facts = [(i, 1, 1, ("wgs84", *box)) for i, *box in boxes + points]
    got = [(r.l_id, r.r_id) for r in run(spark, tmp_path, "grid_spatial_join", resource_facts=(facts, "canonical_id string, known_from long, source_revision long, placement struct<frame:string,minx:double,miny:double,maxx:double,maxy:double>"))]
    assert sorted(got) == sorted((b[0], p[0]) for b in boxes for p in points if b[1] <= p[1] <= b[3] and b[2] <= p[2] <= b[4])


def test_label_tokens_of_all_scripts(spark, tmp_path):
    rows = [(i, x, [], [], [], None, None) for i, x in (("a", "Old Mill 2"), ("b", "東京駅"), ("c", "Müller Haus"), ("d", None))]
    got = {r.resource_id: r.words for r in run(spark, tmp_path, "label_tokens", resources=(rows, "resource_id string, label string, types array<string>, aliases array<string>, external_ids array<string>, visibility string, license string"))}
    assert got["a"] == "2 mill old" and got["b"] == "京駅 東京" and "haus" in got["c"].split() and "d" not in got


def test_interval_overlap_join_takes_all_rows(spark, tmp_path):
    rng = random.Random(4)
    day = lambda n: date(2020, 1, 1) + timedelta(n)
    orders = [(i, 1, day(rng.randrange(200)), f"{rng.randrange(1, 6)}-X") for i in range(80)]
    lines = [(k, day(rng.randrange(200))) for k in range(60) for _ in range(rng.randrange(1, 4))]
    got = {r.r_k: r.n for r in run(spark, tmp_path, "interval_overlap_join", orders=(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string"), lineitem=(lines, "l_orderkey long, l_shipdate date"))}
    spans = {k: [t for i, t in lines if i == k] for k, _ in lines}
    want = {k: sum(min(t) <= o[2] <= max(t) for o in orders) for k, t in spans.items()}
    assert got == {k: n for k, n in want.items() if n}
