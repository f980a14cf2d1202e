import math
import random

import numpy as np
import pytest

from almagest.operators.spatial import Splits, near_pairs, regions_around


def metres(a, b):
    p, q = ((math.cos(math.radians(y)) * math.cos(math.radians(x)), math.cos(math.radians(y)) * math.sin(math.radians(x)), math.sin(math.radians(y))) for x, y in (a, b))
    return 2 * math.asin(min(1, math.dist(p, q) / 2)) * 6371008.8


@pytest.mark.parametrize("leaf", [20, 100_000])
def test_near_pairs(spark, leaf):
    rng = random.Random(1)
    pts = [(f"p{i}", rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(80)]
    pts += [(f"c{i}", 179.99 + rng.uniform(-0.02, 0.02), 10 + rng.uniform(-0.02, 0.02)) for i in range(60)]
    pts += [("west", -179.999, 10.0), ("east", 179.999, 10.0), ("turn", 180.001, 10.0), ("n1", 0.0, 89.9999), ("n2", 180.0, 89.9999), ("same", 179.999, 10.0), ("same", 179.999, 10.0)]
    dirty = [*pts, (None, 1.0, 1.0), ("nolon", None, 1.0), ("nolat", 1.0, None), ("bad", 1.0, 91.0)]
    got = {(r.id_a, r.id_b) for r in near_pairs(spark.createDataFrame(dirty, "id string, lon double, lat double"), within_m=900.0, leaf_points=leaf).collect()}
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and metres(a[1:], b[1:]) <= 900.0}
    assert got == want and ("east", "west") in want and ("n1", "n2") in want


def test_one_place(spark):
    rows = [(f"{i:03d}", 5.0, 5.0) for i in range(100)]
    assert near_pairs(spark.createDataFrame(rows, "id string, lon double, lat double"), within_m=1.0).count() == 4950


def test_one_place_in_blocks(spark):
    rows = [(f"{i:03d}", 5.0, 5.0) for i in range(100)] + [(f"x{i}", 5.0 + i / 7, -5.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, lon double, lat double")
    assert near_pairs(df, within_m=1.0, leaf_points=10).count() == 4950
    box = spark.createDataFrame([("b", 4.0, 4.0, 6.0, 6.0), ("all", -10.0, -10.0, 50.0, 50.0)], "id string, minx double, miny double, maxx double, maxy double")
    assert regions_around(df, box, leaf_points=10).count() == 260


def test_points_beside_a_crowded_place_are_still_split():
    rng = np.random.default_rng(2)
    p = np.concatenate([np.tile([[-1.0, 0.2, 0.1]], (6000, 1)), rng.uniform(-0.9, 1, (4000, 3))])
    s = Splits.fit(p, 10)
    row, leaf = s.place(p, p)
    sizes = sorted(np.bincount(leaf, minlength=len(s.leaf)))
    assert len(row) == len(p) and sizes[-1] == 6000 and sizes[-2] < 1600


def test_polygons(spark):
    rng = random.Random(9)
    rings = {}
    for k in range(12):
        x, y, n = rng.uniform(-170, 170), rng.uniform(-70, 70), rng.randrange(3, 9)
        rings[f"r{k}"] = [(x + (r := rng.uniform(2, 15)) * math.cos(6.283 * i / n), y + r * math.sin(6.283 * i / n)) for i in range(n)]
    pts = [(f"p{i}", rng.uniform(-180, 180), rng.uniform(-85, 85)) for i in range(200)]
    pts += [(f"q{i}", rings[f"r{i % 12}"][0][0] + rng.uniform(-9, 9), rings[f"r{i % 12}"][0][1] + rng.uniform(-9, 9)) for i in range(400)]

    def inside(x, y, ring):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (x1 > x) != (x2 > x) and y > y1 + (y2 - y1) * (x - x1) / (x2 - x1):
                odd = not odd
        return odd

    want = {(k, i) for i, x, y in pts for k, r in rings.items() if any(inside(x + t, y, r) for t in (-360, 0, 360))}
    rows = [(k, min(x for x, _ in r), min(y for _, y in r), max(x for x, _ in r), max(y for _, y in r), r) for k, r in rings.items()] + [("box", 0.0, 0.0, 9.0, 9.0, None)]
    regions = spark.createDataFrame(rows, "id string, minx double, miny double, maxx double, maxy double, ring array<struct<lon:double,lat:double>>")
    for leaf in (50, 1000):
        got = {(r.region_id, r.point_id) for r in regions_around(spark.createDataFrame(pts, "id string, lon double, lat double"), regions, leaf_points=leaf).collect()}
        assert {x for x in got if x[0] != "box"} == want and len(want) > 50
    square = spark.createDataFrame([("s", 0.0, 0.0, 2.0, 2.0, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])], regions.schema)
    edge = spark.createDataFrame([("corner", 0.0, 0.0), ("side", 2.0, 1.0), ("top", 1.0, 2.0), ("in", 1.0, 1.0), ("out", 2.1, 1.0)], "id string, lon double, lat double")
    assert {r.point_id for r in regions_around(edge, square).collect()} == {"corner", "side", "top", "in"}


def test_boxes(spark):
    pts = spark.createDataFrame([("a", 0.0, 0.0), ("b", 10.0, 10.0), ("d", -179.5, 0.0), ("e", 180.5, 0.0), (None, 1.0, 1.0)], "id string, lon double, lat double")
    box = spark.createDataFrame([("u", 0.0, 0.0, 10.0, 10.0), ("line", 179.0, -1.0, 181.0, 1.0), ("flat", 0.0, 0.0, 0.0, 5.0), ("null", None, 0.0, 1.0, 1.0), ("world", -180.0, -90.0, 180.0, 90.0), ("u", 0.0, 0.0, 10.0, 10.0)], "id string, minx double, miny double, maxx double, maxy double")
    for leaf in (1, 1000):
        got = {(r.region_id, r.point_id) for r in regions_around(pts, box, leaf_points=leaf).collect()}
        assert got == {("u", "a"), ("u", "b"), ("line", "d"), ("line", "e"), *(("world", x) for x in "abde")}


def test_empty(spark):
    e = spark.createDataFrame([], "id string, lon double, lat double")
    assert near_pairs(e, within_m=5.0).count() == 0
    assert regions_around(e, spark.createDataFrame([], "id string, minx double, miny double, maxx double, maxy double")).count() == 0
