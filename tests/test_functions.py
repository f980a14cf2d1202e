import random

import pytest
from pyspark.sql import functions as F

from almagest.functions import allen, fuzzy, geo, text, ticks, vectors
from almagest.functions.calendars import UniformCalendar
from almagest.functions.ids import canonical_id, parse_id
from almagest.operators.anchors import resolve_anchored
from almagest.operators.extract import gazetteer_mentions, time_mentions
from almagest.operators.graph import closure, neighbours, order_levels
from almagest.operators.intervals import grid_overlap_join, interval_overlap_join


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_ticks(spark):
    L = lambda x: F.lit(x).cast("bigint")
    r = one(spark, ticks.offset(L(ticks.POS_INF), -5), ticks.offset(L(ticks.POS_INF - 3), 10), ticks.offset(L(ticks.NEG_INF + 3), -10), ticks.offset(L(5), 7), ticks.weekday(L(0)), ticks.weekday(L(-1)))
    assert tuple(r) == (ticks.POS_INF, ticks.POS_INF - 1, ticks.NEG_INF + 1, 12, 3, 2)


def test_fuzzy(spark):
    L = lambda x: F.lit(x).cast("bigint")
    day = fuzzy.within(L(0), L(86_400_000))
    r = one(spark, fuzzy.possibly_overlaps(day, L(1000), L(2000)), fuzzy.certainly_overlaps(day, L(1000), L(2000)), fuzzy.lies_within(day, L(0), L(86_400_000)), fuzzy.granularity(day), fuzzy.width(fuzzy.fuzzy(None if False else F.lit(None), F.lit(None), F.lit(None), F.lit(None))), fuzzy.hull(fuzzy.exact(L(0), L(5)), fuzzy.exact(L(3), L(9)))["le"], fuzzy.midpoint(fuzzy.exact(L(0), L(10))), fuzzy.shift(day, 5)["es"])
    assert tuple(r) == (True, False, True, "day", ticks.POS_INF, 9, 5, 5)


def test_allen_masks_against_enumeration(spark):
    rng, rows = random.Random(7), []
    for _ in range(60):
        def bounds():
            a = rng.randrange(5)
            b = a + rng.randrange(3)
            c = max(a, rng.randrange(6))
            return a, b, c, max(c + rng.randrange(3), b, a + 1)
        rows.append((*bounds(), *bounds()))
    df = spark.createDataFrame(rows, "a long, b long, c long, d long, e long, f long, g long, h long")
    x, y = (F.struct(F.col(p[0]).alias("es"), F.col(p[1]).alias("ls"), F.col(p[2]).alias("ee"), F.col(p[3]).alias("le")) for p in ("abcd", "efgh"))
    got = [r.m for r in df.select(allen.possible_mask(x, y).alias("m")).collect()]

    def of(s1, e1, s2, e2):
        at = {"s1": s1, "e1": e1, "s2": s2, "e2": e2}
        return next(i for i, o in enumerate(allen.ORDERS.values()) if all(len({at[k] for k in g.split()}) == 1 for g in o) and all(at[g.split()[0]] < at[h.split()[0]] for g, h in zip(o, o[1:], strict=False)))

    for (a, b, c, d, e, f, g, h), m in zip(rows, got, strict=True):
        want = {of(s1, e1, s2, e2) for s1 in range(a, b + 1) for e1 in range(c, d + 1) if s1 < e1 for s2 in range(e, f + 1) for e2 in range(g, h + 1) if s2 < e2}
        assert m == sum(1 << i for i in want)
    comp = allen.composition()
    assert comp["before", "before"] == 1 and comp["equals", "during"] == 1 << 4 and len(comp) == 169
    assert one(spark, allen.inverse(F.lit(1)), F.concat_ws(",", allen.names(F.lit(3))))[:] == (1 << 12, "before,meets")


def test_text(spark):
    r = one(spark, text.tokens(F.lit("Tokyo Tower")), text.tokens(F.lit("東京タワー")), text.tokens(F.lit("ＡＢＣ駅")), text.grams(F.lit("ab c")), text.normalize_label(F.lit("　Ａ \t b ")), text.page(F.lit("a日本".encode()), 0, 3), text.tokens(F.lit("")), text.normalize_label(F.lit(None).cast("string")))
    assert list(map(lambda x: x if isinstance(x, (str, type(None))) else bytes(x) if isinstance(x, (bytes, bytearray)) else list(x), r)) == [["tokyo", "tower"], ["東京", "京タ", "タワ", "ワー"], ["abc", "駅"], ["ab", "c"], "a b", b"a", [], None]


def test_ids_geo_vectors(spark):
    u = "01930954-B72A-7000-8B0F-618A12E550B8"
    d = one(spark, canonical_id(F.lit(u)), canonical_id(F.lit("res_" + u.replace("-", "").lower())), canonical_id(F.lit(" x:Y ")), F.round(geo.haversine_m(F.lit(139.7671), F.lit(35.6812), F.lit(135.5), F.lit(34.7)) / 1000))
    assert d[0] == d[1] == parse_id(u, "res") and d[2] == "x:Y" and 390 <= d[3] <= 410
    with pytest.raises(ValueError):
        parse_id("src_" + u, "res")
    rng = random.Random(3)
    vs = [(i, [rng.gauss(0, 1) for _ in range(32)]) for i in range(300)]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<float>").select("vec_id", vectors.unit(F.col("embedding")).cast("array<float>").alias("embedding"))
    q = [float(x) for x in df.filter("vec_id = 7").first().embedding]
    for f in (vectors.top_k, vectors.top_k_by_code):
        top = f(df, q, 3).collect()
        assert top[0].vec_id == 7 and top[0].score == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("levels", [(4, 16, 64), (1000,)])
def test_interval_join_against_brute_force(spark, levels):
    rng = random.Random(11)
    def rows(n):
        return [(i, s := rng.randrange(300), s + rng.choice([0, 1, 3, 10, 50, 290])) for i in range(n)] + [(n, None, 5), (n + 1, -10, 1000)]
    a, b = rows(80), rows(70)
    sch = "id long, s long, e long"
    got = [(r.l_id, r.r_id) for r in interval_overlap_join(spark.createDataFrame(a, sch), spark.createDataFrame(b, sch), levels=levels).collect()]
    want = [(x[0], y[0]) for x in a for y in b if None not in x + y and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2]]
    assert sorted(got) == sorted(want)


def test_grid_join(spark):
    rng = random.Random(12)
    rows = [(i, x := rng.uniform(-50, 50), y := rng.uniform(-50, 50), x + rng.choice([0, 3, 12]), y + rng.choice([0, 2, 9])) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, minx double, miny double, maxx double, maxy double")
    got = sorted((r.l_id, r.r_id) for r in grid_overlap_join(df, df, cell=5.0).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "b"), ("x", None), ("a", "b")], "node string, up string")
    got = {(r.node, r.above): r.depth for r in closure(e, reflexive=False).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("b", "c"): 1, ("b", "a"): 2, ("c", "a"): 1, ("c", "b"): 2, ("x", "b"): 1, ("x", "c"): 2, ("x", "a"): 3}
    assert {(r.node, r.above) for r in closure(e, reflexive=False, max_depth=1).collect()} == {k for k, d in got.items() if d == 1}
    g = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("d", "b", 3), ("c", "z", 4)], "src string, dst string, w long")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r.w: r.step for r in neighbours(g, start, depth=2).collect()} == {1: 1, 2: 2, 3: 2}
    assert {r.w for r in neighbours(g, start, depth=3, direction="out").collect()} == {1, 2, 4}
    assert {r.node: r.level for r in order_levels(g).collect()} == {"a": 0, "d": 0, "b": 1, "c": 2, "z": 3}


def test_anchored_times(spark):
    known = spark.createDataFrame([("A", 100, 110, 100, 110), ("B", 200, 210, 200, 210)], "node string, es long, ls long, ee long, le long")
    rel = spark.createDataFrame([("X", "A", None, -30, -30), ("Y", "A", "B", None, None), ("Z", "X", None, 5, 5), ("C1", "C2", None, 1, 1), ("C2", "C1", None, 1, 1), ("D", "C1", None, 1, 1), ("L", "nowhere", None, 1, 1), ("A", "B", None, 0, 0)], "node string, after string, before string, least_ms long, most_ms long")
    got = {r.node: (r.es, r.le, r.reason) for r in resolve_anchored(known, rel).collect()}
    assert got == {"A": (100, 110, None), "B": (200, 210, None), "X": (70, 80, None), "Z": (75, 85, None), "Y": (100, 210, None), "C1": (None, None, "cycle"), "C2": (None, None, "cycle"), "D": (None, None, "cycle"), "L": (None, None, "not_found")}
    assert {r.node: r.reason for r in resolve_anchored(known, rel, max_rounds=1).collect()}["Z"] == "depth"


def test_uniform_calendar(spark):
    c = UniformCalendar("aldmere", 1_200_000, 28, 4)
    t = c.start(F.lit(3), F.lit(2), F.lit(5))
    r = one(spark, c.fields(t), c.start(F.lit(1)), c.start(F.lit(1), F.lit(5)), c.fields(F.lit(-1).cast("bigint")))
    assert (r[0].year, r[0].month, r[0].day) == (3, 2, 5) and r[1] == 0 and r[2] is None and (r[3].year, r[3].month, r[3].day) == (0, 4, 28)


def test_extract(spark):
    docs = spark.createDataFrame([(1, "At New Tokyo in 1987 and Tokyo, not Tokyoite; 東京都"), (2, None), (3, ""), (4, "令和2年5月3日")], "doc_id long, text string")
    names = spark.createDataFrame([("p1", "Tokyo"), ("p2", " New Tokyo "), ("p3", "東京"), ("p4", "Tokyo"), ("p5", None), ("p6", "x")], "place_id string, label string")
    for size in (1, 100):
        got = sorted((r.place_id, r.span_start) for r in gazetteer_mentions(docs, names, dictionary=size).collect())
        assert got == [("p1", 25), ("p2", 3), ("p3", 46), ("p4", 25)]
    assert {(r.doc_id, r.raw) for r in time_mentions(docs).collect()} == {(1, "1987"), (4, "令和2年5月3日")}
    assert gazetteer_mentions(docs, names.filter("false")).count() == 0
