"""Points near other points, and regions around points.

Points become unit vectors. A k-d tree of split planes, fitted on a bounded sample, cuts space into leaves of about
equal numbers of points; a point is copied into the leaves its halo touches, so that each pair within the distance
meets in the home leaf of one end. Inside a leaf a local k-d tree finds pairs by chord length. Regions, boxes or
polygons, go to every leaf they touch; there they descend a local k-d tree until they hold all its points, none, or
have few left, which a sweep over the polygon's edges in order of longitude decides.

Points that no plane can part, as they are one place, still make no large task: a leaf with too many of them is dealt
out in pairs of blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.plans import cut, parts_for, small

EARTH_KM = 6371.0088  # mean radius of the sphere
SAMPLE = 200_000  # at most about so many points are used to place the split planes


@dataclass
class Splits:
    """Split planes: node i cuts dimension dim[i] at cut[i]; dim -1 marks a leaf, whose number is leaf[i]."""

    dim: list[int]
    cut: list[float]
    kids: list[tuple[int, int]]
    leaf: list[int]

    @classmethod
    def fit(cls, points: np.ndarray, leaves: int) -> Splits:
        s = cls([], [], [], [])
        numbers = iter(range(1 << 30))

        def grow(p: np.ndarray, n: int) -> int:
            i = len(s.dim)
            s.dim.append(-1), s.cut.append(0.0), s.kids.append((-1, -1)), s.leaf.append(-1)
            if n > 1 and len(p) > 1:
                for d in np.argsort(p.min(0) - p.max(0), kind="stable"):  # the widest side that can be cut
                    order = np.sort(p[:, d])
                    at = order[len(p) * (n // 2) // n]
                    if at == order[0]:  # more than that are at its least value: these on one side
                        above = np.searchsorted(order, at, "right")
                        if above == len(order):
                            continue
                        at = order[above]
                    low = p[:, d] < at
                    share = min(n - 1, max(1, round(n * low.mean())))
                    s.dim[i], s.cut[i] = int(d), float(at)
                    a = grow(p[low], share)
                    s.kids[i] = (a, grow(p[~low], n - share))
                    return i
            s.leaf[i] = next(numbers)
            return i

        grow(points, leaves)
        return s

    def place(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that the closed boxes lo..hi touch."""
        rows, leaves, todo = [], [], [(0, np.arange(len(lo)))]
        while todo:
            i, at = todo.pop()
            if not len(at):
                continue
            if self.dim[i] < 0:
                rows.append(at), leaves.append(np.full(len(at), self.leaf[i]))
                continue
            a, b = self.kids[i]
            todo.append((a, at[lo[at, self.dim[i]] < self.cut[i]]))
            todo.append((b, at[hi[at, self.dim[i]] >= self.cut[i]]))
        none = np.array([], dtype=int)
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (none, none)


def _close(p: np.ndarray, home: np.ndarray, chord: float, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j at most ``chord`` apart, at least one at home (and of two blocks, if given): a local k-d tree cut along its widest side, the far half with a margin."""
    left, right = [], []
    todo = [(np.arange(len(p)), np.arange(len(p)))]
    # a pair (A, B) of index sets; equal sets mean all pairs inside
    while todo:
        a, b = todo.pop()
        if not len(a) or not len(b):
            continue
        same = a is b
        if len(a) * len(b) > 4096:
            box = p[a]
            d = int(np.argmax(box.max(0) - box.min(0)))
            order = a[np.argsort(p[a, d], kind="stable")]
            lo, hi = order[: len(order) // 2], order[len(order) // 2 :]
            if not len(lo) or p[hi[-1], d] - p[lo[0], d] == 0:  # all in one place: by blocks
                for i in range(0, len(a), 512):
                    for j in range(i if same else 0, len(b), 512):
                        _pairs(p, a[i : i + 512], b[j : j + 512], same and i == j, home, chord, block, left, right)
                continue
            edge = p[hi[0], d]
            if same:
                todo.append((lo, lo))
                todo.append((hi, hi))
                todo.append((lo[p[lo, d] >= edge - chord], hi[p[hi, d] <= p[lo[-1], d] + chord]))
            else:
                todo.append((lo, b[p[b, d] <= p[lo[-1], d] + chord]))
                todo.append((hi, b[p[b, d] >= edge - chord]))
            continue
        _pairs(p, a, b, same, home, chord, block, left, right)
    none = np.array([], dtype=int)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _pairs(p, a, b, same, home, chord, block, left, right) -> None:  # noqa: ANN001
    d2 = ((p[a][:, None, :] - p[b][None, :, :]) ** 2).sum(2)
    ok = (d2 <= chord * chord) & (home[a][:, None] | home[b][None, :])
    if block is not None:
        ok &= block[a][:, None] != block[b][None, :]
    if same:
        ok &= np.triu(np.ones(ok.shape, dtype=bool), 1)
    i, j = np.nonzero(ok)
    if len(i):
        left.append(a[i]), right.append(b[j])


def _unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    lam, phi = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)], 1)


def _blocks(placed: DataFrame, leaf_points: int) -> DataFrame:
    """(leaf, k) of the leaves with more than twice ``leaf_points`` rows: the number of blocks to deal them out in. A row per such leaf."""
    return placed.groupBy("leaf").count().filter(F.col("count") > 2 * leaf_points).select("leaf", F.ceil(F.col("count") / leaf_points).cast("int").alias("k"))


def _sample(points: DataFrame, n: int) -> np.ndarray:
    share = min(1.0, SAMPLE / max(1, n))
    got = (points if share == 1.0 else points.sample(share * 0.9, seed=7)).select("lon", "lat").limit(SAMPLE).toPandas()
    return got[["lon", "lat"]].to_numpy(float)


def near_pairs(points: DataFrame, *, within_m: float, leaf_points: int = 200_000) -> DataFrame:
    """(id_a, id_b) with id_a < id_b of different ids whose points lie at most ``within_m`` metres apart on the sphere.

    ``points`` has id string, lon, lat in degrees; longitudes that differ by 360 are equal. Rows with a null, or with a
    latitude beyond 90 degrees, take no part; repeated rows count once; an id with several points is near where any of
    them is. Empty input gives an empty result; other columns are ignored.
    """
    p = points.select(F.col("id").cast("string").alias("id"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).filter("id is not null and lon is not null and abs(lat) <= 90").distinct()
    n = p.count()
    chord = 2 * math.sin(min(math.pi, within_m / (EARTH_KM * 1000)) / 2) * (1 + 1e-12) + 1e-15
    leaves = parts_for(n, leaf_points)
    splits = Splits.fit(_unit(*_sample(p, n).T), leaves) if n else Splits([-1], [0.0], [(-1, -1)], [0])

    def place(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            v = _unit(pdf.lon.to_numpy(float), pdf.lat.to_numpy(float))
            row, leaf = splits.place(v - chord, v + chord)
            hrow, hleaf = splits.place(v, v)
            home = np.empty(len(v), dtype=int)
            home[hrow] = hleaf
            yield pd.DataFrame({"id": pdf.id.to_numpy()[row], "x": v[row, 0], "y": v[row, 1], "z": v[row, 2], "leaf": leaf, "home": home[row] == leaf})

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf.id.to_numpy()
        block = pdf.block.to_numpy() if len(pdf) and pdf.i.iloc[0] != pdf.j.iloc[0] else None
        i, j = _close(pdf[["x", "y", "z"]].to_numpy(), pdf.home.to_numpy(bool), chord, block)
        a, b = ids[i], ids[j]
        swap = a > b if len(a) else np.array([], dtype=bool)
        return pd.DataFrame({"id_a": np.where(swap, b, a), "id_b": np.where(swap, a, b)})

    placed = p.mapInPandas(place, "id string, x double, y double, z double, leaf int, home boolean")
    if len(splits.leaf) == 1:
        dealt = placed.repartition(1).withColumns({c: F.lit(0) for c in ("block", "i", "j")})
    else:
        placed = cut(placed)
        # a leaf in k blocks: each point goes to the k pairs of blocks that its own is in
        dealt = placed.join(small(_blocks(placed, leaf_points)), "leaf", "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id", "x"), F.col("k")).cast("int"))
        dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumns({"i": F.least("_o", "block"), "j": F.greatest("_o", "block")}).drop("_o", "k")
    return dealt.groupBy("leaf", "i", "j").applyInPandas(inside, "id_a string, id_b string").filter("id_a <> id_b").distinct()


def _in_ring(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Whether points, sorted by x, lie in a polygon or on its edge: the edges are swept by x, each turning the points above it inside out."""
    inside, on = np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=bool)
    ends = np.stack([ring, np.roll(ring, -1, 0)], 1)
    ends = np.take_along_axis(ends, np.argsort(ends[:, :, 0], axis=1, kind="stable")[:, :, None], 1)
    for (x1, y1), (x2, y2) in ends[np.argsort(ends[:, 0, 0])]:
        i, j, k = np.searchsorted(x, x1, "left"), np.searchsorted(x, x2, "left"), np.searchsorted(x, x2, "right")
        if x2 > x1:
            at = y1 + (y2 - y1) * ((x[i:k] - x1) / (x2 - x1))
            inside[i:j] ^= y[i:j] > at[: j - i]
            on[i:k] |= np.abs(y[i:k] - at) <= 1e-12
        else:
            on[i:k] |= (y[i:k] >= min(y1, y2)) & (y[i:k] <= max(y1, y2))
    return inside | on


def _contained(x: np.ndarray, y: np.ndarray, lo: np.ndarray, hi: np.ndarray, rings: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """(region, point) index pairs of the points inside regions, edges included: regions descend a local k-d tree of the points."""
    p, region, point = np.stack([x, y], 1), [], []
    shaped = np.array([r is not None for r in rings], dtype=bool)
    todo = [(np.arange(len(x)), np.arange(len(lo)))]
    while todo:
        pts, regs = todo.pop()
        if not len(pts) or not len(regs):
            continue
        low, high = p[pts].min(0), p[pts].max(0)
        regs = regs[(lo[regs] <= high).all(1) & (hi[regs] >= low).all(1)]
        whole = (lo[regs] <= low).all(1) & (hi[regs] >= high).all(1) & ~shaped[regs]
        region.append(np.repeat(regs[whole], len(pts))), point.append(np.tile(pts, whole.sum()))
        regs = regs[~whole]
        if len(pts) > 64 and (high > low).any():
            d = int(np.argmax(high - low))
            order = pts[np.argsort(p[pts, d], kind="stable")]
            todo += [(order[: len(order) // 2], regs), (order[len(order) // 2 :], regs)]
            continue
        pts = pts[np.argsort(x[pts], kind="stable")]
        for at in range(0, len(regs), 4096):
            some = regs[at : at + 4096]
            hit = (p[pts][None] >= lo[some][:, None]).all(2) & (p[pts][None] <= hi[some][:, None]).all(2)
            for r in np.nonzero(hit.any(1) & shaped[some])[0]:
                hit[r, hit[r]] = _in_ring(x[pts[hit[r]]], y[pts[hit[r]]], rings[some[r]])
            r, q = np.nonzero(hit)
            region.append(some[r]), point.append(pts[q])
    none = np.array([], dtype=int)
    return (np.concatenate(region), np.concatenate(point)) if region else (none, none)


def regions_around(points: DataFrame, regions: DataFrame, *, leaf_points: int = 200_000) -> DataFrame:
    """(region_id, point_id): the regions that contain each point, edges included.

    ``points`` has id, lon, lat; ``regions`` has id, minx, miny, maxx, maxy with min < max, and may have ring, an
    array<struct<lon, lat>> of a polygon's corners in order (null or fewer than three: the box is the region).
    Longitudes that differ by 360 are equal, so a region may cross the date line. Rows with a null and regions without
    an extent take no part; repeated rows count once; a pair of equal ids is left out. Empty input gives an empty
    result; other columns are ignored.
    """
    norm = F.col("lon").cast("double")
    norm = norm - F.floor((norm + 180) / 360) * 360
    p = points.select(F.col("id").cast("string").alias("id"), norm.alias("lon"), F.col("lat").cast("double").alias("lat")).filter("id is not null and lon is not null and lat is not null").distinct()
    ring = F.col("ring") if "ring" in regions.columns else F.lit(None)
    b = regions.select(F.col("id").cast("string").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("minx", "miny", "maxx", "maxy")], ring.cast("array<struct<lon:double,lat:double>>").alias("ring")).filter("id is not null and minx < maxx and miny < maxy").distinct()
    turns = F.sequence(F.floor((-180 - F.col("maxx")) / 360), F.ceil((180 - F.col("minx")) / 360))
    b = b.withColumn("_t", F.explode(F.transform(turns, lambda k: k * 360.0))).select("id", (F.col("minx") + F.col("_t")).alias("minx"), "miny", (F.col("maxx") + F.col("_t")).alias("maxx"), "maxy", F.transform("ring", lambda c: F.struct((c["lon"] + F.col("_t")).alias("lon"), c["lat"].alias("lat"))).alias("ring"))
    b = b.filter("maxx >= -180.000001 and minx <= 180.000001")
    n = p.count()
    splits = Splits.fit(_sample(p, n), parts_for(n, leaf_points)) if n else Splits([-1], [0.0], [(-1, -1)], [0])
    eps = 1e-9  # a turn by 360 degrees rounds the last digits

    def place(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            row, leaf = splits.place(pdf[["minx", "miny"]].to_numpy(float) - eps, pdf[["maxx", "maxy"]].to_numpy(float) + eps)
            yield pdf.iloc[row].assign(leaf=leaf)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pts, own = pdf[~pdf.region], pdf[pdf.region]
        rings = [np.array([(c["lon"], c["lat"]) for c in r], dtype=float) if r is not None and len(r) > 2 else None for r in own.ring]
        r, q = _contained(pts.minx.to_numpy(), pts.miny.to_numpy(), own[["minx", "miny"]].to_numpy() - eps, own[["maxx", "maxy"]].to_numpy() + eps, rings)
        return pd.DataFrame({"region_id": own.id.to_numpy(object)[r], "point_id": pts.id.to_numpy(object)[q]}, dtype=object)

    box = "minx double, miny double, maxx double, maxy double, ring array<struct<lon:double,lat:double>>"
    every = b.select("id", F.lit(True).alias("region"), "minx", "miny", "maxx", "maxy", "ring").unionByName(p.select("id", F.lit(False).alias("region"), F.col("lon").alias("minx"), F.col("lat").alias("miny"), F.col("lon").alias("maxx"), F.col("lat").alias("maxy"), F.lit(None).cast("array<struct<lon:double,lat:double>>").alias("ring")))
    placed = every.mapInPandas(place, f"id string, region boolean, {box}, leaf int")
    if len(splits.leaf) == 1:
        dealt = placed.withColumn("block", F.lit(0))
    else:  # the points of a leaf that is one place are dealt out in blocks, its regions go to all of them
        placed = cut(placed)
        dealt = placed.join(small(_blocks(placed.filter("not region"), leaf_points)), "leaf", "left").withColumn("k", F.coalesce("k", F.lit(1)))
        dealt = dealt.withColumn("block", F.explode(F.when(F.col("region"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))))).drop("k")
    return dealt.groupBy("leaf", "block").applyInPandas(inside, "region_id string, point_id string").filter("region_id <> point_id").distinct()


def neighbours_and_regions(facts: DataFrame, *, within_m: float = 250.0, frame: str = "wgs84") -> DataFrame:
    """(id_a, id_b), the smaller first: (a) near points of different resources, (b) boxes around points of resources that name no place in any row.

    ``facts`` has canonical_id, placement (frame, minx, miny, maxx, maxy) and places. Placements that are null, partial
    or in another frame are left out.
    """
    rows = facts.select(F.col("canonical_id").alias("id"), "placement.*", "places").filter("id is not null")
    here = rows.filter(F.col("frame") == frame)
    point = (F.col("minx") == F.col("maxx")) & (F.col("miny") == F.col("maxy"))
    points = here.filter(point).select("id", F.col("minx").alias("lon"), F.col("miny").alias("lat"))
    named = rows.filter(F.size(F.filter(F.coalesce("places", F.array()), lambda x: x.isNotNull())) > 0).select("id").distinct()
    inside = regions_around(points.join(named, "id", "left_anti"), here.filter("minx < maxx and miny < maxy"))
    near = near_pairs(points, within_m=within_m)
    both = near.unionByName(inside.select(F.least("region_id", "point_id").alias("id_a"), F.greatest("region_id", "point_id").alias("id_b")))
    return both.distinct()
