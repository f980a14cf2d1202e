"""Distances on the sphere and in planes, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def near_box(lon: float, lat: float, radius_m: float) -> tuple[float, float, float, float]:
    """A box around all points within the radius, for a cheap test before the exact one."""
    import math

    dlat = radius_m / 111_320
    dlon = dlat / max(abs(math.cos(math.radians(lat))), 0.01)
    return lon - dlon, lat - dlat, lon + dlon, lat + dlat


def boxes_meet(p: Column, minx: float, miny: float, maxx: float, maxy: float) -> Column:
    return (p["minx"] <= maxx) & (p["maxx"] >= minx) & (p["miny"] <= maxy) & (p["maxy"] >= miny)


def affine(x: Column, y: Column, z: Column, m: list[float]) -> list[Column]:
    """A point moved into the parent frame by a 3x4 matrix, given row by row."""
    return [x * m[4 * i] + y * m[4 * i + 1] + z * m[4 * i + 2] + F.lit(m[4 * i + 3]) for i in range(3)]
