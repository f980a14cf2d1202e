"""Four-point fuzzy intervals: struct es, ls, ee, le of ticks; the start lies in [es, ls], the end in [ee, le], ends are exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almagest.functions.ticks import DAY, NEG_INF, POS_INF, infinite, offset


def fuzzy(es: Column, ls: Column, ee: Column, le: Column) -> Column:
    """Normalised: es <= ls <= le and es <= ee <= le; null ends are open."""
    es, le = F.coalesce(es, F.lit(NEG_INF)).cast("bigint"), F.coalesce(le, F.lit(POS_INF)).cast("bigint")
    le = F.greatest(es, le)
    inside = lambda x, d: F.least(le, F.greatest(es, F.coalesce(x, d).cast("bigint")))
    return F.struct(es.alias("es"), inside(ls, es).alias("ls"), inside(ee, le).alias("ee"), le.alias("le"))


def exact(start: Column, end: Column) -> Column:
    return fuzzy(start, start, end, end)


def within(start: Column, end: Column) -> Column:
    """Some moment or stretch inside [start, end)."""
    return fuzzy(start, end, start, end)


def possibly_overlaps(r: Column, qs: Column, qe: Column) -> Column:
    return (r["es"] < qe) & (r["le"] > qs)


def certainly_overlaps(r: Column, qs: Column, qe: Column) -> Column:
    return (r["ls"] < qe) & (r["ee"] > qs)


def lies_within(r: Column, qs: Column, qe: Column) -> Column:
    return (r["es"] >= qs) & (r["le"] <= qe)


def certainly_before(a: Column, b: Column) -> Column:
    return a["le"] <= b["es"]


def hull(a: Column, b: Column) -> Column:
    return fuzzy(F.least(a["es"], b["es"]), F.least(a["ls"], b["ls"]), F.greatest(a["ee"], b["ee"]), F.greatest(a["le"], b["le"]))


def shift(r: Column, by: Column | int) -> Column:
    return F.struct(*[offset(r[c], by).alias(c) for c in ("es", "ls", "ee", "le")])


def widen(r: Column, before: int, after: int) -> Column:
    return fuzzy(offset(r["es"], -before), offset(r["ls"], after), offset(r["ee"], -before), offset(r["le"], after))


def width(r: Column) -> Column:
    return F.when(infinite(r["es"]) | infinite(r["le"]), F.lit(POS_INF)).otherwise(F.coalesce(F.try_subtract(r["le"], r["es"]), F.lit(POS_INF)))


def midpoint(r: Column) -> Column:
    """Null for open intervals."""
    return F.when(~infinite(r["es"]) & ~infinite(r["le"]), F.floor(r["es"] / 2 + r["le"] / 2).cast("bigint"))


# The widest milliseconds of each granularity.
GRANULARITIES = [("second", 1000), ("minute", 60_000), ("hour", 3_600_000), ("part_of_day", 6 * 3_600_000), ("day", DAY), ("week", 7 * DAY), ("month", 31 * DAY), ("season", 92 * DAY), ("year", 366 * DAY), ("decade", 3653 * DAY)]


def granularity(r: Column) -> Column:
    w = width(r)
    out = F.lit("century")
    for name, most in reversed(GRANULARITIES):
        out = F.when(w <= most, name).otherwise(out)
    return F.when(w == POS_INF, "unbounded").otherwise(out)
