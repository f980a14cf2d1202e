"""Ticks: milliseconds since 1970-01-01Z as bigints, with the two ends of the range standing for minus and plus infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF, POS_INF = -(2**63), 2**63 - 1
DAY = 86_400_000


def tick(ts: Column) -> Column:
    """Milliseconds, rounded down, of a timestamp with or without zone (the latter as UTC)."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / 1000).cast("bigint")


def infinite(t: Column) -> Column:
    return (t == NEG_INF) | (t == POS_INF)


def offset(t: Column, by: Column | int) -> Column:
    """t + by; infinities stay, results beyond the range stop one inside it."""
    by = by if isinstance(by, Column) else F.lit(by).cast("bigint")
    s = F.try_add(t, by)
    return F.when(infinite(t), t).otherwise(F.greatest(F.lit(NEG_INF + 1), F.least(F.lit(POS_INF - 1), F.coalesce(s, F.when(by > 0, F.lit(POS_INF - 1)).otherwise(F.lit(NEG_INF + 1))))))


def weekday(t: Column) -> Column:
    """0 Monday to 6 Sunday of a finite tick."""
    return F.pmod(F.floor(t / DAY) + 3, F.lit(7)).cast("int")
