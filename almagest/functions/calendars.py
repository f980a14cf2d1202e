"""Invented calendars of even days, months and years on an axis of their own; times on different axes do not compare."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UniformCalendar:
    axis: str
    day_ms: int
    days_per_month: int
    months_per_year: int
    days_per_week: int = 7

    def __post_init__(self) -> None:
        if min(self.day_ms, self.days_per_month, self.months_per_year, self.days_per_week) <= 0:
            raise ValueError("units must be positive")

    def start(self, year: Column, month: Column | None = None, day: Column | None = None) -> Column:
        """Tick of the start of a year, month or day (all counted from 1; year 0 and below lie before)."""
        m = F.coalesce(month, F.lit(1)) if month is not None else F.lit(1)
        d = F.coalesce(day, F.lit(1)) if day is not None else F.lit(1)
        ok = m.between(1, self.months_per_year) & d.between(1, self.days_per_month)
        days = ((year - 1) * self.months_per_year + (m - 1)) * self.days_per_month + (d - 1)
        return F.when(ok, days.cast("bigint") * self.day_ms)

    def fields(self, tick: Column) -> Column:
        """struct year, month, day, weekday of a tick."""
        n = F.floor(tick / self.day_ms)
        per_year = self.days_per_month * self.months_per_year
        in_year = F.pmod(n, F.lit(per_year))
        return F.struct((F.floor(n / per_year) + 1).cast("bigint").alias("year"), (F.floor(in_year / self.days_per_month) + 1).cast("int").alias("month"), (F.pmod(in_year, F.lit(self.days_per_month)) + 1).cast("int").alias("day"), F.pmod(n, F.lit(self.days_per_week)).cast("int").alias("weekday"))
