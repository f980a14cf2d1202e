"""Observations, positions along trajectories, recurring events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almagest.functions.ticks import DAY


def observations_between(obs: DataFrame, *, start_us: int, end_us: int, metric: str | None = None, as_known_at_us: int | None = None) -> DataFrame:
    """Rows with observed_at in [start, end), each record once; as known: recorded by then (observed by then where that is null)."""
    at = F.unix_micros("observed_at")
    out = obs.filter((at >= start_us) & (at < end_us))
    if metric is not None:
        out = out.filter(F.col("metric") == metric)
    if as_known_at_us is not None:
        out = out.filter(F.coalesce(F.unix_micros("recorded_at"), at) <= as_known_at_us)
    return out.distinct()


def latest(obs: DataFrame, *, at_us: int) -> DataFrame:
    """(target, metric, obs_id, value): the last observation at or before a moment; ties by id."""
    seen = obs.filter((F.unix_micros("observed_at") <= at_us) & F.col("target").isNotNull())
    best = seen.groupBy("target", "metric").agg(F.max(F.struct("observed_at", "obs_id", "value")).alias("b"))
    return best.select("target", "metric", "b.obs_id", "b.value")


def position_at(samples: DataFrame, at: int | Column, *, how: str = "linear") -> DataFrame:
    """(target, x) of trajectories given as samples target, t (bigint), x at one moment, for targets whose samples span it.

    linear interpolates between the samples around, step keeps the last one, none needs an exact sample.
    """
    at = at if isinstance(at, Column) else F.lit(at)
    g = samples.groupBy("target").agg(
        F.max(F.when(F.col("t") <= at, F.struct("t", "x"))).alias("a"), F.min(F.when(F.col("t") >= at, F.struct("t", "x"))).alias("b"),
    ).filter("a is not null and b is not null")
    same = F.col("a.t") == F.col("b.t")
    if how == "none":
        return g.filter(same).select("target", F.col("a.x").alias("x"))
    if how == "step":
        return g.select("target", F.col("a.x").alias("x"))
    part = (at - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    return g.select("target", F.when(same, F.col("a.x")).otherwise(F.col("a.x") + (F.col("b.x") - F.col("a.x")) * part).alias("x"))


def weekly_occurrences(start: Column, end: Column, weekday: int, clock_ms: int, offset_ms: int = 0) -> Column:
    """Ticks of ``weekday`` (0 Monday) at the clock (beyond 24 h on into the next day) in [start, end), zone given by its offset."""
    first = F.floor((start + offset_ms - clock_ms) / DAY)
    last = F.floor((end + offset_ms - clock_ms) / DAY) + 1
    days = F.filter(F.sequence(first, last), lambda d: F.pmod(d + 3, F.lit(7)) == weekday)
    return F.filter(F.transform(days, lambda d: d * DAY + clock_ms - offset_ms), lambda t: (t >= start) & (t < end))


def gaps(rows: DataFrame, *, key: str, seq: str) -> DataFrame:
    """(key, after, missing_from, missing_to): stretches of sequence numbers that are missing between two present ones."""
    nxt = F.lead(seq).over(W.partitionBy(key).orderBy(seq))
    d = rows.select(key, seq).distinct().withColumn("_n", nxt).filter(F.col("_n") > F.col(seq) + 1)
    return d.select(key, F.col(seq).alias("after"), (F.col(seq) + 1).alias("missing_from"), (F.col("_n") - 1).alias("missing_to"))


def conversation_stats(events: DataFrame, *, key: str, seq: str, at: str) -> DataFrame:
    g = events.groupBy(key).agg(F.countDistinct(seq).alias("events"), F.min(seq).alias("first_sequence"), F.max(seq).alias("last_sequence"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return g.withColumn("missing", F.col("last_sequence") - F.col("first_sequence") + 1 - F.col("events"))


def context(events: DataFrame, *, key: str, seq: str, anchors: DataFrame, before: int = 5, after: int = 5) -> DataFrame:
    """Events around anchors (key, anchor): ``before`` with lower sequence numbers, the anchor, ``after`` with higher ones."""
    j = events.join(anchors, key)
    side = F.when(F.col(seq) < F.col("anchor"), -1).when(F.col(seq) == F.col("anchor"), 0).otherwise(1)
    w = W.partitionBy(key, "anchor", "_side").orderBy(F.abs(F.col(seq) - F.col("anchor")))
    ranked = j.withColumn("_side", side).withColumn("_r", F.row_number().over(w))
    return ranked.filter(((F.col("_side") == -1) & (F.col("_r") <= before)) | (F.col("_side") == 0) | ((F.col("_side") == 1) & (F.col("_r") <= after))).drop("_side", "_r")
