"""Attributes as known at event time (as-of join with time-sharded hot entities).

Events never interact with each other, only with the last version at or before them. An entity whose rows exceed
``shard_rows`` is cut along time into shards of about that many rows: its rows are range-partitioned by time, versions
before events of one instant and these by id, so that a burst, even of one instant, is cut like any other stretch.
Every shard receives the entity's last version before the shard as a carry-in row, so each is merged on its own and
gives what an unsplit merge would give. Entities below the bound are one shard and need no carry-in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almagest.plans import cut, parts_for, small

_ORDER = ["_t", "_event", "_k"]  # at one instant versions sort before events, the greatest rank last


def _merged(rows: DataFrame, *shard: str) -> DataFrame:
    w = W.partitionBy(*shard).orderBy(*_ORDER).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("_v", F.last("_r", ignorenulls=True).over(w)).filter("_event and _v is not null").select("_id", "_e", "_v")


def _shards(hot: DataFrame, shard_rows: int) -> DataFrame:
    """The rows of hot entities with their shard (_s), and the carry-in row of each shard; at most ``shard_rows`` and a few per shard."""
    parts = parts_for(hot.count(), shard_rows)
    placed = cut(hot.repartitionByRange(parts, "_e", *_ORDER).withColumn("_s", F.spark_partition_id()))
    last = placed.groupBy("_e", "_s").agg(F.max(F.when(~F.col("_event"), F.struct("_t", "_r"))).alias("_last"))
    before = F.max("_last").over(W.partitionBy("_e").orderBy("_s").rowsBetween(W.unboundedPreceding, -1))
    # a carry-in is older than all of its shard, or of the same instant as its first rows and of a lower rank
    carry = last.withColumn("_in", before).filter("_in is not null").select(
        F.lit(None).cast(hot.schema["_id"].dataType).alias("_id"), "_e", F.col("_in._t").alias("_t"), F.col("_in._r").alias("_r"), F.lit(False).alias("_event"), F.lit(None).cast("bigint").alias("_k"), "_s",
    )
    return placed.unionByName(carry)


def as_of_join(events: DataFrame, versions: DataFrame, *, entity: str, event_id: str, event_time: str, version_time: str, version_rank: str, shard_rows: int = 1_000_000) -> DataFrame:
    """(event_id, entity, version_rank) of the latest version known at the event.

    The version has the greatest ``version_time`` at or before ``event_time``; among equal times the greatest
    ``version_rank``. Both times are bigints in one unit. Nulls: a row without entity or time takes no part (a version
    whose time is unknown is never known). Repeated events and versions count once. Events without such a version
    have no row. Empty inputs give an empty result; other columns, whatever their names, are ignored.
    """
    e = events.select(F.col(event_id).alias("_id"), F.col(entity).alias("_e"), F.col(event_time).cast("bigint").alias("_t"), F.lit(None).cast("bigint").alias("_r"), F.lit(True).alias("_event"), F.xxhash64(event_id).alias("_k"))
    v = versions.select(F.lit(None).cast(e.schema["_id"].dataType).alias("_id"), F.col(entity).alias("_e"), F.col(version_time).cast("bigint").alias("_t"), F.col(version_rank).cast("bigint").alias("_r"), F.lit(False).alias("_event"), F.col(version_rank).cast("bigint").alias("_k"))
    e = e.filter("_id is not null and _e is not null and _t is not null").dropDuplicates(["_id", "_e", "_t"])
    v = v.filter("_r is not null and _e is not null and _t is not null").dropDuplicates(["_e", "_t", "_r"])
    rows = e.unionByName(v)
    hot = cut(rows.groupBy("_e").count().filter(F.col("count") > shard_rows).select("_e"))
    if hot.isEmpty():
        out = _merged(rows, "_e")
    else:
        hot = small(hot)
        out = _merged(rows.join(hot, "_e", "left_anti"), "_e").unionByName(_merged(_shards(rows.join(hot, "_e", "left_semi"), shard_rows), "_e", "_s"))
    return out.select(F.col("_id").alias(event_id), F.col("_e").alias(entity), F.col("_v").alias(version_rank))
