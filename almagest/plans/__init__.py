"""Plan helpers: lineage cuts, partition sizing, size-checked broadcasts."""

from __future__ import annotations

import gc
import math
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; only where it is unset, and all runs on this machine (tests), take a folder of our own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="almagest-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor never forces an iteration to start over."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that the files of shuffles behind lineage cuts are deleted now; else they stay on disk until it happens to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts_for(rows: int, rows_per_part: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / max(1, rows_per_part)))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small(df: DataFrame, limit_rows: int = 20_000) -> DataFrame:
    """Broadcast ``df`` only if a count bounded by ``limit_rows`` proves it small; else leave the join to Catalyst."""
    return F.broadcast(df) if df.limit(limit_rows + 1).count() <= limit_rows else df


def columns_or_null(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Exactly the wanted columns (name -> type), nulls for the missing ones; any other columns are ignored."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])
