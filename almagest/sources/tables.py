"""Parquet tables of one scale directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the directory; columns are pruned by what later steps select."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
