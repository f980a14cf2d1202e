"""Identifiers: ``<prefix>_<32 hex>``, bare or dashed UUIDs, and external ids ``scheme:value``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The prefixes of the 14 kinds of identifiers.
PREFIXES = ("res", "asr", "src", "acq", "drv", "rev", "br", "obs", "trj", "seq", "mrg", "frm", "tbl", "key")


def canonical_id(col: Column, prefix: str = "res") -> Column:
    """``<prefix>_<32 hex>`` of a prefixed, bare or dashed UUID in any case; other texts as they are, outer blanks aside; null stays null."""
    bare = F.regexp_replace(F.lower(F.trim(col)), f"^{prefix}_|^urn:uuid:|[-{{}}]", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), F.concat(F.lit(f"{prefix}_"), bare)).otherwise(F.trim(col))


def resolve_ids(df: DataFrame, cols: list[str], resources: DataFrame, prefix: str = "res") -> DataFrame:
    """Write each of ``cols`` as in ``resources`` (resource_id, external_ids): any spelling of the UUID, or an external id.

    An external id (scheme in any case) held by several resources stands for the smallest of them. What is neither is
    kept as it is, so unknown ids still link among themselves.
    """
    ext = (
        resources.select(F.col("resource_id").alias("_id"), F.explode("external_ids").alias("_x")).filter("_x is not null")
        .groupBy(_scheme(F.col("_x")).alias("_x")).agg(F.min("_id").alias("_id"))
    )
    for c in cols:
        key = canonical_id(F.col(f"`{c}`"), prefix)
        df = df.withColumn(c, key).join(ext.withColumnRenamed("_x", f"_x_{c}").withColumnRenamed("_id", f"_id_{c}"), F.when(F.col(f"`{c}`").contains(":"), _scheme(F.col(f"`{c}`"))) == F.col(f"_x_{c}"), "left")
        df = df.withColumn(c, F.coalesce(F.col(f"_id_{c}"), F.col(f"`{c}`"))).drop(f"_x_{c}", f"_id_{c}")
    return df


def _scheme(c: Column) -> Column:
    return F.concat(F.lower(F.substring_index(F.trim(c), ":", 1)), F.regexp_replace(F.trim(c), "^[^:]*", ""))


def parse_id(text: str, prefix: str) -> str:
    """The canonical spelling; ValueError for another prefix or what is no UUID."""
    head, _, tail = text.strip().rpartition("_")
    if head and head.lower() != prefix:
        raise ValueError(f"{text!r} is no {prefix} id")
    return f"{prefix}_{uuid.UUID(tail).hex}"
