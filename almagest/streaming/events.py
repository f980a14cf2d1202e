"""Streams: idempotent ingest of conversation events, gaps in their sequences, and a projection that follows the log of claims."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from almagest.sources.files import Files

EVENT = "owner string, conversation string, event_id string, sequence bigint, content string"


def ingest_events(events: DataFrame, target: str, conflicts: str, checkpoint: str) -> StreamingQuery:
    """Append each event once to ``target``; the same id with other content, or a taken sequence number, goes to ``conflicts``.

    A batch is written under its number with overwrite, so a batch that is replayed after a failure leaves no double.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        b = batch.withColumn("hash", F.sha2("content", 256))
        first = b.groupBy("owner", "event_id").agg(F.min(F.struct("sequence", "conversation", "content", "hash")).alias("x"), F.count_distinct("hash").alias("_v"))
        one = first.select("owner", "event_id", "x.*", "_v")
        if Files(spark, target).exists(""):
            old = spark.read.parquet(target).filter(F.col("batch") < number)
            known = old.select("owner", "event_id", F.col("hash").alias("_h"))
            taken = old.select("owner", "conversation", "sequence", F.col("event_id").alias("_e"))
            one = one.join(known, ["owner", "event_id"], "left").join(taken, ["owner", "conversation", "sequence"], "left")
        else:
            one = one.withColumns({"_h": F.lit(None).cast("string"), "_e": F.lit(None).cast("string")})
        lead = F.min("event_id").over(W.partitionBy("owner", "conversation", "sequence"))
        clash = (F.col("_v") > 1) | (F.col("_h") != F.col("hash")) | (F.col("_e") != F.col("event_id")) | (F.col("sequence").isNotNull() & (lead != F.col("event_id")))
        one = one.withColumn("_c", F.coalesce(clash, F.lit(False)))
        cols = ["owner", "conversation", "event_id", "sequence", "content", "hash"]
        one.filter("not _c and _h is null").select(*cols).write.mode("overwrite").parquet(f"{target}/batch={number}")
        one.filter("_c").select(*cols).write.mode("overwrite").parquet(f"{conflicts}/batch={number}")

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sequence_gaps(events: DataFrame) -> DataFrame:
    """(owner, conversation, first, last, seen, missing) after each batch, kept as state per conversation; repeats of a number count once.

    The state is a list of the disjoint stretches seen, so it is small where few numbers are missing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        spans = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in batches:
            spans += [(int(x), int(x)) for x in pdf["sequence"].dropna()]
        spans.sort()
        merged: list[list[int]] = []
        for a, b in spans:
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        state.update(([a for a, _ in merged], [b for _, b in merged]))
        if merged:
            seen = sum(b - a + 1 for a, b in merged)
            yield pd.DataFrame([(*key, merged[0][0], merged[-1][1], seen, merged[-1][1] - merged[0][0] + 1 - seen)], columns=["owner", "conversation", "first", "last", "seen", "missing"])

    return events.groupBy("owner", "conversation").applyInPandasWithState(step, "owner string, conversation string, first bigint, last bigint, seen bigint, missing bigint", "a array<bigint>, b array<bigint>", "update", "NoTimeout")


def follow_facts(facts: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest state of each resource in ``target`` as states arrive, late ones too.

    Each batch reads the table, writes a new version of it and then the name of the version in use, so readers never see
    half of one; the version before the last is removed.
    """
    from almagest.operators.search import latest_states

    def run(batch: DataFrame, number: int) -> None:
        spark, files = batch.sparkSession, Files(batch.sparkSession, target)
        now = (files.read("current") or b"").decode()
        if now == f"v{number}":  # a batch replayed after it was done
            return
        old = spark.read.parquet(f"{target}/{now}") if now else None
        rows = batch if old is None else old.select(*batch.columns).unionByName(batch)
        latest_states(rows).select(*batch.columns).write.mode("overwrite").parquet(f"{target}/v{number}")
        files.put("current", f"v{number}".encode())
        for n in files.names(""):
            if n.startswith("v") and n not in (now, f"v{number}"):
                files.remove(n)

    return facts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/{Files(spark, target).read('current').decode()}")
