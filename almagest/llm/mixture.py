"""Mixing sources to target shares of the total size, as a curriculum of training positions.

Each source has a weight that changes over training, a line through points of its schedule (by default one that falls
for large sources and rises for small ones); its integral is the source's cumulative token demand. Inverting
it at the tokens a source has given so far assigns every use of a document its position, and a range sort by position
gives the training order. Running token sums are formed in two levels, over hash buckets and inside them, so that no
task ever holds a whole source. Sources whose demand exceeds their documents repeat them, up to a cap; what a capped
source cannot give is asked of the others in proportion to their shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almagest.plans import cut


def _allot(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: float) -> dict[str, float]:
    """Tokens to draw of each source: its share of the total, at most its tokens times its repeats; what is missing is asked of those with room."""
    drawn = dict.fromkeys(targets, 0.0)
    room = {s: tokens.get(s, 0) * r for s, (w, r) in targets.items() if w > 0}
    left = total
    while left > 1e-6 and room:
        weight = sum(targets[s][0] for s in room)
        full = [s for s in room if drawn[s] + left * targets[s][0] / weight >= room[s]]
        if not full:
            for s in room:
                drawn[s] += left * targets[s][0] / weight
            break
        for s in full:
            left -= room[s] - drawn[s]
            drawn[s] = float(room.pop(s))
    return drawn


Schedule = dict[str, list[tuple[float, float]]]


def _default(targets: dict[str, tuple[float, int]]) -> Schedule:
    """The weight of the largest source falls by half of its mean over training, that of the smallest rises; weights always sum to 1."""
    ranked = sorted(targets, key=lambda s: (-targets[s][0], s))
    raw = {s: 0.5 - i / max(1, len(ranked) - 1) for i, s in enumerate(ranked)}
    mean = sum(targets[s][0] * raw[s] for s in ranked)
    tilt = {s: max(-1.0, min(1.0, (raw[s] - mean))) for s in ranked}
    return {s: [(0.0, 1 + tilt[s]), (1.0, 1 - tilt[s])] for s in ranked}


def _pieces(points: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(from, to, weight at from, change of weight over time, integral before) of a schedule from 0 to 1, scaled to the integral 1."""
    at = sorted({float(t): max(0.0, float(w)) for t, w in points if 0 <= t <= 1}.items()) or [(0.0, 1.0)]
    at = ([] if at[0][0] == 0 else [(0.0, at[0][1])]) + at + ([] if at[-1][0] == 1 else [(1.0, at[-1][1])])
    area = sum((b - a) * (x + y) / 2 for (a, x), (b, y) in zip(at, at[1:], strict=False))
    if area <= 0:
        return [(0.0, 1.0, 1.0, 0.0, 0.0)]
    out, done = [], 0.0
    for (a, x), (b, y) in zip(at, at[1:], strict=False):
        out.append((a, b, x / area, (y - x) / (b - a) / area, done))
        done += (b - a) * (x + y) / 2 / area
    return out


def _prepared(documents: DataFrame, mix_targets: DataFrame, total: float | None, bucket_tokens: int, schedule: Schedule | None = None) -> tuple[DataFrame, list[tuple]]:
    """Documents of the sources with their tokens before them in their source's stream; the plan per source."""
    spark = documents.sparkSession
    rows = mix_targets.select("source", F.col("target_share").cast("double").alias("w"), F.coalesce(F.col("max_repeats"), F.lit(1)).cast("int").alias("r")).filter("source is not null and w is not null").dropDuplicates(["source"]).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("mix_targets must be a dimension of at most 10,000 sources")
    targets = {x.source: (max(0.0, x.w), max(0, x.r)) for x in rows}
    plan_schema = "source string, target double, repeats int, tokens bigint, documents bigint, drawn double, pieces array<struct<a:double,b:double,w:double,k:double,c:double>>"
    names = spark.createDataFrame([(s,) for s in targets], "source string")
    docs = cut(documents.select("doc_id", "source", "n_tokens").filter("doc_id is not null and n_tokens > 0").join(F.broadcast(names), "source", "left_semi").dropDuplicates(["doc_id"]).withColumn("h", F.xxhash64("doc_id")))
    sums = {x.source: x for x in docs.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}  # a row per source of the bounded dimension
    tokens = {s: sums[s].t if s in sums else 0 for s in targets}
    drawn = _allot(tokens, targets, float(total if total is not None else sum(tokens.values())))
    lines = {**_default(targets), **(schedule or {})}
    plan = [(s, w, r, tokens[s], sums[s].n if s in sums else 0, drawn[s], _pieces(lines[s])) for s, (w, r) in targets.items()]
    planned = F.broadcast(spark.createDataFrame(plan, plan_schema))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(bucket_tokens))).cast("bigint")
    placed = docs.join(planned, "source").withColumn("b", F.pmod("h", buckets))
    per_bucket = placed.groupBy("source", "b").agg(F.sum("n_tokens").alias("bt"))
    before = per_bucket.withColumn("bb", F.coalesce(F.sum("bt").over(W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("source", "b", "bb")
    inner = F.coalesce(F.sum("n_tokens").over(W.partitionBy("source", "b").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("inner", inner).join(before, ["source", "b"]).withColumn("before", (F.col("bb") + F.col("inner")).cast("bigint")).drop("b", "bb", "inner"), plan


def _uses() -> Column:
    """How often a document begins before its source's drawn tokens end."""
    return F.greatest(F.lit(0), F.least(F.col("repeats"), F.ceil((F.col("drawn") - F.col("before")) / F.col("tokens")))).cast("int")


def mixture_report(documents: DataFrame, mix_targets: DataFrame, *, total_tokens: float | None = None, bucket_tokens: int = 50_000_000) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, uses, most_uses, drawn_tokens, actual_share), one row per target source.

    ``documents`` has doc_id, source, n_tokens. ``total_tokens`` is the size of the mixture, by default that of the
    targets' documents. uses counts documents with their repeats, most_uses is that of the most repeated document;
    actual_share is of all tokens drawn. A document with a null id, source or size, or without a token, is in no
    mixture; a repeated doc_id counts once; sources without a target are left out, targets without documents have zeros.
    A null max_repeats is 1. Empty documents give zeros.
    """
    docs, plan = _prepared(documents, mix_targets, total_tokens, bucket_tokens)
    used = docs.withColumn("u", _uses()).groupBy("source").agg(F.sum("u").alias("uses"), F.max("u").alias("most_uses"), F.sum(F.col("u") * F.col("n_tokens")).alias("drawn_tokens"))
    planned = documents.sparkSession.createDataFrame([x[:5] for x in plan], "source string, target_share double, max_repeats int, tokens bigint, documents bigint")
    all_ = planned.join(used, "source", "left").fillna(0, ["uses", "most_uses", "drawn_tokens"])
    whole = F.sum("drawn_tokens").over(W.partitionBy())  # over the rows of the bounded dimension
    return all_.select("source", "target_share", "max_repeats", "documents", "tokens", "uses", "most_uses", "drawn_tokens", F.when(whole > 0, F.col("drawn_tokens") / whole).otherwise(F.lit(0.0)).alias("actual_share"))


def training_order(documents: DataFrame, mix_targets: DataFrame, *, total_tokens: float | None = None, bucket_tokens: int = 50_000_000, schedule: Schedule | None = None) -> DataFrame:
    """(position, source, doc_id, use) of every use of a document, range-sorted by position in [0, 1].

    ``schedule`` gives sources points (time from 0 to 1, weight) of a line, the weight they have at each time relative
    to others of their own share; before its first and after its last point a weight stays as it is, negative ones are
    0, and a line of zeros counts as level. The share a source gets of the whole is that of ``mix_targets`` in any case.
    The integral of the line is inverted at the tokens the source has given before. Rows as for ``mixture_report``.
    """
    docs, _ = _prepared(documents, mix_targets, total_tokens, bucket_tokens, schedule)
    each = docs.withColumn("u", _uses()).filter("u > 0").withColumn("use", F.explode(F.sequence(F.lit(0), F.col("u") - 1)))
    done = F.least(F.lit(1.0), (F.col("use") * F.col("tokens") + F.col("before")) / F.col("drawn"))
    each = each.withColumn("done", done).withColumn("p", F.element_at(F.filter("pieces", lambda p: (p["c"] <= F.col("done")) & ((p["w"] > 0) | (p["k"] > 0))), -1))
    w, k, rest = F.col("p.w"), F.col("p.k"), F.greatest(F.lit(0.0), F.col("done") - F.col("p.c"))
    # rest = w x + k x^2 / 2
    x = F.when(F.abs(k) < 1e-9, rest / w).otherwise(2 * rest / F.greatest(F.lit(1e-300), w + F.sqrt(F.greatest(F.lit(0.0), w * w + 2 * k * rest))))
    t = F.least(F.col("p.b"), F.col("p.a") + x)
    return each.select(t.alias("position"), "source", "doc_id", "use").repartitionByRange("position", "source", "doc_id", "use").sortWithinPartitions("position", "source", "doc_id", "use")
