"""Search over the projection: one row per resource in its latest known state, filtered, scored, cut to the best k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almagest.functions.geo import boxes_meet, haversine_m, near_box
from almagest.functions.text import normalize_label, tokens


def latest_states(facts: DataFrame, *, as_known_at_us: int | None = None) -> DataFrame:
    """The state of each resource known last (at the moment, if given): greatest known_from, then greatest revision; one map-side combined aggregate."""
    f = facts.filter("known_from is not null and canonical_id is not null")
    if as_known_at_us is not None:
        f = f.filter(F.unix_micros("known_from") <= as_known_at_us)
    rest = [c for c in facts.columns if c not in ("canonical_id", "known_from", "source_revision")]
    best = f.groupBy("canonical_id").agg(F.max(F.struct("known_from", "source_revision")).alias("_b"))
    full = f.join(best, "canonical_id").filter((F.col("known_from") == F.col("_b.known_from")) & (F.col("source_revision") == F.col("_b.source_revision")))
    return full.select("canonical_id", "known_from", "source_revision", *rest).dropDuplicates(["canonical_id"])


def projection(facts: DataFrame, resources: DataFrame) -> DataFrame:
    """Latest states with labels, types, and label tokens of their resource."""
    r = resources.select(F.col("resource_id").alias("canonical_id"), "types", F.trim("label").alias("label"), "visibility").dropDuplicates(["canonical_id"])
    return latest_states(facts).join(r, "canonical_id")


@dataclass(frozen=True)
class Search:
    """Filters are ANDed; types are ORed. Results are ordered by rank, relevance or id after equal scores."""

    types: tuple[str, ...] = ()
    within_place: str | None = None
    bbox: tuple[float, float, float, float] | None = None
    near: tuple[float, float, float] | None = None  # lon, lat, metres
    include_inherited: bool = False
    text: str | None = None
    min_rank: float | None = None
    contested_only: bool = False
    order_by: str = "rank"
    limit: int = 20

    def filters(self) -> list[Column]:
        p, out = F.col("placement"), []
        if self.types:
            out.append(F.arrays_overlap("types", F.array(*[F.lit(t) for t in self.types])))
        if self.within_place:
            out.append(F.array_contains("place_ancestors", self.within_place) | F.array_contains("places", self.within_place))
        own = F.lit(True) if self.include_inherited else F.col("placement_inherited_from").isNull()
        if self.bbox:
            out += [p["frame"] == "wgs84", boxes_meet(p, *self.bbox), own]
        if self.near:
            lon, lat, r = self.near
            mid = ((p["minx"] + p["maxx"]) / 2, (p["miny"] + p["maxy"]) / 2)
            out += [p["frame"] == "wgs84", boxes_meet(p, *near_box(lon, lat, r)), haversine_m(mid[0], mid[1], F.lit(lon), F.lit(lat)) <= r, own]
        if self.text:
            have = tokens(F.col("label"))
            out.append(F.forall(tokens(F.lit(self.text)), lambda t: F.array_contains(have, t)))
        if self.min_rank is not None:
            out.append(F.col("rank") >= self.min_rank)
        if self.contested_only:
            out.append(F.col("contested"))
        return out

    def relevance(self) -> Column:
        q = normalize_label(F.lit(self.text or ""))
        label = normalize_label(F.col("label"))
        exact = F.when(F.lit(bool(self.text)) & (label == q), 1.0).when(F.lit(bool(self.text)) & label.startswith(q), 0.3).otherwise(0.0)
        return 0.1 * F.coalesce("rank", F.lit(0.0)) + exact

    def run(self, rows: DataFrame) -> DataFrame:
        """The best ``limit`` (1 to 500) rows: a TakeOrdered, so no task sends more than that."""
        for f in self.filters():
            rows = rows.filter(f)
        score = self.relevance() if self.order_by == "relevance" else F.coalesce("rank", F.lit(0.0))
        rows = rows.withColumn("score", F.round(score, 6))
        return rows.orderBy(F.desc("score"), "canonical_id").limit(max(1, min(500, self.limit)))


def similar(projected: DataFrame, target: str, *, limit: int = 10, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """(canonical_id, score): rows that share a place or type with the target, by places and types in common (Jaccard) and rank (a fifth, at most 1)."""
    t = projected.filter(F.col("canonical_id") == target).select(F.coalesce("place_ancestors", F.array()).alias("_pa"), F.coalesce("types", F.array()).alias("_ty"))
    j = projected.filter(F.col("canonical_id") != target).join(F.broadcast(t.limit(1)), F.arrays_overlap(F.coalesce("place_ancestors", F.array()), "_pa") | F.arrays_overlap("types", "_ty"))

    def jaccard(a: Column, b: Column) -> Column:
        u = F.size(F.array_union(a, b))
        return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(F.lit(0.0))

    places = jaccard(F.coalesce("place_ancestors", F.array()), F.col("_pa"))
    score = weights[0] * places + weights[1] * jaccard(F.col("types"), F.col("_ty")) + weights[2] * F.least(F.lit(1.0), F.coalesce("rank", F.lit(0.0)) / 5)
    return j.select("canonical_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "canonical_id").limit(limit)


def similar_each(projected: DataFrame, targets: DataFrame, *, limit: int = 10, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """(target, canonical_id, score): as ``similar``, for each row of ``targets``; blocks of targets meet blocks of rows."""
    none = F.array().cast("array<string>")
    sets = lambda d, p: d.select(F.col("canonical_id").alias(f"{p}id"), F.array_distinct(F.coalesce("place_ancestors", none)).alias(f"{p}pa"), F.array_distinct(F.coalesce("types", none)).alias(f"{p}ty"), F.coalesce("rank", F.lit(0.0)).alias(f"{p}rank"))
    j = sets(projected, "").join(sets(targets, "_").drop("_rank"), (F.col("id") != F.col("_id")) & (F.arrays_overlap("pa", "_pa") | F.arrays_overlap("ty", "_ty")))

    def jaccard(a: str, b: str) -> Column:
        u = F.size(F.array_union(a, b))
        return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(F.lit(0.0))

    score = weights[0] * jaccard("pa", "_pa") + weights[1] * jaccard("ty", "_ty") + weights[2] * F.least(F.lit(1.0), F.col("rank") / 5)
    ranked = j.select(F.col("_id").alias("target"), F.col("id").alias("canonical_id"), F.round(score, 6).alias("score"))
    return ranked.withColumn("_r", F.row_number().over(W.partitionBy("target").orderBy(F.desc("score"), "canonical_id"))).filter(F.col("_r") <= limit).drop("_r")
