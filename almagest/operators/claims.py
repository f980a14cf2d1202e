"""Claims: views, evaluation, ranks, and summaries that report disagreement instead of hiding it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almagest.functions import fuzzy
from almagest.functions.ticks import NEG_INF, POS_INF

LIVE = ("accepted", "proposed", "disputed")
STATUSES = (*LIVE, "retracted", "superseded")
# Predicates with one value at a time.
FUNCTIONAL = ("occurred_at", "start_time", "end_time", "coordinates", "height", "birth_date", "death_date", "publication_date", "inception")


@dataclass(frozen=True)
class Principal:
    id: str | None = None
    groups: tuple[str, ...] = ()
    curator: bool = False
    system: bool = False

    def sees(self, level: Column, owner: Column | None = None, groups: Column | None = None) -> Column:
        """Public rows, group rows of own groups, private rows of oneself; null is public; the system sees all."""
        if self.system:
            return F.lit(True)
        ok = F.coalesce(level, F.lit("public")) == "public"
        if groups is not None and self.groups:
            ok = ok | ((level == "groups") & F.arrays_overlap(groups, F.array(*[F.lit(g) for g in self.groups])))
        if owner is not None and self.id is not None:
            ok = ok | (owner == self.id)
        return ok


@dataclass(frozen=True)
class View:
    """What is looked at: statuses, moment of knowledge (microseconds), branches with their last revision, principal."""

    statuses: tuple[str, ...] = LIVE
    as_known_at_us: int | None = None
    principal: Principal = field(default_factory=Principal)

    def claims(self, assertions: DataFrame, chain: DataFrame | None = None) -> DataFrame:
        """The claims seen. A claim without first_known_at is not known at any given moment. ``chain`` has branch_id (and seq_limit for tables with created_seq)."""
        out = assertions.filter(F.col("status").isin(*self.statuses) & self.principal.sees(F.col("visibility")))
        if self.as_known_at_us is not None:
            out = out.filter(F.unix_micros("first_known_at") <= self.as_known_at_us)
        if chain is not None:
            out = out.join(F.broadcast(chain.select("branch_id").distinct()), "branch_id", "left_semi")
        return out


def identity_key(o: Column) -> Column:
    """Text under which two claims' objects are the same value."""
    number = F.regexp_replace(F.format_string("%.6f", o["amount"]), r"\.?0+$", "")
    return (
        F.when(o["kind"] == "resource", F.concat(F.lit("r:"), o["resource"])).when(o["kind"] == "text", F.concat(F.lit("t:"), F.lower(F.trim(o["text"]))))
        .when(o["kind"] == "quantity", F.concat(F.lit("q:"), number, F.lit(":"), F.coalesce(o["unit"], F.lit("")))).when(o["kind"] == "time", F.concat(F.lit("time:"), o["moment"])).otherwise(F.lit("unknown"))
    )


@dataclass(frozen=True)
class RankPolicy:
    """Fixed values of the default policy."""

    source: float = 0.35
    extraction: float = 0.2
    corroboration: float = 0.3
    specificity: float = 0.15
    saturation: int = 3
    proposed: float = 0.8
    disputed: float = 0.5

    def tier(self, human: Column, independent: Column, ai_only: Column, origin: Column) -> Column:
        return F.when(human, 4).when(independent >= 2, 3).when(ai_only, 0).when(origin == "primary", 2).otherwise(1)

    def score(self, reliability: Column, extraction: Column, independent: Column, specificity: Column, origin: Column, status: Column) -> Column:
        """Weighted mean of the parts that are known, times the status' factor, below 1."""
        default = F.when(origin == "primary", 0.8).when(origin == "secondary", 0.6).when(origin == "tertiary", 0.45).otherwise(0.4)
        corroboration = F.least(F.lit(1.0), F.greatest(F.lit(0), independent - 1) / self.saturation)
        parts = [(self.source, F.coalesce(reliability, default)), (self.extraction, extraction), (self.corroboration, corroboration), (self.specificity, specificity)]
        num = sum((F.when(v.isNotNull(), w * F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))).otherwise(F.lit(0.0)) for w, v in parts), F.lit(0.0))
        den = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for w, v in parts), F.lit(0.0))
        factor = F.when(status == "accepted", 1.0).when(status == "proposed", self.proposed).when(status == "disputed", self.disputed).otherwise(0.0)
        return F.least(F.lit(0.999999), F.when(den > 0, num / den).otherwise(0.0) * factor)


# Kinds of origin from the best to the worst.
ORIGINS = ("primary", "secondary", "tertiary", "user_generated", "ai_generated")


def specificity(moment: Column) -> Column:
    """How precisely a date is told: clock 1, day .85, month .6, year .4; null where no date is seen."""
    day, month, year = (rf"(\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}|\d年\d{{1,2}}月\d{{1,2}}日)", r"(\d{4}-\d{2}$|\d年\d{1,2}月$)", r"(^\d{3,4}$|\d年$)")
    return F.when(moment.rlike(day + r".*\d{1,2}(:\d{2}|時)"), 1.0).when(moment.rlike(day), 0.85).when(moment.rlike(month), 0.6).when(moment.rlike(year), 0.4)


def evaluate(claims: DataFrame, policy: RankPolicy | None = None, *, evidence: DataFrame | None = None) -> DataFrame:
    """Claims with okey, independent, ai_only, origin, tier and rank.

    ``evidence`` has claim_id, root (where its source ultimately comes from), origin, reliability, extraction_conf and
    ai (whether a model derived it); any row more than once counts once. independent is the number of different roots
    that claims of the same subject, predicate, value and polarity rest on; a claim without evidence is a root of its
    own (with others of the same ``asserted_by``, where that column exists). A claim's own reliability and confidence
    go before the greatest of its evidence, its origin is the best one; it is ai_only if all its evidence was derived
    by models, or it has none and its author ``by_ai``. ``human_verified``, where that column exists, goes before all.
    """
    p = policy or RankPolicy()
    have = set(claims.columns)
    own = F.concat(F.lit("actor:"), F.coalesce("asserted_by", "claim_id") if "asserted_by" in have else F.col("claim_id"))
    author = F.coalesce("by_ai", F.lit(False)) if "by_ai" in have else F.lit(False)
    human = F.coalesce("human_verified", F.lit(False)) if "human_verified" in have else F.lit(False)
    c = claims.withColumn("okey", identity_key(F.col("object")))
    key = ["subject", "predicate", "okey", "negated"]
    if evidence is None:
        c = c.withColumns({"_roots": F.array(own), "ai_only": author, "origin": F.lit("unknown"), "_rel": F.lit(None).cast("double"), "_ext": F.lit(None).cast("double")})
    else:
        best = F.array_position(F.array(*[F.lit(o) for o in ORIGINS]), F.col("origin")).cast("int")
        per = evidence.groupBy("claim_id").agg(F.collect_set("root").alias("_er"), F.min(F.when(best > 0, best)).alias("_o"), F.max("reliability").alias("_rel"), F.max("extraction_conf").alias("_ext"), F.bool_and(F.coalesce("ai", F.lit(False))).alias("_ai"))
        c = c.join(per, "claim_id", "left").withColumn("_roots", F.when(F.size("_er") > 0, F.col("_er")).otherwise(F.array(own))).withColumn("ai_only", F.coalesce("_ai", author))
        c = c.withColumn("origin", F.coalesce(F.try_element_at(F.array(*[F.lit(o) for o in ORIGINS]), F.col("_o")), F.lit("unknown"))).drop("_er", "_o", "_ai")
    n = c.select(*key, F.explode("_roots").alias("_root")).groupBy(*key).agg(F.countDistinct("_root").alias("independent"))
    on = F.lit(True)
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_n_{k}"))
    n = n.select(*[F.col(k).alias(f"_n_{k}") for k in key], "independent")
    c = c.join(n, on).drop(*[f"_n_{k}" for k in key])
    when = F.when(F.col("object.kind") == "time", specificity(F.col("object.moment")))
    tier = p.tier(human, F.col("independent"), F.col("ai_only"), F.col("origin"))
    score = p.score(F.coalesce("source_reliability", "_rel"), F.coalesce("extraction_conf", "_ext"), F.col("independent"), when, F.col("origin"), F.col("status"))
    return c.withColumn("tier", tier).withColumn("rank", tier + score).drop("_roots", "_rel", "_ext")


def summarize(evaluated: DataFrame, functional: DataFrame | None = None) -> DataFrame:
    """(subject, predicate, preferred, n_values, n_distinct, n_negated, contested) of live claims.

    Preferred is the affirmed claim of the highest rank (ties: status, then id). Contested: a functional predicate with
    several values, a value both affirmed and negated, or a disputed claim. ``functional`` has the keys of predicates
    with one value at a time (column predicate), beside those known as such.
    """
    live = evaluated.filter(F.col("status").isin(*LIVE))
    if functional is None:
        live = live.withColumn("_f", F.col("predicate").isin(*FUNCTIONAL))
    else:
        more = functional.select("predicate", F.lit(True).alias("_m")).distinct()
        live = live.join(more, "predicate", "left").withColumn("_f", F.col("predicate").isin(*FUNCTIONAL) | F.coalesce("_m", F.lit(False))).drop("_m")
    order = F.when(F.col("status") == "accepted", 0).when(F.col("status") == "proposed", 1).otherwise(2)
    best = F.min(F.when(~F.col("negated"), F.struct((-F.round("rank", 9)).alias("far"), order.alias("o"), "claim_id")))
    g = live.groupBy("subject", "predicate")
    yes, no = F.collect_set(F.when(~F.col("negated"), F.col("okey"))), F.collect_set(F.when(F.col("negated"), F.col("okey")))
    s = g.agg(best.alias("_p"), F.sum((~F.col("negated")).cast("bigint")).alias("n_values"), F.sum(F.col("negated").cast("bigint")).alias("n_negated"), yes.alias("_yes"), no.alias("_no"), F.bool_or(F.col("status") == "disputed").alias("_d"), F.bool_or("_f").alias("_f"))
    distinct = F.size("_yes").cast("bigint")
    contested = (F.col("_f") & (distinct > 1)) | F.arrays_overlap("_yes", "_no") | F.col("_d")
    return s.select("subject", "predicate", F.col("_p.claim_id").alias("preferred"), "n_values", distinct.alias("n_distinct"), "n_negated", F.coalesce(contested, F.lit(False)).alias("contested"))


_RANGE = "struct<es:bigint,ls:bigint,ee:bigint,le:bigint>"


def event_times(evaluated: DataFrame) -> DataFrame:
    """(subject, axis, time, alternatives, status): the time of each subject from its affirmed claims with es, ls, ee, le and axis.

    The preferred ``occurred_at`` (highest rank, then id) is the time, the others of its axis are alternatives. Without
    one, ``start_time`` and ``end_time`` are put together: the start may be anywhere in the first range, the end in the
    second, a missing side is open. On different axes they are ``incomparable`` and time is null; else status is ``ok``.
    """
    t = evaluated.filter(~F.col("negated") & F.col("es").isNotNull() & F.col("predicate").isin("occurred_at", "start_time", "end_time"))
    r = F.struct("es", "ls", "ee", "le").cast(_RANGE).alias("r")
    w = W.partitionBy("subject", "predicate").orderBy(F.desc(F.round("rank", 9)), "claim_id")
    t = t.select("subject", "predicate", F.coalesce("axis", F.lit("gregorian")).alias("axis"), r, F.row_number().over(w).alias("_n"))
    at = lambda p: F.max(F.when((F.col("predicate") == p) & (F.col("_n") == 1), F.struct("axis", "r")))
    others = F.collect_set(F.when((F.col("predicate") == "occurred_at") & (F.col("_n") > 1), F.struct("axis", "r")))
    g = t.groupBy("subject").agg(at("occurred_at").alias("o"), at("start_time").alias("s"), at("end_time").alias("e"), others.alias("_alt"))
    pair = {"es": F.coalesce("s.r.es", F.lit(NEG_INF)), "ls": F.coalesce("s.r.le", F.lit(POS_INF)), "ee": F.coalesce("e.r.es", F.lit(NEG_INF)), "le": F.coalesce("e.r.le", F.lit(POS_INF))}
    fits = fuzzy.fuzzy(pair["es"], pair["ls"], pair["ee"], pair["le"]).cast(_RANGE)
    clash = F.col("o").isNull() & (F.col("s.axis") != F.col("e.axis"))
    axis = F.coalesce("o.axis", "s.axis", "e.axis")
    alternatives = F.array_sort(F.transform(F.filter("_alt", lambda x: x["axis"] == F.col("o.axis")), lambda x: x["r"]))
    return g.select("subject", F.when(~F.coalesce(clash, F.lit(False)), axis).alias("axis"), F.when(F.col("o").isNotNull(), F.col("o.r")).when(~F.coalesce(clash, F.lit(False)), fits).alias("time"), alternatives.alias("alternatives"), F.when(F.coalesce(clash, F.lit(False)), "incomparable").otherwise("ok").alias("status"))
