"""Queries of the engine's own operators over the tables of a scale directory, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almagest.functions import allen, fuzzy, geo, text, vectors
from almagest.functions import temporal_text as tt
from almagest.functions.ids import canonical_id
from almagest.functions.ticks import DAY, tick, weekday
from almagest.operators import claims, extract, graph, intervals, search, series
from almagest.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KNOWN_AT = 1_609_459_200_000_000  # 2021-01-01T00:00Z in microseconds


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
_sql = lambda s: s.replace("'", "''")
def norm_sql(c: str) -> str:
    return f"trim(regexp_replace(lower(translate({c}, '{_sql(_WIDE)}', '{_sql(_NARROW)}')), '\\s+', ' ', 'g'))"


RES = "(SELECT DISTINCT resource_id, trim(label) AS label, types, aliases, external_ids, visibility, license FROM resources)"
LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY known_from DESC, source_revision DESC) rn FROM resource_facts WHERE known_from IS NOT NULL) WHERE rn = 1)"
OKEY = "CASE object.kind WHEN 'resource' THEN 'r:' || object.resource WHEN 'text' THEN 't:' || lower(trim(object.text)) WHEN 'quantity' THEN 'q:' || regexp_replace(printf('%.6f', object.amount), '\\.?0+$', '') || ':' || coalesce(object.unit, '') WHEN 'time' THEN 'time:' || object.moment ELSE 'unknown' END"
CLAIMS = "(SELECT DISTINCT * FROM assertions)"


def _res(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "resources").select("resource_id", F.trim("label").alias("label"), "types", "aliases", "external_ids", "visibility", "license").distinct()


def _proj(s: SparkSession, d: str) -> DataFrame:
    return search.projection(load(s, d, "resource_facts"), load(s, d, "resources"))


# ---- lookup


@query(f"SELECT resource_id, {norm_sql('label')} AS norm FROM {RES} WHERE label IS NOT NULL")
def normalize_labels(s: SparkSession, d: str) -> DataFrame:
    return _res(s, d).filter("label is not null").select("resource_id", text.normalize_label(F.col("label")).alias("norm"))


@query(f"SELECT norm, count(*) AS matches, count(*) > 1 AS ambiguous, min(resource_id) AS first_id FROM (SELECT DISTINCT resource_id, {norm_sql('label')} AS norm FROM {RES} WHERE label IS NOT NULL) GROUP BY norm")
def lookup_label_ambiguous(s: SparkSession, d: str) -> DataFrame:
    n = normalize_labels(s, d).distinct().groupBy("norm").agg(F.count("*").alias("matches"), F.min("resource_id").alias("first_id"))
    return n.select("norm", "matches", (F.col("matches") > 1).alias("ambiguous"), "first_id")


@query(f"SELECT lower(split_part(x, ':', 1)) AS scheme, split_part(x, ':', 2) AS val, min(resource_id) AS resource_id, count(DISTINCT resource_id) AS n FROM (SELECT resource_id, unnest(external_ids) AS x FROM {RES}) WHERE x IS NOT NULL GROUP BY 1, 2")
def lookup_external(s: SparkSession, d: str) -> DataFrame:
    x = _res(s, d).select("resource_id", F.explode("external_ids").alias("x")).filter("x is not null")
    scheme, val = F.lower(F.split_part("x", F.lit(":"), F.lit(1))), F.split_part("x", F.lit(":"), F.lit(2))
    return x.groupBy(scheme.alias("scheme"), val.alias("val")).agg(F.min("resource_id").alias("resource_id"), F.countDistinct("resource_id").alias("n"))


_BARE = "regexp_replace(lower(trim({c})), '^res_|-', '', 'g')"
_CANON = f"CASE WHEN regexp_full_match({_BARE}, '[0-9a-f]{{{{32}}}}') THEN 'res_' || {_BARE} ELSE trim({{c}}) END"


@query(f"""WITH RECURSIVE m AS (SELECT {_CANON.format(c='from_id')} AS id, {_CANON.format(c='into_id')} AS nxt, requested_at, merge_id FROM (SELECT DISTINCT from_id, into_id, requested_at, merge_id FROM merges) WHERE from_id IS NOT NULL AND into_id IS NOT NULL),
one AS (SELECT id, nxt FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY requested_at NULLS FIRST, merge_id NULLS FIRST, nxt) rn FROM m WHERE id <> nxt) WHERE rn = 1),
walk AS (SELECT id, nxt, 1 AS k FROM one UNION ALL SELECT w.id, o.nxt, k + 1 FROM walk w JOIN one o ON o.id = w.nxt WHERE k < 16)
SELECT id, arg_max(nxt, k) AS final_id FROM walk GROUP BY id""")  # fmt: skip
def lookup_redirect(s: SparkSession, d: str) -> DataFrame:
    m = load(s, d, "merges").filter("from_id is not null and into_id is not null").select(canonical_id(F.col("from_id")).alias("id"), canonical_id(F.col("into_id")).alias("into"), "requested_at", "merge_id").distinct().filter("id <> into")
    one = m.groupBy("id").agg(F.min(F.struct("requested_at", "merge_id", "into")).alias("b")).select("id", "b.into")
    return graph.follow_redirects(one).withColumnRenamed("final", "final_id")


# ---- search

_PROJ = f"(SELECT f.*, r.types, r.label, r.visibility FROM {LATEST} f JOIN (SELECT resource_id, any_value(types) AS types, any_value(trim(label)) AS label, any_value(visibility) AS visibility FROM resources GROUP BY 1) r ON f.canonical_id = r.resource_id)"


@query(f"SELECT canonical_id, round(coalesce(rank, 0), 6) AS score FROM {_PROJ} WHERE list_contains(types, 'Event') AND rank >= 1.0 ORDER BY score DESC, canonical_id LIMIT 20")
def search_type_rank(s: SparkSession, d: str) -> DataFrame:
    return search.Search(types=("Event",), min_rank=1.0).run(_proj(s, d)).select("canonical_id", "score")


@query(f"SELECT canonical_id, round(coalesce(rank, 0), 6) AS score FROM {_PROJ} WHERE list_contains(place_ancestors, (SELECT min(place_id) FROM gazetteer WHERE kind = 'Region')) OR list_contains(places, (SELECT min(place_id) FROM gazetteer WHERE kind = 'Region')) ORDER BY score DESC, canonical_id LIMIT 50")
def search_within_place(s: SparkSession, d: str) -> DataFrame:
    place = load(s, d, "gazetteer").filter("kind = 'Region'").agg(F.min("place_id").alias("p")).first()["p"]
    return search.Search(within_place=place or "", limit=50).run(_proj(s, d)).select("canonical_id", "score") if place else _proj(s, d).filter("false").select("canonical_id", F.col("rank").alias("score"))


@query(f"SELECT canonical_id, round(coalesce(rank, 0), 6) AS score FROM {_PROJ} WHERE placement.frame = 'wgs84' AND placement.minx <= 60 AND placement.maxx >= -10 AND placement.miny <= 60 AND placement.maxy >= 10 AND placement_inherited_from IS NULL ORDER BY score DESC, canonical_id LIMIT 100")
def search_bbox(s: SparkSession, d: str) -> DataFrame:
    return search.Search(bbox=(-10.0, 10.0, 60.0, 60.0), limit=100).run(_proj(s, d)).select("canonical_id", "score")


_HAV = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(45.0 - y) / 2), 2) + cos(radians(y)) * cos(radians(45.0)) * pow(sin(radians(100.0 - x) / 2), 2))))"


@query(f"SELECT canonical_id, round(coalesce(rank, 0), 6) AS score FROM (SELECT *, (placement.minx + placement.maxx) / 2 AS x, (placement.miny + placement.maxy) / 2 AS y FROM {_PROJ}) WHERE placement.frame = 'wgs84' AND {_HAV} <= 2000000 AND placement_inherited_from IS NULL ORDER BY score DESC, canonical_id LIMIT 100")
def search_near(s: SparkSession, d: str) -> DataFrame:
    return search.Search(near=(100.0, 45.0, 2_000_000.0), limit=100).run(_proj(s, d)).select("canonical_id", "score")


@query(f"SELECT canonical_id, round(0.1 * coalesce(rank, 0) + CASE WHEN {norm_sql('label')} = 'flood of' THEN 1.0 WHEN starts_with({norm_sql('label')}, 'flood of') THEN 0.3 ELSE 0 END, 6) AS score FROM {_PROJ} WHERE list_contains(regexp_extract_all({norm_sql('label')}, '[a-z0-9]+'), 'flood') AND list_contains(regexp_extract_all({norm_sql('label')}, '[a-z0-9]+'), 'of') ORDER BY score DESC, canonical_id LIMIT 50")
def search_text_tokens(s: SparkSession, d: str) -> DataFrame:
    return search.Search(text="Flood  Of", order_by="relevance", limit=50).run(_proj(s, d)).select("canonical_id", "score")


@query(f"SELECT canonical_id, round(coalesce(rank, 0), 6) AS score FROM {_PROJ} WHERE contested ORDER BY score DESC, canonical_id LIMIT 500")
def search_contested(s: SparkSession, d: str) -> DataFrame:
    return search.Search(contested_only=True, limit=500).run(_proj(s, d)).select("canonical_id", "score")


@query(f"SELECT canonical_id, known_from, source_revision FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY known_from DESC, source_revision DESC) rn FROM resource_facts WHERE epoch_us(known_from) <= {KNOWN_AT}) WHERE rn = 1")
def projection_as_known(s: SparkSession, d: str) -> DataFrame:
    return search.latest_states(load(s, d, "resource_facts"), as_known_at_us=KNOWN_AT).select("canonical_id", "known_from", "source_revision")


def _hundredth(c: F.Column | str) -> F.Column:
    """Text ids whose last eight hexadecimal digits are a number divisible by 100: the queries of searches from a row."""
    return F.conv(F.right(c, F.lit(8)), 16, 10).cast("bigint") % 100 == 0


_HUNDREDTH = "regexp_matches({c}, '[0-9a-f]{{8}}$') AND TRY_CAST('0x' || right({c}, 8) AS BIGINT) % 100 = 0"


@query(f"""WITH p AS (SELECT canonical_id, list_distinct(coalesce(place_ancestors, [])) AS pa, list_distinct(coalesce(types, [])) AS ty, coalesce(rank, 0) AS rank FROM {_PROJ}), t AS (SELECT canonical_id AS target, pa AS tpa, ty AS tty FROM p WHERE {_HUNDREDTH.format(c="canonical_id")}),
x AS (SELECT target, canonical_id, round(0.4 * CASE WHEN len(pa) + len(tpa) = 0 THEN 0 ELSE len(list_intersect(pa, tpa)) / len(list_distinct(list_concat(pa, tpa))) END + 0.3 * len(list_intersect(ty, tty)) / len(list_distinct(list_concat(ty, tty))) + 0.3 * least(1.0, rank / 5), 6) AS score
FROM p, t WHERE canonical_id <> target AND (list_has_any(pa, tpa) OR list_has_any(ty, tty)))
SELECT target, canonical_id, score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, canonical_id) AS r FROM x) WHERE r <= 10""")  # fmt: skip
def similar_features(s: SparkSession, d: str) -> DataFrame:
    p = _proj(s, d)
    return search.similar_each(p, p.filter(_hundredth(F.col("canonical_id"))))


# ---- claims

# heights rest on the observations of the same thing: their sources are the evidence
_EVIDENCE = f"(SELECT DISTINCT claim_id, o.source AS root, s.origin, s.reliability, s.origin = 'ai_generated' AS ai FROM {CLAIMS} a JOIN (SELECT DISTINCT target, source FROM observations WHERE metric = 'height') o ON a.subject = o.target JOIN (SELECT DISTINCT source, origin, reliability FROM sources) s ON s.source = o.source WHERE predicate = 'height')"
_WHEN = "CASE WHEN object.kind <> 'time' THEN NULL WHEN regexp_matches(object.moment, '(\\d{4}[-/.]\\d{1,2}[-/.]\\d{1,2}|\\d年\\d{1,2}月\\d{1,2}日).*\\d{1,2}(:\\d{2}|時)') THEN 1.0 WHEN regexp_matches(object.moment, '\\d{4}[-/.]\\d{1,2}[-/.]\\d{1,2}|\\d年\\d{1,2}月\\d{1,2}日') THEN 0.85 WHEN regexp_matches(object.moment, '\\d{4}-\\d{2}$|\\d年\\d{1,2}月$') THEN 0.6 WHEN regexp_matches(object.moment, '^\\d{3,4}$|\\d年$') THEN 0.4 END"
_clip = lambda x: f"least(1.0, greatest(0.0, {x}))"
_EVAL = f"""(WITH ev AS {_EVIDENCE}, per AS (SELECT claim_id, list(DISTINCT root) AS roots, arg_min(origin, list_position(['primary', 'secondary', 'tertiary', 'user_generated', 'ai_generated'], origin)) AS origin, max(reliability) AS rel, bool_and(ai) AS ai FROM ev GROUP BY 1),
c AS (SELECT a.*, {OKEY} AS okey, coalesce(roots, ['actor:' || claim_id]) AS roots, coalesce(origin, 'unknown') AS origin, coalesce(ai, false) AS ai_only, coalesce(source_reliability, rel) AS rel, {_WHEN} AS spec FROM {CLAIMS} a LEFT JOIN per USING (claim_id) WHERE status IN ('accepted', 'proposed', 'disputed')),
n AS (SELECT subject, predicate, okey, negated, count(DISTINCT root) AS independent FROM (SELECT subject, predicate, okey, negated, unnest(roots) AS root FROM c) GROUP BY ALL),
t AS (SELECT c.*, independent, CASE WHEN independent >= 2 THEN 3 WHEN ai_only THEN 0 WHEN origin = 'primary' THEN 2 ELSE 1 END AS tier FROM c JOIN n ON c.subject IS NOT DISTINCT FROM n.subject AND c.predicate IS NOT DISTINCT FROM n.predicate AND c.okey IS NOT DISTINCT FROM n.okey AND c.negated IS NOT DISTINCT FROM n.negated)
SELECT *, tier + least(0.999999, (0.35 * {_clip("coalesce(rel, CASE origin WHEN 'primary' THEN 0.8 WHEN 'secondary' THEN 0.6 WHEN 'tertiary' THEN 0.45 ELSE 0.4 END)")} + coalesce(0.2 * {_clip("extraction_conf")}, 0) + 0.3 * least(1.0, (independent - 1) / 3.0) + coalesce(0.15 * spec, 0)) / (0.65 + CASE WHEN extraction_conf IS NULL THEN 0 ELSE 0.2 END + CASE WHEN spec IS NULL THEN 0 ELSE 0.15 END) * CASE status WHEN 'accepted' THEN 1.0 WHEN 'proposed' THEN 0.8 ELSE 0.5 END) AS rank FROM t)"""


def _evidence(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "assertions").filter("predicate = 'height'").select("claim_id", F.col("subject").alias("target")).distinct()
    o = load(s, d, "observations").filter("metric = 'height'").select("target", "source").distinct()
    src = load(s, d, "sources").select("source", "origin", "reliability").distinct()
    return c.join(o, "target").join(src, "source").select("claim_id", F.col("source").alias("root"), "origin", "reliability", F.lit(None).cast("double").alias("extraction_conf"), (F.col("origin") == "ai_generated").alias("ai"))


def _eval(s: SparkSession, d: str) -> DataFrame:
    return claims.evaluate(load(s, d, "assertions").distinct().filter(F.col("status").isin(*claims.LIVE)), evidence=_evidence(s, d))


@query(f"SELECT tier, origin, ai_only, independent, count(*) AS n FROM (SELECT CAST(tier AS BIGINT) AS tier, origin, ai_only, independent FROM {_EVAL}) GROUP BY ALL")
def rank_tiers(s: SparkSession, d: str) -> DataFrame:
    return _eval(s, d).groupBy(F.col("tier").cast("bigint").alias("tier"), "origin", "ai_only", "independent").agg(F.count("*").alias("n"))


@query(f"SELECT subject, predicate, okey, negated, max(independent) AS independent FROM {_EVAL} GROUP BY ALL")
def independent_sources(s: SparkSession, d: str) -> DataFrame:
    return _eval(s, d).groupBy("subject", "predicate", "okey", "negated").agg(F.max("independent").alias("independent"))


@query(f"SELECT claim_id, okey, independent, CAST(tier AS BIGINT) AS tier, round(rank, 6) AS rank FROM {_EVAL}")
def claims_evaluate(s: SparkSession, d: str) -> DataFrame:
    return _eval(s, d).select("claim_id", "okey", "independent", F.col("tier").cast("bigint").alias("tier"), F.round("rank", 6).alias("rank"))


_SUMMARY = f"""(SELECT subject, predicate, arg_min(claim_id, ord) FILTER (NOT negated) AS preferred, count(*) FILTER (NOT negated) AS n_values, count(DISTINCT okey) FILTER (NOT negated) AS n_distinct, count(*) FILTER (negated) AS n_negated,
(predicate IN ('occurred_at', 'start_time', 'end_time', 'coordinates', 'height', 'birth_date', 'death_date', 'publication_date', 'inception') AND count(DISTINCT okey) FILTER (NOT negated) > 1) OR coalesce(list_has_any(list(okey) FILTER (NOT negated), list(okey) FILTER (negated)), false) OR bool_or(status = 'disputed') AS contested
FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY negated, round(rank, 9) DESC, CASE status WHEN 'accepted' THEN 0 WHEN 'proposed' THEN 1 ELSE 2 END, claim_id) AS ord FROM {_EVAL}) GROUP BY subject, predicate)"""


@query(f"SELECT * FROM {_SUMMARY}")
def claims_summary(s: SparkSession, d: str) -> DataFrame:
    return claims.summarize(_eval(s, d))


@query(f"SELECT c.claim_id, c.subject, c.predicate, round(c.rank, 6) AS rank FROM {_EVAL} c JOIN {_SUMMARY} s ON c.subject = s.subject AND c.predicate = s.predicate WHERE s.contested")
def conflicts(s: SparkSession, d: str) -> DataFrame:
    e = _eval(s, d)
    return e.join(claims.summarize(e).filter("contested").select("subject", "predicate"), ["subject", "predicate"], "left_semi").select("claim_id", "subject", "predicate", F.round("rank", 6).alias("rank"))


@query(f"SELECT claim_id, status FROM {CLAIMS} WHERE status IN ('accepted', 'proposed', 'disputed') AND coalesce(visibility, 'public') = 'public' AND epoch_us(first_known_at) <= {KNOWN_AT}")
def claims_as_known(s: SparkSession, d: str) -> DataFrame:
    return claims.View(as_known_at_us=KNOWN_AT).claims(load(s, d, "assertions").distinct()).select("claim_id", "status")


@query(f"SELECT coalesce(visibility, 'public') AS visibility, status, count(*) AS n FROM {CLAIMS} WHERE status IN ('accepted', 'proposed', 'disputed', 'retracted', 'superseded') GROUP BY 1, 2")
def claims_by_visibility(s: SparkSession, d: str) -> DataFrame:
    v = claims.View(statuses=claims.STATUSES, principal=claims.Principal(system=True))
    return v.claims(load(s, d, "assertions").distinct()).groupBy(F.coalesce("visibility", F.lit("public")).alias("visibility"), "status").agg(F.count("*").alias("n"))


@query(f"SELECT subject, predicate, string_agg(claim_id, ',' ORDER BY claim_id) AS claim_ids, count(*) AS n FROM {CLAIMS} WHERE status IN ('accepted', 'proposed', 'disputed') GROUP BY 1, 2")
def claims_groups(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "assertions").distinct().filter(F.col("status").isin(*claims.LIVE))
    return c.groupBy("subject", "predicate").agg(F.concat_ws(",", F.array_sort(F.collect_list("claim_id"))).alias("claim_ids"), F.count("*").alias("n"))


@query(f"SELECT {_CANON.format(c='object.resource')} AS target, count(*) AS incoming, count(DISTINCT subject) AS subjects FROM {CLAIMS} WHERE object.kind = 'resource' AND status IN ('accepted', 'proposed', 'disputed') AND object.resource IS NOT NULL GROUP BY 1")
def claims_incoming(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "assertions").distinct().filter(F.col("status").isin(*claims.LIVE) & (F.col("object.kind") == "resource") & F.col("object.resource").isNotNull())
    return c.groupBy(canonical_id(F.col("object.resource")).alias("target")).agg(F.count("*").alias("incoming"), F.countDistinct("subject").alias("subjects"))


@query(f"SELECT claim_id FROM {CLAIMS} a WHERE predicate = 'possibly_same_as' AND status IN ('accepted', 'proposed', 'disputed') AND NOT coalesce(negated, false) AND NOT EXISTS (SELECT 1 FROM merges m WHERE m.from_id = a.subject AND m.into_id = a.object.resource) AND NOT EXISTS (SELECT 1 FROM merges m WHERE m.into_id = a.subject AND m.from_id = a.object.resource)")
def merge_candidates(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "assertions").distinct().filter((F.col("predicate") == "possibly_same_as") & F.col("status").isin(*claims.LIVE) & ~F.coalesce("negated", F.lit(False)))
    m = load(s, d, "merges").select("from_id", "into_id")
    both = m.unionByName(m.select(F.col("into_id").alias("from_id"), F.col("from_id").alias("into_id"))).distinct()
    return c.join(both, (c["subject"] == both["from_id"]) & (c["object.resource"] == both["into_id"]), "left_anti").select("claim_id")


# ---- graph


@query("""WITH RECURSIVE e AS (SELECT DISTINCT place_id AS node, unnest(parents) AS up FROM gazetteer), w AS (SELECT node, up AS above FROM e WHERE up IS NOT NULL UNION SELECT w.node, e.up FROM w JOIN e ON e.node = w.above WHERE e.up IS NOT NULL)
SELECT node, above FROM w WHERE node <> above""")  # fmt: skip
def place_closure(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "gazetteer").select(F.col("place_id").alias("node"), F.explode("parents").alias("up"))
    return graph.closure(e, reflexive=False).select("node", "above")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT type_key AS node, unnest(parents) AS up FROM type_defs), w AS (SELECT node, up AS above FROM e WHERE up IS NOT NULL UNION SELECT w.node, e.up FROM w JOIN e ON e.node = w.above WHERE e.up IS NOT NULL)
SELECT node, above FROM w WHERE node <> above""")  # fmt: skip
def type_closure(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "type_defs").select(F.col("type_key").alias("node"), F.explode("parents").alias("up"))
    return graph.closure(e, reflexive=False).select("node", "above")


@query("""WITH RECURSIVE b AS (SELECT branch_id, any_value(parent) AS parent, any_value(fork_seq) AS fork_seq FROM branches GROUP BY 1), w AS (SELECT branch_id, branch_id AS member, 0 AS k, CAST(NULL AS BIGINT) AS seq_limit FROM b
UNION ALL SELECT w.branch_id, b.parent, k + 1, least(w.seq_limit, b.fork_seq) FROM w JOIN b ON b.branch_id = w.member WHERE b.parent IN (SELECT branch_id FROM b) AND k < 64)
SELECT branch_id, member, CAST(min(k) AS BIGINT) AS position, first(seq_limit ORDER BY k) AS seq_limit FROM w GROUP BY 1, 2""")  # fmt: skip
def branch_chain(s: SparkSession, d: str) -> DataFrame:
    return graph.branch_chains(load(s, d, "branches"))


_EDGES = f"(SELECT DISTINCT {_CANON.format(c='subject')} AS src, {_CANON.format(c='object.resource')} AS dst, predicate FROM {CLAIMS} WHERE object.kind = 'resource' AND status IN ('accepted', 'proposed', 'disputed') AND subject IS NOT NULL AND object.resource IS NOT NULL)"


def _edges(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "assertions").filter(F.col("status").isin(*claims.LIVE) & (F.col("object.kind") == "resource") & F.col("subject").isNotNull() & F.col("object.resource").isNotNull())
    return c.select(canonical_id(F.col("subject")).alias("src"), canonical_id(F.col("object.resource")).alias("dst"), "predicate").distinct()


@query(f"WITH e AS (SELECT * FROM {_EDGES}), s AS (SELECT DISTINCT src AS n FROM e WHERE {_HUNDREDTH.format(c='src')}), a AS (SELECT n, src, dst, predicate FROM e JOIN s ON src = n OR dst = n), f AS (SELECT n, src AS m FROM a UNION SELECT n, dst FROM a) SELECT DISTINCT f.n AS start, e.src, e.dst, e.predicate FROM e JOIN f ON e.src = f.m OR e.dst = f.m")
def neighbors_depth2(s: SparkSession, d: str) -> DataFrame:
    e = _edges(s, d)
    starts = e.filter(F.col("src").rlike("[0-9a-f]{8}$")).filter(_hundredth(F.col("src"))).select(F.col("src").alias("node")).distinct()
    return graph.neighbours_each(e, starts, depth=2).select("start", "src", "dst", "predicate")


_CAUSES = f"(SELECT src, dst FROM {_EDGES} WHERE predicate = 'causes')"


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_CAUSES}), reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst),
bad AS (SELECT src AS node FROM reach WHERE src = dst UNION SELECT r.dst FROM reach r JOIN reach c ON c.src = r.src AND c.src = c.dst), nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e), good AS (SELECT * FROM nodes EXCEPT SELECT * FROM bad),
w AS (SELECT node, 0 AS level FROM good UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON e.src = w.node JOIN good g ON g.node = e.dst)
SELECT node, CAST(max(level) AS INTEGER) AS level FROM w GROUP BY 1""")  # fmt: skip
def order_graph_levels(s: SparkSession, d: str) -> DataFrame:
    return graph.order_levels(_edges(s, d).filter("predicate = 'causes'"))


# ---- intervals, Allen


def _spans(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as day intervals, shipments as fuzzy ones from the first to the last shipping day."""
    o = load(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), tick(F.col("o_orderdate")).alias("s")).withColumn("e", F.col("s") + DAY)
    t = tick(F.col("l_shipdate"))
    li = load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min(t).alias("a"), F.max(t).alias("b"))
    return o, li


_SHIP = "(SELECT l_orderkey AS k, min(epoch_ms(l_shipdate)) AS a, max(epoch_ms(l_shipdate)) AS b FROM lineitem GROUP BY 1)"
_ORD = f"(SELECT o_orderkey AS k, o_custkey AS c, epoch_ms(o_orderdate) AS s, epoch_ms(o_orderdate) + {DAY} AS e FROM orders)"


def _allen_sql(s1: str, e1: str, s2: str, e2: str) -> str:
    at = {"s1": s1, "e1": e1, "s2": s2, "e2": e2}
    cases = []
    for n, order in allen.ORDERS.items():
        g = [x.split() for x in order]
        tests = [f"{at[a]} = {at[b]}" for x in g for a, b in zip(x, x[1:], strict=False)] + [f"{at[x[0]]} < {at[y[0]]}" for x, y in zip(g, g[1:], strict=False)]
        cases.append(f"WHEN {' AND '.join(tests)} THEN '{n}'")
    return f"CASE {' '.join(cases)} END"


@query(f"SELECT relation, count(*) AS n FROM (SELECT {_allen_sql('o.s', 'o.e', 'x.a', f'(x.b + {DAY})')} AS relation FROM {_ORD} o JOIN {_SHIP} x USING (k)) GROUP BY 1")
def allen_relations(s: SparkSession, d: str) -> DataFrame:
    o, x = _spans(s, d)
    return o.join(x, "k").select(allen.relation(F.col("s"), F.col("e"), F.col("a"), F.col("b") + DAY).alias("relation")).groupBy("relation").agg(F.count("*").alias("n"))


def _mask_sql(a: dict[str, str]) -> str:
    out = []
    for bit, order in enumerate(allen.ORDERS.values()):
        at, tests = None, []
        for g in order:
            ends = g.split()
            lo = f"greatest({', '.join(a['lo_' + e] for e in ends)})" if len(ends) > 1 else a["lo_" + ends[0]]
            hi = f"least({', '.join(a['hi_' + e] for e in ends)})" if len(ends) > 1 else a["hi_" + ends[0]]
            at = lo if at is None else f"greatest({lo}, {at} + 1)"
            tests.append(f"{at} <= {hi}")
        out.append(f"CASE WHEN {' AND '.join(tests)} THEN {1 << bit} ELSE 0 END")
    return " + ".join(out)


_FZ = {"lo_s1": "s", "hi_s1": "s", "lo_e1": "e", "hi_e1": "e", "lo_s2": "a", "hi_s2": f"least(a + {DAY}, b + {DAY})", "lo_e2": "b", "hi_e2": f"(b + {DAY})"}


@query(f"SELECT CAST({_mask_sql(_FZ)} AS BIGINT) AS mask, count(*) AS n FROM {_ORD} o JOIN {_SHIP} x USING (k) GROUP BY 1")
def allen_fuzzy_possible(s: SparkSession, d: str) -> DataFrame:
    o, x = _spans(s, d)
    a, b = fuzzy.exact(F.col("s"), F.col("e")), fuzzy.fuzzy(F.col("a"), F.col("a") + DAY, F.col("b"), F.col("b") + DAY)
    return o.join(x, "k").select(allen.possible_mask(a, b).cast("bigint").alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT i.i AS s, j.j AS e FROM range(6) i(i), range(6) j(j) WHERE i.i < j.j), r AS (SELECT a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2, {_allen_sql("a.s", "a.e", "b.s", "b.e")} AS rel FROM p a, p b)
SELECT x.rel AS "first", y.rel AS "second", CAST(bit_or(1 << (list_position({allen.RELATIONS!r}, z.rel) - 1)) AS INTEGER) AS mask FROM r x JOIN r y ON x.s2 = y.s1 AND x.e2 = y.e1 JOIN r z ON z.s1 = x.s1 AND z.e1 = x.e1 AND z.s2 = y.s2 AND z.e2 = y.e2 GROUP BY 1, 2""")  # fmt: skip
def allen_composition(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(a, b, m) for (a, b), m in allen.composition().items()], "first string, second string, mask int")


_INF = 2**63 - 1


@query(f"""WITH w AS (SELECT o_orderkey AS k, epoch_ms(o_orderdate) AS o, o_orderstatus AS st, x.a, x.b FROM orders LEFT JOIN {_SHIP} x ON x.k = o_orderkey), p AS (SELECT k, o, CASE WHEN st = 'P' THEN NULL ELSE a END AS a, CASE WHEN st = 'O' THEN NULL ELSE b END AS b, st, (SELECT count(*) FROM orders) AS n FROM w)
SELECT CAST(k AS VARCHAR) AS subject, CASE WHEN k % 5 = 0 THEN o ELSE coalesce(a, -{_INF} - 1) END AS es, CASE WHEN k % 5 = 0 THEN o ELSE least(coalesce(b + {DAY}, {_INF}), coalesce(a + {DAY}, {_INF})) END AS ls,
CASE WHEN k % 5 = 0 THEN o + {DAY} ELSE greatest(coalesce(a, -{_INF} - 1), coalesce(b, -{_INF} - 1)) END AS ee, CASE WHEN k % 5 = 0 THEN o + {DAY} ELSE coalesce(b + {DAY}, {_INF}) END AS le FROM p WHERE k % 5 = 0 OR a IS NOT NULL OR b IS NOT NULL""")  # fmt: skip
def time_from_start_end(s: SparkSession, d: str) -> DataFrame:
    """Shipments as events: an order in five has a time of its own, the others a start (not of orders with status P), an end (not with O), or both."""
    o = load(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("st"), tick(F.col("o_orderdate")).alias("o"))
    _, x = _spans(s, d)
    j = o.join(x, "k", "left")
    told = lambda cond, p, t: F.when(cond & F.col(t).isNotNull(), F.struct(F.lit(p).alias("predicate"), F.col(t).alias("t")))
    every = F.array(told(F.col("k") % 5 == 0, "occurred_at", "o"), told(F.col("st") != "P", "start_time", "a"), told(F.col("st") != "O", "end_time", "b"))
    c = j.select(F.col("k").cast("string").alias("subject"), F.explode(F.filter(every, lambda e: e.isNotNull())).alias("c")).select("subject", "c.predicate", F.concat_ws(":", "subject", "c.predicate").alias("claim_id"), F.lit(False).alias("negated"), F.lit(1.0).alias("rank"), F.lit("gregorian").alias("axis"), *[F.col("c.t").alias(n) for n in ("es", "ls")], *[(F.col("c.t") + DAY).alias(n) for n in ("ee", "le")])
    return claims.event_times(c).select("subject", "time.es", "time.ls", "time.ee", "time.le")


_QS, _QE = 852_076_800_000, 860_000_000_000  # a window of 1997


@query(f"SELECT k, a < {_QE} AND b + {DAY} > {_QS} AS possibly, least(a + {DAY}, b + {DAY}) < {_QE} AND b > {_QS} AS certainly, a >= {_QS} AND b + {DAY} <= {_QE} AS lies_within FROM {_SHIP}")
def search_time_modes(s: SparkSession, d: str) -> DataFrame:
    _, x = _spans(s, d)
    r, qs, qe = F.col("r"), F.lit(_QS), F.lit(_QE)
    x = x.withColumn("r", fuzzy.fuzzy(F.col("a"), F.col("a") + DAY, F.col("b"), F.col("b") + DAY))
    return x.select("k", fuzzy.possibly_overlaps(r, qs, qe).alias("possibly"), fuzzy.certainly_overlaps(r, qs, qe).alias("certainly"), fuzzy.lies_within(r, qs, qe).alias("lies_within"))


@query(f"SELECT CASE WHEN w <= {7 * DAY} THEN CASE WHEN w <= {DAY} THEN 'day' ELSE 'week' END WHEN w <= {31 * DAY} THEN 'month' WHEN w <= {92 * DAY} THEN 'season' WHEN w <= {366 * DAY} THEN 'year' WHEN w <= {3653 * DAY} THEN 'decade' ELSE 'century' END AS granularity, count(*) AS n FROM (SELECT b + {DAY} - a AS w FROM {_SHIP}) GROUP BY 1")
def time_granularity(s: SparkSession, d: str) -> DataFrame:
    _, x = _spans(s, d)
    return x.select(fuzzy.granularity(fuzzy.fuzzy(F.col("a"), F.col("a") + DAY, F.col("b"), F.col("b") + DAY)).alias("granularity")).groupBy("granularity").agg(F.count("*").alias("n"))


@query(f"""WITH o AS {_ORD}, r AS (SELECT k, a AS s, b + {DAY} AS e FROM {_SHIP}), st AS (SELECT s AS t, sum(count(*)) OVER (ORDER BY s) AS n FROM o GROUP BY s), en AS (SELECT e AS t, sum(count(*)) OVER (ORDER BY e) AS n FROM o GROUP BY e)
SELECT k AS r_k, CAST(coalesce(st.n, 0) - coalesce(en.n, 0) AS BIGINT) AS n FROM r ASOF LEFT JOIN st ON st.t < r.e ASOF LEFT JOIN en ON en.t <= r.s WHERE coalesce(st.n, 0) > coalesce(en.n, 0)""")  # fmt: skip
def interval_overlap_join(s: SparkSession, d: str) -> DataFrame:
    o, x = _spans(s, d)
    right = x.select("k", F.col("a").alias("s"), (F.col("b") + DAY).alias("e"))
    return intervals.overlap_counts(o, right).select(F.col("k").alias("r_k"), "n")


_BOX = f"(SELECT canonical_id AS id, placement.minx AS minx, placement.miny AS miny, placement.maxx AS maxx, placement.maxy AS maxy FROM {LATEST} WHERE placement.frame = 'wgs84')"


@query(f"SELECT a.id AS l_id, b.id AS r_id FROM {_BOX} a JOIN {_BOX} b ON a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy WHERE a.minx < a.maxx AND b.minx = b.maxx")
def grid_spatial_join(s: SparkSession, d: str) -> DataFrame:
    p = search.latest_states(load(s, d, "resource_facts")).filter("placement.frame = 'wgs84'").select(F.col("canonical_id").alias("id"), "placement.minx", "placement.miny", "placement.maxx", "placement.maxy")
    boxes, points, wide = p.filter("minx < maxx"), p.filter("minx = maxx"), F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")) >= 5
    # wide boxes are kept under larger cells, so that none has very many
    fine, coarse = (intervals.grid_overlap_join(boxes.filter(of), points, cell=cell) for of, cell in ((~wide, 5.0), (wide, 60.0)))
    return fine.unionByName(coarse).select("l_id", "r_id")


# ---- observations, positions, recurrence

OBS = "(SELECT DISTINCT * FROM observations)"


@query(f"SELECT metric, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(30, 6))) AS DOUBLE) / count(value), 4) AS mean, min(value) AS least, max(value) AS greatest FROM {OBS} WHERE epoch_us(observed_at) >= 1546300800000000 AND epoch_us(observed_at) < 1577836800000000 AND epoch_us(coalesce(recorded_at, observed_at)) <= 1577836800000000 GROUP BY 1")
def observations_range(s: SparkSession, d: str) -> DataFrame:
    o = series.observations_between(load(s, d, "observations"), start_us=1_546_300_800_000_000, end_us=1_577_836_800_000_000, as_known_at_us=1_577_836_800_000_000)
    return o.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(28, 6)")).cast("double") / F.count("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("greatest"))


@query(f"SELECT target, metric, obs_id, value FROM (SELECT *, row_number() OVER (PARTITION BY target, metric ORDER BY observed_at DESC, obs_id DESC) rn FROM {OBS} WHERE target IS NOT NULL AND epoch_us(observed_at) <= {KNOWN_AT}) WHERE rn = 1")
def observations_latest(s: SparkSession, d: str) -> DataFrame:
    return series.latest(load(s, d, "observations").select("target", "metric", "obs_id", "value", "observed_at"), at_us=KNOWN_AT)


_T = 1_705_276_800_000  # 2024-01-15T00:00Z


@query(f"""WITH x AS (SELECT user_id, epoch_us(ts) // 1000 AS t, value AS v FROM events), a AS (SELECT user_id, max(t) AS ta, arg_max(v, (t, v)) AS va FROM x WHERE t <= {_T} GROUP BY 1), b AS (SELECT user_id, min(t) AS tb, arg_min(v, (t, v)) AS vb FROM x WHERE t >= {_T} GROUP BY 1)
SELECT a.user_id AS target, round(CASE WHEN ta = tb THEN va ELSE va + (vb - va) * ({_T} - ta) / (tb - ta) END, 6) AS x FROM a JOIN b USING (user_id)""")  # fmt: skip
def asof_position(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events").select(F.col("user_id").alias("target"), tick(F.col("ts")).alias("t"), F.col("value").alias("x"))
    return series.position_at(e, _T).select("target", F.round("x", 6).alias("x"))


@query(f"SELECT user_id AS target, arg_max(value, (epoch_ms(ts), value)) AS x FROM events WHERE epoch_ms(ts) <= {_T} AND user_id IN (SELECT user_id FROM events WHERE epoch_ms(ts) >= {_T}) GROUP BY 1")
def asof_position_step(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events").select(F.col("user_id").alias("target"), tick(F.col("ts")).alias("t"), F.col("value").alias("x"))
    return series.position_at(e, _T, how="step")


_FIRST_FRI = "((a - 27000000 + 86399999) // 86400000)"  # first day whose 16:30 at UTC+9 is not before the interval, then the last one in it
_LAST_FRI = "((e - 27000000 + 86399999) // 86400000 - 1)"


@query(f"SELECT k, CAST(n AS BIGINT) AS n FROM (SELECT k, ({_LAST_FRI} + 6) // 7 - ({_FIRST_FRI} + 5) // 7 AS n FROM (SELECT k, a, b + {DAY} AS e FROM {_SHIP})) WHERE n > 0")
def recurrence_occurrences(s: SparkSession, d: str) -> DataFrame:
    """Fridays 16:30 at UTC+9 in each shipment's interval; day 1 after the epoch is a Friday."""
    _, x = _spans(s, d)
    return x.select("k", F.size(series.weekly_occurrences(F.col("a"), F.col("b") + DAY, 4, 59_400_000, 32_400_000)).cast("bigint").alias("n")).filter("n > 0")


@query("SELECT CAST((epoch_ms(ts) // 86400000 + 3) % 7 AS BIGINT) AS weekday, count(*) AS n FROM events GROUP BY 1")
def weekday_counts(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events").groupBy(weekday(tick(F.col("ts"))).cast("bigint").alias("weekday")).agg(F.count("*").alias("n"))


# ---- history: events of a user as a conversation, event_id as sequence number

_HIST = "(SELECT user_id, event_id AS seq, ts, event_type FROM events)"


def _hist(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events").select("user_id", F.col("event_id").alias("seq"), "ts", "event_type")


@query(f"SELECT user_id, count(DISTINCT seq) AS events, min(seq) AS first_sequence, max(seq) AS last_sequence, min(ts) AS first_at, max(ts) AS last_at, max(seq) - min(seq) + 1 - count(DISTINCT seq) AS missing FROM {_HIST} GROUP BY 1")
def history_conversations(s: SparkSession, d: str) -> DataFrame:
    return series.conversation_stats(_hist(s, d), key="user_id", seq="seq", at="ts")


@query(f"SELECT user_id, seq AS after, seq + 1 AS missing_from, nxt - 1 AS missing_to FROM (SELECT user_id, seq, lead(seq) OVER (PARTITION BY user_id ORDER BY seq) AS nxt FROM (SELECT DISTINCT user_id, seq FROM {_HIST})) WHERE nxt > seq + 1")
def history_gaps(s: SparkSession, d: str) -> DataFrame:
    return series.gaps(_hist(s, d), key="user_id", seq="seq")


@query("""WITH x AS (SELECT user_id, event_id FROM events), a AS (SELECT user_id, CAST(quantile_disc(event_id, 0.5) AS BIGINT) AS anchor FROM x GROUP BY 1), r AS (SELECT x.user_id, event_id, anchor, row_number() OVER (PARTITION BY x.user_id, sign(event_id - anchor) ORDER BY abs(event_id - anchor)) AS k FROM x JOIN a USING (user_id))
SELECT user_id, event_id FROM r WHERE event_id = anchor OR k <= 5""")  # fmt: skip
def history_context(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events").select("user_id", "event_id")
    n = W.partitionBy("user_id")
    mid = e.withColumn("_k", F.row_number().over(n.orderBy("event_id"))).withColumn("_n", F.count("*").over(n)).filter(F.col("_k") == F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.5)))
    return series.context(e, key="user_id", seq="event_id", anchors=mid.select("user_id", F.col("event_id").alias("anchor"))).select("user_id", "event_id")


@query(f"SELECT doc_id, CAST(instr({norm_sql('text')}, 'museum') AS BIGINT) AS at FROM documents WHERE contains({norm_sql('text')}, 'museum') AND contains({norm_sql('text')}, 'harbour')")
def history_search_text(s: SparkSession, d: str) -> DataFrame:
    n = text.normalize_label(F.col("text"))
    return load(s, d, "documents").select("doc_id", n.alias("n")).filter("contains(n, 'museum') and contains(n, 'harbour')").select("doc_id", F.instr("n", "museum").cast("bigint").alias("at"))


@query("SELECT doc_id, CAST(instr(text, 'Glocken') AS BIGINT) AS at FROM documents WHERE contains(text, 'Glocken')")
def history_search_exact(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").filter(F.contains("text", F.lit("Glocken"))).select("doc_id", F.instr("text", "Glocken").cast("bigint").alias("at"))


@query("SELECT event_id, user_id FROM events WHERE (ts, event_id) < ((SELECT max(ts) FROM events) - INTERVAL 3 DAY, 0) ORDER BY ts DESC, event_id DESC LIMIT 50")
def history_cursor_page(s: SparkSession, d: str) -> DataFrame:
    """A page of 50 before a cursor (time, id), newest first."""
    e = load(s, d, "events").select("event_id", "user_id", "ts")
    until = e.agg((F.max("ts") - F.expr("interval 3 days")).alias("u"))
    return e.join(F.broadcast(until), F.struct("ts", "event_id") < F.struct("u", F.lit(0).cast("bigint"))).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id")


@query("SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def snapshot_dedup(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))


# ---- provenance, tables, vocabulary, exports


@query("SELECT d.doc_id, s.source_id, s.kind AS source_kind, s.origin, coalesce(d.license, s.license) AS license, coalesce(d.license, s.license) IN ('CC0-1.0', 'CC-BY-4.0', 'CC-BY-SA-4.0') IS NOT TRUE AS withheld FROM documents d LEFT JOIN (SELECT DISTINCT * FROM sources) s ON d.source = s.source")
def provenance_chain(s: SparkSession, d: str) -> DataFrame:
    src = load(s, d, "sources").select("source_id", "source", F.col("kind").alias("source_kind"), F.col("origin").alias("_o"), F.col("license").alias("_l")).distinct()
    j = load(s, d, "documents").select("doc_id", "source", "license").join(src, "source", "left")
    lic = F.coalesce("license", "_l")
    return j.select("doc_id", "source_id", "source_kind", F.col("_o").alias("origin"), lic.alias("license"), (~F.coalesce(lic.isin("CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0"), F.lit(False))).alias("withheld"))


@query("SELECT source_revision, canonical_id FROM resource_facts ORDER BY source_revision DESC, canonical_id LIMIT 20")
def revisions_tail(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "resource_facts").select("source_revision", "canonical_id").orderBy(F.desc("source_revision"), "canonical_id").limit(20)


@query("SELECT max(source_revision) AS head, max(source_revision) FILTER (materialized_at IS NOT NULL) AS materialized, count(*) FILTER (stale) AS stale_rows, count(*) FILTER (stale) = 0 AS consistent FROM (SELECT DISTINCT source_revision, materialized_at, stale FROM resource_facts)")
def freshness(s: SparkSession, d: str) -> DataFrame:
    f = load(s, d, "resource_facts").select("source_revision", "materialized_at", "stale").distinct()
    n = F.coalesce(F.sum(F.col("stale").cast("bigint")), F.lit(0).cast("bigint"))
    return f.agg(F.max("source_revision").alias("head"), F.max(F.when(F.col("materialized_at").isNotNull(), F.col("source_revision"))).alias("materialized"), n.alias("stale_rows"), (n == 0).alias("consistent"))


@query("SELECT concat_ws('|', l_orderkey, l_linenumber) AS row_key, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1")
def table_rows(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "lineitem").groupBy(F.concat_ws("|", "l_orderkey", "l_linenumber").alias("row_key")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT type_key, max(label) AS label, CAST(max(coalesce(len(parents), 0)) AS BIGINT) AS n_parents FROM type_defs GROUP BY 1")
def vocabulary(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "type_defs").groupBy("type_key").agg(F.max("label").alias("label"), F.max(F.coalesce(F.when(F.col("parents").isNotNull(), F.size("parents")), F.lit(0))).cast("bigint").alias("n_parents"))


_ESC = "replace(replace(replace({c}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n')"


@query(f"SELECT DISTINCT '<urn:' || resource_id || '> <http://www.w3.org/2000/01/rdf-schema#label> \"' || {_ESC.format(c='label')} || '\" .' AS line FROM {RES} WHERE coalesce(visibility, 'public') = 'public' AND (license IS NULL OR license IN ('CC0-1.0', 'CC-BY-4.0', 'CC-BY-SA-4.0')) AND label IS NOT NULL")
def export_ntriples(s: SparkSession, d: str) -> DataFrame:
    r = _res(s, d).filter("coalesce(visibility, 'public') = 'public' and (license is null or license in ('CC0-1.0', 'CC-BY-4.0', 'CC-BY-SA-4.0')) and label is not null")
    esc = F.replace(F.replace(F.replace(F.col("label"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return r.select(F.concat(F.lit("<urn:"), "resource_id", F.lit('> <http://www.w3.org/2000/01/rdf-schema#label> "'), esc, F.lit('" .')).alias("line")).distinct()


# ---- text, vectors


_runs = lambda pattern: f"regexp_extract_all(regexp_replace({norm_sql('label')}, '[^\\p{{L}}\\p{{N}}]', ' ', 'g'), '{pattern}')"
_PAIRS = "CASE WHEN length(r) < 2 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) END"
_LABELS = "(SELECT DISTINCT resource_id, trim(label) AS label FROM resources)"


@query(f"SELECT resource_id, array_to_string(list_sort(list_distinct(flatten(list_transform({_runs('[a-z0-9]+|[^a-z0-9 ]+')}, lambda r: CASE WHEN regexp_matches(r, '^[a-z0-9]') THEN [r] ELSE {_PAIRS} END)))), ' ') AS words FROM {_LABELS} WHERE label IS NOT NULL")
def label_tokens(s: SparkSession, d: str) -> DataFrame:
    r = _res(s, d).select("resource_id", "label").distinct().filter("label is not null")
    return r.select("resource_id", F.concat_ws(" ", F.array_sort(F.array_distinct(text.tokens(F.col("label"))))).alias("words"))


@query(f"SELECT resource_id, array_to_string(list_sort(list_distinct(flatten(list_transform({_runs('[^ ]+')}, lambda r: {_PAIRS})))), ' ') AS grams FROM {_LABELS} WHERE label IS NOT NULL")
def label_grams(s: SparkSession, d: str) -> DataFrame:
    r = _res(s, d).select("resource_id", "label").distinct().filter("label is not null")
    return r.select("resource_id", F.concat_ws(" ", text.grams(F.col("label"))).alias("grams"))


# the queries of vector searches are the rows with vec_id divisible by 100
_PAIR = "embeddings v, (SELECT vec_id AS query_id, embedding AS q, label AS q_label FROM embeddings WHERE vec_id % 100 = 0) w"
_DOT = "list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))"
_HAM = "CAST(list_sum(list_transform(list_zip(embedding, q), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END)) AS BIGINT)"


def _asked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    e = load(s, d, "embeddings")
    return e, e.filter("vec_id % 100 = 0"), len(e.select("embedding").first()[0])


@query(f"SELECT query_id, vec_id, round(x, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 12) DESC, vec_id) AS r FROM (SELECT query_id, vec_id, {_DOT} AS x FROM {_PAIR})) WHERE r <= 10")
def vector_topk_exact(s: SparkSession, d: str) -> DataFrame:
    e, q, dims = _asked(s, d)
    return vectors.nearest_each(e, q, 10, dims).withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, vec_id, round(x, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 12) DESC, vec_id) AS r FROM (SELECT query_id, vec_id, {_DOT} AS x FROM {_PAIR} WHERE label = q_label)) WHERE r <= 10")
def vector_filtered(s: SparkSession, d: str) -> DataFrame:
    """Among the rows with the query's label."""
    e, q, dims = _asked(s, d)
    return vectors.nearest_each(e, q, 10, dims, same="label").withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM (SELECT query_id, vec_id, {_HAM} AS distance FROM {_PAIR})) WHERE r <= 50")
def vector_hamming(s: SparkSession, d: str) -> DataFrame:
    e, q, dims = _asked(s, d)
    return vectors.nearest_each(e, q, 50, dims, by="hamming").select("query_id", "vec_id", F.col("score").cast("bigint").alias("distance"))


@query(f"""WITH h AS (SELECT query_id, vec_id, {_HAM} AS h, {_DOT} AS x FROM {_PAIR}), c AS (SELECT query_id, h, sum(count(*)) OVER (PARTITION BY query_id ORDER BY h) AS upto, sum(count(*)) OVER (PARTITION BY query_id) AS n FROM h GROUP BY query_id, h),
b AS (SELECT query_id, min(h) AS bound FROM c WHERE upto >= least(n, greatest(160, ceil(n * 0.3))) GROUP BY 1)
SELECT query_id, vec_id, round(x, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, vec_id) AS r FROM h JOIN b USING (query_id) WHERE h <= bound) WHERE r <= 10""")  # fmt: skip
def vector_topk_by_code(s: SparkSession, d: str) -> DataFrame:
    """The rows with vec_id divisible by 100 as queries."""
    e, q, dims = _asked(s, d)
    return vectors.top_k_by_code_each(e, q, 10, dims).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("SELECT canonical_id, round(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(51.5 - placement.miny) / 2), 2) + cos(radians(placement.miny)) * cos(radians(51.5)) * pow(sin(radians(0 - placement.minx) / 2), 2)))) / 1000, 3) AS km FROM (SELECT DISTINCT canonical_id, placement FROM resource_facts) WHERE placement.frame = 'wgs84' AND placement.minx = placement.maxx")
def distance_from_point(s: SparkSession, d: str) -> DataFrame:
    f = load(s, d, "resource_facts").select("canonical_id", "placement").distinct().filter("placement.frame = 'wgs84' and placement.minx = placement.maxx")
    return f.select("canonical_id", F.round(geo.haversine_m(F.col("placement.minx"), F.col("placement.miny"), F.lit(0.0), F.lit(51.5)) / 1000, 3).alias("km"))


# ---- extraction, time expressions


@query(f"""WITH m AS (SELECT mention_id, any_value({norm_sql('label')}) AS norm, any_value(coalesce(types, [])) AS mt FROM entity_mentions GROUP BY 1),
r AS (SELECT DISTINCT resource_id, rt, {norm_sql('l')} AS norm FROM (SELECT resource_id, coalesce(types, []) AS rt, unnest(list_concat([label], coalesce(aliases, []))) AS l FROM resources) WHERE l IS NOT NULL),
h AS (SELECT mention_id, count(DISTINCT resource_id) AS c, min(resource_id) AS f FROM m JOIN r USING (norm) WHERE NOT list_contains(mt, 'Event') AND (list_has_any(mt, rt) OR list_contains(mt, 'Entity')) GROUP BY 1)
SELECT mention_id, coalesce(c, 0) AS candidates, CASE coalesce(c, 0) WHEN 0 THEN 'new' WHEN 1 THEN 'existing' ELSE 'ambiguous' END AS decision, CASE WHEN c = 1 THEN f END AS resource FROM m LEFT JOIN h USING (mention_id)""")  # fmt: skip
def extract_link_decisions(s: SparkSession, d: str) -> DataFrame:
    return extract.link_decisions(load(s, d, "entity_mentions"), load(s, d, "resources"))


@query("SELECT doc_id, mention_ref, problem FROM (SELECT doc_id, mention_ref, 'repeated' AS problem FROM (SELECT DISTINCT * FROM entity_mentions) GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT doc_id, mention_ref, 'no label' FROM (SELECT DISTINCT * FROM entity_mentions) WHERE label IS NULL OR trim(label) = '' UNION ALL SELECT doc_id, mention_ref, 'bad span' FROM (SELECT DISTINCT * FROM entity_mentions) WHERE span_start >= span_end OR span_start < 0 UNION ALL SELECT doc_id, mention_ref, 'no wording' FROM (SELECT DISTINCT * FROM entity_mentions) WHERE mention IS NULL UNION ALL SELECT doc_id, mention_ref, 'no span' FROM (SELECT DISTINCT * FROM entity_mentions) WHERE span_start IS NULL)")
def extract_validate(s: SparkSession, d: str) -> DataFrame:
    return extract.validate_mentions(load(s, d, "entity_mentions"))


@query()
def extract_gazetteer(s: SparkSession, d: str) -> DataFrame:
    return extract.gazetteer_mentions(load(s, d, "documents"), load(s, d, "gazetteer"))


@query()
def extract_times(s: SparkSession, d: str) -> DataFrame:
    return extract.time_mentions(load(s, d, "documents"))


@query()
def temporal_parse_corpus(s: SparkSession, d: str) -> DataFrame:
    """Every different valid_time, parsed once."""
    t = load(s, d, "assertions").select(F.col("valid_time").alias("raw")).distinct()
    return t.select("raw", tt.resolve_temporal(F.col("raw"), F.lit(None).cast("bigint"), F.lit(0)).alias("p")).select("raw", "p.*")
