"""Queries of the general training-data problems over the tables of a scale directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.operators.asof import as_of_join
from almagest.operators.hierarchy import descendants, resolve_hierarchy
from almagest.operators.spatial import neighbours_and_regions
from almagest.operators.timestamps import moments, with_utc_micros
from almagest.operators.units import to_common_units
from almagest.sources.tables import load

CANONICAL_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def common_units(spark: SparkSession, d: str) -> DataFrame:
    return to_common_units(load(spark, d, "observations"), load(spark, d, "metric_units"), load(spark, d, "sources"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return common_units(spark, d).filter("recorded_otherwise").select("obs_id", F.round(F.col("common_value") * 100).cast("bigint").alias("common_x100"))


def p1_metric_report(spark: SparkSession, d: str) -> DataFrame:
    """Per metric: observations with a figure, those in an unknown unit, those recorded in another unit, and the range of the common values."""
    v = F.round("common_value", 4)
    return common_units(spark, d).groupBy("metric", "common_unit").agg(F.count("*").alias("n"), F.count_if(F.col("common_value").isNull()).alias("n_unknown"), F.sum(F.col("recorded_otherwise").cast("bigint")).alias("n_converted"), F.min(v).alias("least"), F.max(v).alias("greatest"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours_and_regions(load(spark, d, "resource_facts"), within_m=250.0)


def all_moments(spark: SparkSession, d: str) -> DataFrame:
    docs = moments(load(spark, d, "documents"), "doc_id", ["published", "acquired_at"])
    return docs.unionByName(moments(load(spark, d, "assertions"), "claim_id", ["valid_time"]))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return all_moments(spark, d).filter(F.col("utc_ms").isNotNull() & ~F.col("text").rlike(CANONICAL_TIME)).select("record_id", "field", "utc_ms").distinct()


def forest_links(spark: SparkSession, d: str) -> DataFrame:
    """(forest, node, parents) of branches, type definitions and the gazetteer."""
    b = load(spark, d, "branches").select(F.lit("branches").alias("forest"), F.col("branch_id").alias("node"), F.array("parent").alias("parents"))
    t = load(spark, d, "type_defs").select(F.lit("type_defs").alias("forest"), F.col("type_key").alias("node"), "parents")
    g = load(spark, d, "gazetteer").select(F.lit("gazetteer").alias("forest"), F.col("place_id").alias("node"), "parents")
    return b.unionByName(t).unionByName(g)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return resolve_hierarchy(forest_links(spark, d)).select("forest", "node", "root", "depth")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    return resolve_hierarchy(forest_links(spark, d)).select("forest", "node", "root", "depth", F.concat_ws("/", "path").alias("path"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(forest_links(spark, d))


def view_moments(spark: SparkSession, d: str) -> DataFrame:
    """(view_id, canonical_id, at): the moment of each view request in microseconds, as_known_at or else its document's acquired_at."""
    v = load(spark, d, "view_requests").select("view_id", "canonical_id", "as_known_at", "doc_id").distinct()
    own = v.filter("as_known_at is not null").select("view_id", "canonical_id", F.unix_micros("as_known_at").alias("at"))
    docs = load(spark, d, "documents").select("doc_id", "acquired_at", "calendar")
    lent = with_utc_micros(v.filter("as_known_at is null").join(docs, "doc_id"), "acquired_at", "calendar", "at").select("view_id", "canonical_id", "at")
    return own.unionByName(lent)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    facts = load(spark, d, "resource_facts").select("canonical_id", "source_revision", F.unix_micros("known_from").alias("known_us"))
    found = as_of_join(view_moments(spark, d), facts, entity="canonical_id", event_id="view_id", event_time="at", version_time="known_us", version_rank="source_revision")
    return found.select("view_id", "canonical_id", "source_revision")


def p7_as_known(spark: SparkSession, d: str) -> DataFrame:
    """As ``p7_found``, for the requests that name their moment themselves."""
    facts = load(spark, d, "resource_facts").select("canonical_id", "source_revision", F.unix_micros("known_from").alias("known_us"))
    own = load(spark, d, "view_requests").select("view_id", "canonical_id", F.unix_micros("as_known_at").alias("at"))
    return as_of_join(own, facts, entity="canonical_id", event_id="view_id", event_time="at", version_time="known_us", version_rank="source_revision").select("view_id", "canonical_id", "source_revision")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_metric_report, p3_found, p4_found, p5_found, p5_paths, p5_descendants, p7_found, p7_as_known)}

_LINKS = """links AS (SELECT DISTINCT * FROM (SELECT 'branches' AS forest, branch_id AS node, parent AS up FROM branches UNION ALL SELECT 'type_defs', type_key, unnest(parents) FROM type_defs UNION ALL SELECT 'gazetteer', place_id, unnest(parents) FROM gazetteer)),
nodes AS (SELECT DISTINCT forest, node FROM (SELECT 'branches' AS forest, branch_id AS node FROM branches UNION ALL SELECT 'type_defs', type_key FROM type_defs UNION ALL SELECT 'gazetteer', place_id FROM gazetteer)),
e AS (SELECT l.forest, l.node, l.up FROM links l JOIN nodes n ON n.forest = l.forest AND n.node = l.up)"""
ORACLES: dict[str, str] = {
    "p3_found": """WITH w AS (SELECT DISTINCT canonical_id AS id, placement.minx AS x, placement.miny AS y, placement.maxx AS x2, placement.maxy AS y2 FROM resource_facts WHERE placement.frame = 'wgs84'),
p AS (SELECT id, x, y FROM w WHERE x = x2 AND y = y2), b AS (SELECT * FROM w WHERE x < x2 AND y < y2), named AS (SELECT canonical_id AS id FROM resource_facts WHERE len(list_filter(places, lambda q: q IS NOT NULL)) > 0)
SELECT DISTINCT id_a, id_b FROM (
SELECT a.id AS id_a, c.id AS id_b FROM p a JOIN p c ON a.id < c.id WHERE abs(a.y - c.y) < 0.01 AND 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(a.y - c.y) / 2), 2) + cos(radians(a.y)) * cos(radians(c.y)) * pow(sin(radians(a.x - c.x) / 2), 2)))) <= 250
UNION ALL SELECT least(b.id, q.id), greatest(b.id, q.id) FROM (SELECT * FROM p WHERE id NOT IN (SELECT id FROM named)) q JOIN b ON b.id <> q.id AND q.y BETWEEN b.y AND b.y2 AND (q.x BETWEEN b.x AND b.x2 OR q.x + 360 BETWEEN b.x AND b.x2 OR q.x - 360 BETWEEN b.x AND b.x2))""",
    "p5_found": f"""WITH RECURSIVE {_LINKS}, reach AS (SELECT forest, node, up FROM e UNION SELECT r.forest, r.node, e.up FROM reach r JOIN e ON e.forest = r.forest AND e.node = r.up),
bad AS (SELECT DISTINCT forest, node FROM reach WHERE node = up UNION SELECT r.forest, r.node FROM reach r JOIN reach c ON c.forest = r.forest AND c.node = r.up AND c.node = c.up),
good AS (SELECT * FROM nodes EXCEPT SELECT * FROM bad), w AS (SELECT forest, node, node AS top, 0 AS depth FROM good UNION SELECT w.forest, w.node, e.up, w.depth + 1 FROM w JOIN e ON e.forest = w.forest AND e.node = w.top)
SELECT w.forest, w.node, w.top AS root, CAST(min(depth) AS INTEGER) AS depth FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.forest = w.forest AND e.node = w.top) GROUP BY 1, 2, 3 UNION ALL SELECT forest, node, 'cycle', -1 FROM bad""",
    "p5_paths": f"""WITH RECURSIVE {_LINKS}, reach AS (SELECT forest, node, up FROM e UNION SELECT r.forest, r.node, e.up FROM reach r JOIN e ON e.forest = r.forest AND e.node = r.up),
bad AS (SELECT DISTINCT forest, node FROM reach WHERE node = up UNION SELECT r.forest, r.node FROM reach r JOIN reach c ON c.forest = r.forest AND c.node = r.up AND c.node = c.up),
good AS (SELECT * FROM nodes EXCEPT SELECT * FROM bad), w AS (SELECT forest, node, node AS top, [node] AS path FROM good UNION SELECT w.forest, w.node, e.up, list_append(w.path, e.up) FROM w JOIN e ON e.forest = w.forest AND e.node = w.top)
SELECT forest, node, top AS root, CAST(min(len(path)) - 1 AS INTEGER) AS depth, array_to_string(arg_min(path, (len(path), path)), '/') AS path FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.forest = w.forest AND e.node = w.top) GROUP BY 1, 2, 3 UNION ALL SELECT forest, node, 'cycle', -1, '' FROM bad""",
    "p5_descendants": f"""WITH RECURSIVE {_LINKS}, reach AS (SELECT forest, node, up FROM e UNION SELECT r.forest, r.node, e.up FROM reach r JOIN e ON e.forest = r.forest AND e.node = r.up),
bad AS (SELECT DISTINCT forest, node FROM reach WHERE node = up UNION SELECT r.forest, r.node FROM reach r JOIN reach c ON c.forest = r.forest AND c.node = r.up AND c.node = c.up), good AS (SELECT * FROM nodes EXCEPT SELECT * FROM bad),
w AS (SELECT forest, node AS descendant, up AS node, 1 AS depth FROM e SEMI JOIN good USING (forest, node) UNION SELECT w.forest, w.descendant, e.up, w.depth + 1 FROM w JOIN e ON e.forest = w.forest AND e.node = w.node)
SELECT forest, node, descendant, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY ALL""",
    "p7_as_known": """WITH v AS (SELECT DISTINCT view_id, canonical_id, as_known_at FROM view_requests WHERE view_id IS NOT NULL AND as_known_at IS NOT NULL), f AS (SELECT canonical_id, known_from, max(source_revision) AS source_revision FROM resource_facts WHERE known_from IS NOT NULL GROUP BY 1, 2)
SELECT v.view_id, v.canonical_id, f.source_revision FROM v ASOF JOIN f ON v.canonical_id = f.canonical_id AND v.as_known_at >= f.known_from""",
}
