"""Queries of the training-data problems of this subpackage over the tables of a scale directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.functions.ids import resolve_ids
from almagest.llm.components import connected_groups
from almagest.llm.mixture import mixture_report, training_order
from almagest.llm.names import group_mentions, link_mentions
from almagest.llm.repetition import repetitive, self_perplexity
from almagest.llm.tokenizer import count_tokens, encode
from almagest.plans import small
from almagest.sources.tables import load

LIVE = ("accepted", "proposed", "disputed")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    mentions = load(spark, d, "entity_mentions")
    linked = link_mentions(mentions.filter("resource is null").select("mention_id", "mention", "label", "types"), load(spark, d, "resources").select("resource_id", "label", "aliases", "types"))
    return linked.filter("not as_label").select("mention_id", "resource_id")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return group_mentions(load(spark, d, "entity_mentions").select("mention_id", "mention", "label", "types"), load(spark, d, "resources").select("resource_id", "label", "aliases", "types"))


def identity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(a, b): the pairs of resources that merges and live affirmed same_as assertions call one."""
    merges = load(spark, d, "merges").select(F.col("from_id").alias("a"), F.col("into_id").alias("b"))
    same = load(spark, d, "assertions").filter((F.col("predicate") == "same_as") & ~F.coalesce("negated", F.lit(False)) & F.col("status").isin(*LIVE))
    pairs = merges.unionByName(same.select(F.col("subject").alias("a"), F.col("object.resource").alias("b"))).filter("a is not null and b is not null").distinct()
    return resolve_ids(pairs, ["a", "b"], load(spark, d, "resources").select("resource_id", "external_ids"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return connected_groups(identity_pairs(spark, d), "a", "b").withColumnRenamed("member", "resource_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(load(spark, d, "documents"), "doc_id", "text")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "source", "text").filter("source is not null")
    wanted = small(load(spark, d, "mix_targets").select("source").distinct(), 10_000)
    return count_tokens(docs.join(wanted, "source", "left_semi"), F.struct("doc_id", "source"), "text").select("key.doc_id", "key.source", "n_tokens")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture_report(_sized(spark, d), load(spark, d, "mix_targets"))


def p9_order(spark: SparkSession, d: str) -> DataFrame:
    return training_order(_sized(spark, d), load(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetitive(load(spark, d, "documents"), "doc_id")


def p10_perplexity(spark: SparkSession, d: str) -> DataFrame:
    return self_perplexity(load(spark, d, "documents"), "doc_id", shares=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_groups, p6_found, p8_ids, p9_order, p9_mixture, p10_found, p10_perplexity)}
_BARE = "regexp_replace(lower(trim(c)), '^res_|-', '', 'g')"
_ID = f"CASE WHEN contains(c, ':') THEN coalesce((SELECT min(resource_id) FROM x WHERE k = lower(split_part(trim(c), ':', 1)) || ':' || split_part(trim(c), ':', 2)), trim(c)) WHEN regexp_full_match({_BARE}, '[0-9a-f]{{32}}') THEN 'res_' || {_BARE} ELSE trim(c) END"
ORACLES: dict[str, str] = {
    "p6_found": f"""WITH RECURSIVE x AS (SELECT DISTINCT resource_id, lower(split_part(u, ':', 1)) || ':' || split_part(u, ':', 2) AS k FROM (SELECT resource_id, unnest(external_ids) AS u FROM resources)),
raw AS (SELECT from_id AS a, into_id AS b FROM merges UNION SELECT subject, object.resource FROM assertions WHERE predicate = 'same_as' AND NOT coalesce(negated, false) AND status IN ('accepted', 'proposed', 'disputed')),
p AS (SELECT {_ID.replace("(c", "(a").replace("trim(c)", "trim(a)")} AS a, {_ID.replace("(c", "(b").replace("trim(c)", "trim(b)")} AS b FROM raw WHERE a IS NOT NULL AND b IS NOT NULL),
e AS (SELECT a, b FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b), w AS (SELECT a AS n, a AS m FROM e UNION SELECT w.n, e.b FROM w JOIN e ON e.a = w.m)
SELECT min(m) AS group_id, n AS resource_id FROM w GROUP BY n"""
}
