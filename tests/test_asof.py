import random

import pytest
from pyspark.sql import functions as F

from almagest.operators.asof import _shards, as_of_join

EV, VE = "view_id bigint, canonical_id string, at bigint, source_revision string", "canonical_id string, known bigint, source_revision bigint, _id string"


def run(spark, events, versions, **kw):
    df = as_of_join(spark.createDataFrame(events, EV), spark.createDataFrame(versions, VE), entity="canonical_id", event_id="view_id", event_time="at", version_time="known", version_rank="source_revision", **kw)
    return sorted((r.view_id, r.canonical_id, r.source_revision) for r in df.collect())


def brute(events, versions):
    out = set()
    for i, e, t, _ in events:
        best = max(((k, r) for c, k, r, _ in versions if None not in (c, k, r, t, e, i) and c == e and k <= t), default=None)
        if best:
            out.add((i, e, best[1]))
    return sorted(out)


@pytest.mark.parametrize("shard", [5, 1_000_000])
def test_hot_entity_ties_and_nulls(spark, shard):
    rng = random.Random(3)
    events = [(i, rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, *range(0, 300)]), "x") for i in range(200)]
    versions = [(rng.choice(["hot", "hot", "a", "c", None]), rng.choice([None, *range(0, 300, 7)]), i, None) for i in range(120)]
    versions += [("hot", 50, 900, None), ("hot", 50, 901, None), ("hot", 50, 901, "twice")]
    events += [(1000, "hot", 50, None), (1001, "hot", 49, None), (1000, "hot", 50, None)]
    assert run(spark, events, versions, shard_rows=shard) == brute(events, versions)


def test_bursts_are_split(spark):
    """All events of an entity in 20 ms of 63 years, a third of them at one instant."""
    far = 63 * 365 * 86_400_000_000
    events = [(i, "hot", far // 2 + (7 if i % 3 else i % 20), "x") for i in range(3000)]
    versions = [("hot", t, r, None) for r, t in enumerate([0, far // 2 - 1, far // 2 + 7, far // 2 + 7, far // 2 + 12, far])]
    assert run(spark, events, versions, shard_rows=200) == brute(events, versions)
    rows = spark.createDataFrame([(i, "hot", t, None, True, i) for i, _, t, _ in events] + [(None, "hot", t, r, False, r) for _, t, r, _ in versions], "_id bigint, _e string, _t bigint, _r bigint, _event boolean, _k bigint")
    sizes = _shards(rows, 200).groupBy("_s").count()
    assert sizes.count() > 10 and sizes.agg(F.max("count")).first()[0] < 500


def test_empty(spark):
    assert run(spark, [], [("a", 1, 1, None)]) == []
    assert run(spark, [(1, "a", 5, None)], []) == []
