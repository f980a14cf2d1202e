from almagest.operators.search import latest_states
from almagest.streaming.events import EVENT, current, follow_facts, ingest_events, sequence_gaps


def test_ingest_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("u", "c", f"e{i}", i, f"text {i}") for i in (1, 2, 4)]
    args = str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "cp")
    for part in (rows, [*rows, ("u", "c", "e1", 1, "other"), ("u", "c", "e9", 2, "taken"), ("u", "c", "e7", 7, "new"), ("u", "c", "e7", 7, "new")]):
        spark.createDataFrame(part, EVENT).write.mode("append").json(str(src))
        ingest_events(spark.readStream.schema(EVENT).json(str(src)), *args).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(args[0]).collect()) == ["e1", "e2", "e4", "e7"]
    assert {r.event_id for r in spark.read.parquet(args[1]).collect()} == {"e1", "e9"}
    q = sequence_gaps(spark.readStream.schema(EVENT).json(str(src))).writeStream.outputMode("update").format("memory").queryName("gaps").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.sql("select max(last) l, max(seen) s, max_by(missing, seen) m from gaps").first()
    assert (last.l, last.s, last.m) == (7, 4, 3)


def test_stream_equals_batch(spark, tmp_path):
    schema = "canonical_id string, source_revision bigint, known_from timestamp, rank double"
    sel = "select cast(id % 5 as string) canonical_id, id source_revision, timestamp_micros(cast(pmod(id * 37, 50) as bigint)) known_from, cast(id as double) rank from range({0}, {1})"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for a, b in ((0, 20), (20, 40), (40, 60)):
        spark.sql(sel.format(a, b)).write.mode("append").parquet(src)
        follow_facts(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "cp")).awaitTermination()
    want = {tuple(r) for r in latest_states(spark.read.parquet(src)).select("canonical_id", "source_revision").collect()}
    assert {tuple(r) for r in current(spark, out).select("canonical_id", "source_revision").collect()} == want
