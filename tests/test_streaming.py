"""Streams replayed from files give what the batch operators give."""

import time

import pytest

from keyfold.operators import limiter, messages
from keyfold.streaming import processors

EVENTS = [("a", 3, 0), ("a", 2, 1), ("b", 1, 2), ("a", 4, 3), ("a", 4, 4), ("b", 2, 5)]


def streamed(spark, tmp_path, batches, schema, build):
    """What comes out of a stream that is stopped and taken up again after each batch."""
    path, out = str(tmp_path / "in"), []
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
        stream = build(spark.readStream.schema(schema).parquet(path))
        query = stream.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        try:
            assert query.awaitTermination(60)
        finally:
            query.stop()
    return out


def test_once(spark, tmp_path):
    schema = "client string, id long, seq long"
    got = streamed(spark, tmp_path, [EVENTS[:3], EVENTS[3:]], schema, processors.once)
    batch = messages.once(spark.createDataFrame(EVENTS, schema)).where("not duplicate").collect()
    assert {r.seq for r in got} == {r.seq for r in batch} == {0, 2, 3, 5}


def test_checks(spark, tmp_path):
    schema = "key string, ts_ms long, seq long"
    rows = [("k", t, k) for k, t in enumerate((0, 10, 20, 30, 700, 710))]
    got = streamed(spark, tmp_path, [rows[:3], rows[3:]], schema, lambda s: processors.checks(s, 2, 640))
    batch = limiter.checks(spark.createDataFrame(rows, schema), 2, 640).collect()
    assert {(r.seq, r.allowed, r.remaining, r.retry_after_ms) for r in got} == {(r.seq, r.allowed, r.remaining, r.retry_after_ms) for r in batch}


def test_published_and_live(spark, tmp_path):
    subs = spark.createDataFrame([(1, "exact", "x"), (2, "pattern", "?"), (3, "pattern", "y*")], "conn_id int, kind string, pattern string")
    rows = [(0, "x", "p"), (1, "yy", "q")]
    got = streamed(spark, tmp_path, [rows], "seq long, channel string, payload string", lambda s: processors.published(s, subs))
    assert {(r.seq, r.conn_id) for r in got} == {(0, 1), (0, 2), (1, 3)}


def test_latest(spark, tmp_path):
    schema, path, out = "key string, seq long, value string, expires_at_ms long", str(tmp_path / "in"), []
    spark.createDataFrame([("a", 0, "1", None), ("b", 1, "2", 1), ("a", 2, None, None)], schema).write.parquet(path)
    stream = processors.latest(spark.readStream.schema(schema).parquet(path))
    query = stream.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        end = time.time() + 60
        while time.time() < end and query.isActive and ("b", 1, None) not in out:
            time.sleep(0.2)
    finally:
        query.stop()
    assert {tuple(r) for r in out} == {("a", 0, "1"), ("a", 2, None), ("b", 1, "2"), ("b", 1, None)}


def test_upserts_can_be_repeated(spark, tmp_path):
    write = processors.upsert_sink(str(tmp_path / "sink"))
    one = spark.createDataFrame([("a", 0, "1"), ("b", 1, "2")], "key string, seq long, value string")
    two = spark.createDataFrame([("a", 2, None), ("b", 3, "9")], "key string, seq long, value string")
    for df, k in ((one, 0), (one, 0), (two, 1)):
        write(df, k)
    rows = processors.state_of_sink(spark.read.parquet(str(tmp_path / "sink"))).collect()
    assert [(r.key, r.value) for r in rows] == [("b", "9")]


@pytest.mark.parametrize("pattern,found", [("user:*", {1}), ("*", {1, 2})])
def test_live_changes(spark, pattern, found):
    df = spark.createDataFrame([(0, "user:1", "a"), (1, "user:1", "b"), (2, "x", "c")], "seq long, key string, value string")
    assert {r.seq for r in processors.live_changes(df, pattern, 0).collect()} == found
