"""Replaying logs on Spark against one Machine that runs the whole log, and what is built on it."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyfold.operators import hashes, keys, lists, sets, strings, zsets
from keyfold.plans.catalog import catalog
from keyfold.plans.keyspace import Keyspace, payload_of, value_of
from keyfold.plans.machine import Machine, Refused
from keyfold.plans.replay import LOG, clusters, final_state, normalised, replies, reply_text
from keyfold.sources import frames, snapshot

NAMES = [f"k{i}" for i in range(8)]


def random_log(seed, n=400):
    r = random.Random(seed)
    key, num = lambda: r.choice(NAMES), lambda: str(r.randrange(-3, 9))
    member = lambda: r.choice("abcde")
    makers = [
        lambda: ["SET", key(), num()], lambda: ["SET", key(), num(), "NX"], lambda: ["SET", key(), num(), "XX", "GET"], lambda: ["SETEX", key(), str(r.randrange(1, 30)), num()], lambda: ["SETNX", key(), num()],
        lambda: ["INCRBY", key(), num()], lambda: ["APPEND", key(), num()], lambda: ["DEL", key(), key()], lambda: ["EXPIRE", key(), str(r.randrange(20))], lambda: ["PERSIST", key()], lambda: ["RENAME", key(), key()],
        lambda: ["HSET", key(), member(), num()], lambda: ["HINCRBY", key(), member(), num()], lambda: ["HDEL", key(), member()], lambda: ["HGETALL", key()],
        lambda: ["LPUSH", key(), num(), num()], lambda: ["RPOP", key()], lambda: ["LREM", key(), "1", num()], lambda: ["LRANGE", key(), "0", "-1"],
        lambda: ["SADD", key(), member(), member()], lambda: ["SMOVE", key(), key(), member()], lambda: ["SINTERSTORE", key(), key(), key()], lambda: ["SPOP", key()], lambda: ["SMEMBERS", key()],
        lambda: ["ZADD", key(), "GT", num(), member()], lambda: ["ZINCRBY", key(), num(), member()], lambda: ["ZRANGE", key(), "0", "-1", "WITHSCORES"],
        lambda: ["JMERGE", key(), '{"%s":%s}' % (member(), num())], lambda: ["JGET", key()], lambda: ["RLCHECK", key(), "3", "9"], lambda: ["TYPE", key()],
    ]
    log = []
    for seq in range(n):
        cmd, *args = r.choice(makers)() if r.random() > 0.01 else ["FLUSHDB"]
        log.append((seq, seq * 500, cmd, [a.encode() for a in args], None))
    return log


def walked(log):
    m, out = Machine(), {}
    for seq, ts, cmd, args, _ in log:
        try:
            out[seq] = (reply_text(m.run(cmd, args, ts, seq)), None)
        except Refused as e:
            out[seq] = (None, str(e))
    return out, m


def state_of(m, now):
    return {(k, c.kind, payload_of(c.kind, c.value), c.expires) for k, c in m.cells.items() if c.expires is None or c.expires > now}


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_is_the_walk(spark, seed):
    log = random_log(seed)
    df = spark.createDataFrame(log, LOG)
    expected, m = walked(log)
    assert {r.seq: (r.reply, r.error) for r in replies(df).collect()} == expected
    now = log[-1][1]
    got = {(r.key, r.kind, bytes(r.payload), r.expires_at_ms) for r in final_state(df, now).collect()}
    assert got == state_of(m, now)
    again = {(r.key, r.kind, bytes(r.payload), r.expires_at_ms) for r in final_state(normalised(df), now).collect()}
    assert {x for x in again if x[1] != "ratelimit"} == {x for x in got if x[1] != "ratelimit"}


def test_recovery_from_snapshot(spark, tmp_path):
    log = random_log(3)
    df, now = spark.createDataFrame(log, LOG), log[-1][1]
    half = df.where("seq < 200")
    path = str(tmp_path / "snap")
    assert snapshot.last_save(spark, path) is None and snapshot.load(spark, path, 0)[1] == -1
    snapshot.save(final_state(half, 199 * 500), path, 199, 199 * 500)
    rows, seq = snapshot.load(spark, path, 199 * 500)
    assert seq == 199 and snapshot.last_save(spark, path) == 199 * 500 // 1000 and snapshot.save_due([(900, 1), (60, 100)], 60, 100) and not snapshot.save_due([(900, 1)], 60, 100)
    got = {(r.key, r.kind, bytes(r.payload), r.expires_at_ms) for r in final_state(df.where(F.col("seq") > seq), now, rows).collect()}
    assert {x for x in got if x[1] != "ratelimit"} == {x for x in state_of(walked(log)[1], now) if x[1] != "ratelimit"}


def test_frames(spark, tmp_path):
    parts = [[b"SET", b"k", b"\xff\x00\r\n"], [b"GET", b"k"], [b"SET", b"e", b""]]
    data = b"".join(map(frames.encode, parts))
    assert list(frames.decode(data)) == parts and list(frames.decode(data[:-3])) == parts[:-1] and list(frames.decode(data + b"junk")) == parts and list(frames.decode(b"")) == []
    (tmp_path / "a.log").write_bytes(data)
    (tmp_path / "b.log").write_bytes(frames.encode([b"DEL", b"k"]) + b"*1\r\n$9\r\ncut")
    log = frames.read_log(spark, str(tmp_path))
    rows = log.orderBy("seq").collect()
    assert [[r.cmd.encode(), *map(bytes, r.args)] for r in rows] == [*parts, [b"DEL", b"k"]]
    assert [bytes(r.frame) for r in frames.frame_rows(log).orderBy("seq").collect()] == [*map(frames.encode, parts), frames.encode([b"DEL", b"k"])]
    assert [r.reply for r in replies(log).orderBy("seq").collect()] == ["OK", '{"base64":"/wANCg=="}', "OK", "1"]


def test_clusters(spark):
    log = spark.createDataFrame([(0, 0, "RENAME", [b"a", b"b"], None), (1, 0, "SMOVE", [b"c", b"b", b"x"], None), (2, 0, "SET", [b"z", b"a"], None), (3, 0, "SET", [b"p", b"1"], 7), (4, 0, "SET", [b"q", b"1"], 7)], LOG)
    assert {r.key: r.cluster for r in clusters(log).collect()} == {"a": "a", "b": "a", "c": "a", "p": "p", "q": "p"}


def test_tables(spark):
    log = [["SET", "s", "xyz"], ["HSET", "h", "f", "1", "g", "22"], ["RPUSH", "l", "a", "b"], ["SADD", "t", "m", "n"], ["ZADD", "z", "1.5", "m", "inf", "n"], ["JSET", "j", "$", '{"a":[1,"xy"]}'], ["RLSET", "r", "3", "60"], ["SET", "gone", "x", "PX", "1"], ["SADD", "empty", "x"], ["SREM", "empty", "x"]]
    df = spark.createDataFrame([(k, 0, c[0], [a.encode() for a in c[1:]], None) for k, c in enumerate(log)], LOG)
    space = Keyspace(final_state(df, 5), 5)
    m = walked([(k, 0, c[0], [a.encode() for a in c[1:]], None) for k, c in enumerate(log)])[1]
    assert {r.key: r.bytes for r in space.keys.collect()} == {k: m.size(k) for k in m.cells if k != "gone"}
    assert [(r.field, bytes(r.value)) for r in space.hashes.orderBy("field").collect()] == [("f", b"1"), ("g", b"22")]
    assert [(r.pos, bytes(r.value)) for r in space.lists.orderBy("pos").collect()] == [(0, b"a"), (1, b"b")]
    assert {(r.member, r.score) for r in space.zsets.collect()} == {("m", 1.5), ("n", float("inf"))}
    assert {r.key for r in space.sets.collect()} == {"t"} and space.documents.first().doc == '{"a":[1,"xy"]}' and space.limiters.first().window_ms == 60_000
    assert space.info().first()["keys"] == 8


@given(st.dictionaries(st.text(min_size=1), st.binary()))
def test_payloads_round_trip(d):
    assert value_of("hash", payload_of("hash", d)) == d and value_of("list", payload_of("list", list(d.values()))) == list(d.values()) and list(value_of("set", payload_of("set", d))) == sorted(d)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-5, 5)), min_size=1, max_size=30))
def test_increments_are_the_walk(spark, steps):
    m = Machine()
    expected = [m.run("INCRBY", [k.encode(), str(n).encode()], 0) for k, n in steps]
    df = spark.createDataFrame([(k, i, n) for i, (k, n) in enumerate(steps)], "key string, seq long, delta long")
    assert [r.total for r in strings.increments(df).orderBy("seq").collect()] == expected


def test_edges(spark):
    empty = spark.createDataFrame([], "key string, seq long, delta long")
    assert strings.increments(empty).count() == 0 and strings.counter_totals(empty).count() == 0
    big = spark.createDataFrame([("k", 0, (1 << 63) - 1), ("k", 1, 1)], "key string, seq long, delta long")
    assert [r.total for r in strings.increments(big).orderBy("seq").collect()] == [(1 << 63) - 1, None]
    h = spark.createDataFrame([("h", "f", 0, "text", None), ("h", "f", 1, None, 5), ("h", "g", 2, None, 1)], "key string, field string, seq long, value string, delta long")
    assert {r.field: r.total for r in hashes.increment_fields(h).collect()} == {"f": 5, "g": 1}
    z = spark.createDataFrame([("z", "b", 0.0), ("z", "a", 0.0), ("z", "c", -1.0)], "key string, member string, score double")
    assert [r.member for r in zsets.by_rank(z, 0, -1, reverse=True).orderBy("rank").collect()] == ["b", "a", "c"]
    s = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2")], "key string, member string")
    assert sets.intersection(s, ["a", "none"]).count() == 0 and {r.member for r in sets.union(s, ["a", "none"]).collect()} == {"1"}
    assert {(r.key, r.member) for r in sets.move(s, spark.createDataFrame([("b", "a", "2"), ("a", "b", "9")], "source string, target string, member string")).collect()} == {("a", "1"), ("a", "2"), ("b", "1")}
    k = spark.createDataFrame([("a", 5, None), ("b", 6, 10)], "key string, v int, expires_at_ms long")
    assert {(r.key, r.v) for r in keys.rename(k, "a", "b").collect()} == {("b", 5)} and {r.key for r in keys.rename(k, "none", "b").collect()} == {"a", "b"}
    assert [r.key for r in keys.live(k, 10).collect()] == ["a"] and keys.victims(k.withColumns({"bytes": F.lit(5), "last_access_ms": F.col("v")}), "noeviction", 1, 0).count() == 0
    pages = [keys.scan(spark.range(25).select(F.format_string("k%02d", "id").alias("key")), c, 10) for c in (0, 10, 20)]
    assert [(p.count(), p.first()["next"]) for p in pages] == [(10, 10), (10, 20), (5, 0)]
    l = spark.createDataFrame([("l", 0, "a"), ("l", 1, "b"), ("l", 2, "a")], "key string, pos long, value string")  # noqa: E741
    assert [r.value for r in lists.remove(l, -1, "a").orderBy("pos").collect()] == ["a", "b"] and lists.in_range(l, 5, 9).count() == 0
    assert catalog(spark).count() == 123
