"""Folding a command log: every command in order, all keys at once.

Commands that name several keys tie these together, and so do their keys' other commands: the keys of a
log fall into clusters that never touch one another. Each cluster is walked in order by one Machine, so
single-key commands of different keys run side by side, and RENAME, SMOVE or SINTERSTORE need no
barrier. A walk streams over its sorted rows and holds only the state of the cluster at hand. FLUSHDB
reaches all clusters; its places in the log are few and are told to every walk.

log: seq (long, unique), ts_ms, cmd, args (array<binary>), and txn_id, where null is no transaction.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyfold.plans.catalog import COMMANDS
from keyfold.plans.checkpoints import cut
from keyfold.plans.keyspace import payload_of, value_of
from keyfold.plans.machine import Cell, Machine, Refused, score_text

#: FLUSHDB commands that a log may have; their places are held on the driver.
MAX_FLUSHES = 100_000
ROUNDS = 50
#: Clusters of commands without keys.
KEYLESS = 4_096

LOG = T.StructType([T.StructField("seq", T.LongType()), T.StructField("ts_ms", T.LongType()), T.StructField("cmd", T.StringType()), T.StructField("args", T.ArrayType(T.BinaryType())), T.StructField("txn_id", T.LongType())])
REPLIES = T.StructType([T.StructField("seq", T.LongType()), T.StructField("reply", T.StringType()), T.StructField("error", T.StringType()), T.StructField("effect", T.ArrayType(T.BinaryType()))])


def reply_text(reply) -> str | None:
    """A reply as text: numbers and texts as they are, arrays as JSON, bytes that are no UTF-8 as {"base64": ...}; nil is null."""

    def plain(x):
        if isinstance(x, bytes):
            try:
                return x.decode()
            except UnicodeDecodeError:
                return {"base64": base64.b64encode(x).decode()}
        return [plain(y) for y in x] if isinstance(x, list) else x

    reply = plain(reply)
    return reply if reply is None or isinstance(reply, str) else json.dumps(reply, ensure_ascii=False, separators=(",", ":"))


def effect_of(machine: Machine, name: str, args: list[bytes], reply, now: int) -> list[bytes] | None:
    """The command that makes the same change again, whenever and however often it is replayed; null for no change.

    Relative times become absolute ones, counters and conditional writes the values that they led to,
    random removals the members that they hit.
    """
    name = name.upper()
    if name not in COMMANDS or not COMMANDS[name]["writes"]:
        return None
    ms = lambda x: str(x).encode()
    cell = machine.cells.get(args[0].decode()) if args and COMMANDS[name]["first"] else None
    if name in ("SET", "ESET", "SETEX", "PSETEX", "GETSET", "SETNX", "APPEND", "INCR", "DECR", "INCRBY", "DECRBY"):
        options = {a.upper() for a in args[2:]} if name == "SET" else set()
        if name in ("SET", "SETNX") and not machine.wrote:
            return None
        if name == "ESET" or name == "SET" and b"KEEPTTL" not in options or name in ("GETSET", "SETNX", "SETEX", "PSETEX"):
            return [b"SET", args[0], cell.value] + ([b"PXAT", ms(cell.expires)] if cell.expires is not None else [])
        return [b"SET", args[0], cell.value, b"KEEPTTL"]
    if name in ("EXPIRE", "PEXPIRE", "EXPIREAT", "PEXPIREAT"):
        return [b"PEXPIREAT", args[0], ms(cell.expires)] if reply else None
    if name in ("HINCRBY", "HINCRBYFLOAT"):
        return [b"HSET", args[0], args[1], cell.value[args[1].decode()]]
    if name == "HSETNX":
        return [b"HSET", *args] if reply else None
    if name == "SPOP":
        gone = reply if isinstance(reply, list) else [reply] if reply is not None else []
        return [b"SREM", args[0], *gone] if gone else None
    if name in ("ZADD", "ZINCRBY"):
        named = [args[2]] if name == "ZINCRBY" else args[1:][::-1][::2][::-1]
        pairs = [(m, cell.value[m.decode()]) for m in named if m.decode(errors="replace") in cell.value]
        return [b"ZADD", args[0], *(x for m, s in pairs for x in (score_text(s), m))] if pairs else None
    if name in ("DEL", "UNLINK"):
        return [b"DEL", *args] if reply else None
    if name in ("PERSIST", "HDEL", "SREM", "ZREM", "SMOVE", "LREM", "LPUSHX", "RPUSHX") and not reply or name in ("LPOP", "RPOP") and reply in (None, []):
        return None
    if name == "RLCHECK":
        return None  # attempts are not replayed
    return [name.encode(), *args]


def _keyed(log: DataFrame) -> DataFrame:
    """log with keys, the keys of each command as an array."""
    rows = [(n, c["first"], c["last"], c["step"]) for n, c in COMMANDS.items() if c["first"]]
    places = F.broadcast(log.sparkSession.createDataFrame(rows, "name string, first int, last int, step int"))  # the catalog
    joined = log.join(places, F.upper("cmd") == F.col("name"), "left")
    end = F.when(F.col("last") == -1, F.size("args")).otherwise(F.least(F.col("last"), F.size("args")))
    keys = F.when(F.col("first").isNotNull() & (F.col("first") <= F.size("args")), F.transform(F.sequence(F.col("first"), F.greatest(end, F.col("first")), F.col("step")), lambda i: F.get("args", i - 1).cast("string"))).otherwise(F.array().cast("array<string>"))
    return joined.select(*log.columns, keys.alias("keys"))


def clusters(log: DataFrame) -> DataFrame:
    """key, cluster: for each key that a command names beside another one, or in a transaction, the least key that it is tied to."""
    keyed = _keyed(log)
    pairs = keyed.where(F.size("keys") > 1).select(F.explode("keys").alias("a"), F.array_min("keys").alias("b"))
    in_txn = keyed.where("txn_id is not null").select("txn_id", F.explode("keys").alias("a"))
    pairs = pairs.unionByName(in_txn.join(in_txn.groupBy("txn_id").agg(F.min("a").alias("b")), "txn_id").select("a", "b"))
    edges = cut(pairs.distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("cluster")))
    for _ in range(ROUNDS):
        near = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("cluster").alias("near"))
        hop = labels.select(F.col("a").alias("cluster"), F.col("cluster").alias("root"))
        new = cut(labels.join(near, "a").join(hop, "cluster", "left").select("a", F.least("cluster", "near", F.coalesce("root", "cluster")).alias("new"), F.col("cluster").alias("old")))
        if not new.where("new <> old").limit(1).count():
            return labels.select(F.col("a").alias("key"), "cluster")
        labels = new.select("a", F.col("new").alias("cluster"))
    raise RuntimeError("clusters did not settle")


def _placed(log: DataFrame) -> DataFrame:
    """log with cluster: of its keys; commands without keys hold no state and are spread over KEYLESS clusters."""
    keyed = _keyed(log)
    first = F.get("keys", F.lit(0))
    tied = clusters(log)
    return keyed.withColumn("k", first).join(tied.withColumnRenamed("key", "k"), "k", "left").withColumn("cluster", F.coalesce("cluster", "k", F.concat(F.lit("\0"), F.pmod(F.xxhash64("seq"), F.lit(KEYLESS))))).select(*log.columns, "cluster")


def _flushes(log: DataFrame) -> list[int]:
    found = [r["seq"] for r in log.where("upper(cmd) = 'FLUSHDB'").select("seq").orderBy("seq").limit(MAX_FLUSHES + 1).collect()]
    if len(found) > MAX_FLUSHES:
        raise ValueError(f"more than {MAX_FLUSHES} FLUSHDB commands")
    return found


def _walk(log: DataFrame, start: DataFrame | None, out, schema: T.StructType) -> DataFrame:
    """out(machine, rows of a cluster) over all clusters. start: (key, kind, payload, expires_at_ms) rows that are there before the log."""
    flushes = _flushes(log)
    placed = _placed(log).select("cluster", "seq", "ts_ms", "cmd", "args", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("expires_at_ms"))
    if start is not None:
        tied = clusters(log)
        rows = start.join(tied, "key", "left").select(F.coalesce("cluster", "key").alias("cluster"), F.lit(-1).cast("long").alias("seq"), F.lit(0).cast("long").alias("ts_ms"), F.col("key").alias("cmd"), F.array(F.col("payload").cast("binary")).alias("args"), "kind", "expires_at_ms")
        placed = placed.unionByName(rows)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cluster, machine, rows, flushed = None, Machine(), [], 0

        def closed() -> list[dict]:
            if flushed < len(flushes):
                machine.cells.clear()
            return out(machine, None)

        for batch in batches:
            for row in batch.to_pylist():
                if row["cluster"] != cluster:
                    if cluster is not None:
                        rows += closed()
                    cluster, machine, flushed = row["cluster"], Machine(), 0
                while flushed < len(flushes) and flushes[flushed] < row["seq"]:
                    machine.cells.clear()
                    flushed += 1
                if row["kind"] is not None:
                    machine.cells[row["cmd"]] = Cell(row["kind"], value_of(row["kind"], row["args"][0]), row["expires_at_ms"])
                else:
                    rows += out(machine, row)
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
        if cluster is not None:
            rows += closed()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    arrow = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])
    return placed.repartition("cluster").sortWithinPartitions("cluster", "seq").mapInArrow(walk, schema)


def replies(log: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """seq, reply, error and effect of every command of the log."""

    def answer(machine: Machine, row) -> list[dict]:
        if row is None:
            return []
        args = row["args"] or []
        try:
            reply = machine.run(row["cmd"], args, row["ts_ms"], row["seq"])
        except Refused as e:
            return [{"seq": row["seq"], "reply": None, "error": str(e), "effect": None}]
        return [{"seq": row["seq"], "reply": reply_text(reply), "error": None, "effect": effect_of(machine, row["cmd"], args, reply, row["ts_ms"])}]

    return _walk(log, start, answer, REPLIES)


def final_state(log: DataFrame, now_ms: int, start: DataFrame | None = None) -> DataFrame:
    """key, kind, payload (binary) and expires_at_ms of all keys that are live at now_ms after the log."""
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("expires_at_ms", T.LongType())])

    def apply(machine: Machine, row) -> list[dict]:
        if row is None:
            return [{"key": k, "kind": c.kind, "payload": payload_of(c.kind, c.value), "expires_at_ms": c.expires} for k, c in machine.cells.items() if c.expires is None or c.expires > now_ms]
        try:
            machine.run(row["cmd"], row["args"] or [], row["ts_ms"], row["seq"])
        except Refused:
            pass
        return []

    return _walk(log, start, apply, schema)


def normalised(log: DataFrame) -> DataFrame:
    """The log of effects: seq, ts_ms, cmd and args of commands that changed something, safe to replay at any time."""
    done = replies(log).where("effect is not null").select("seq", "effect")
    return done.join(log.select("seq", "ts_ms"), "seq").select("seq", "ts_ms", F.get("effect", F.lit(0)).cast("string").alias("cmd"), F.slice("effect", F.lit(2), F.greatest(F.size("effect") - 1, F.lit(0))).alias("args"), F.lit(None).cast("long").alias("txn_id"))


def command_stats(log: DataFrame, answers: DataFrame) -> DataFrame:
    """cmd, calls, errors, and of GET hits and misses: log with what replies() gave for it."""
    is_get = (F.col("cmd") == "GET") & F.col("error").isNull()
    return log.select("seq", F.upper("cmd").alias("cmd")).join(answers, "seq").groupBy("cmd").agg(F.count("*").alias("calls"), F.count("error").alias("errors"), F.count_if(is_get & F.col("reply").isNotNull()).alias("hits"), F.count_if(is_get & F.col("reply").isNull()).alias("misses"))


def rebuilt(state: DataFrame, ts_ms: int = 0) -> DataFrame:
    """A log (seq, ts_ms, cmd, args, txn_id) that makes the state (key, kind, payload, expires_at_ms) anew: what a compacted log holds. Limiters' attempts are not kept, and empty collections but documents can't be said by commands."""
    from keyfold.plans.keyspace import Keyspace

    text = lambda c: F.col(c).cast("binary")
    space = Keyspace(state.withColumn("expires_at_ms", F.lit(None).cast("long")), 0)

    def gathered(rows: DataFrame, cmd: str, order: str, *parts) -> DataFrame:
        items = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.array(*parts).alias("p")))), lambda x: x["p"])  # the elements of one key
        return rows.groupBy("key").agg(F.concat(F.array(F.col("key").cast("binary")), F.flatten(items)).alias("args")).select("key", F.lit(cmd).alias("cmd"), "args")

    from keyfold.functions.numbers import format_score

    parts = [
        space.strings.select("key", F.lit("SET").alias("cmd"), F.array(text("key"), text("value")).alias("args")),
        gathered(space.hashes, "HSET", "field", text("field"), text("value")),
        gathered(space.lists, "RPUSH", "pos", text("value")),
        gathered(space.sets, "SADD", "member", text("member")),
        gathered(space.zsets, "ZADD", "member", format_score(F.col("score")).cast("binary"), text("member")),
        space.documents.select("key", F.lit("JSET").alias("cmd"), F.array(text("key"), F.lit(b"$"), text("doc")).alias("args")),
        space.limiters.select("key", F.lit("RLSET").alias("cmd"), F.array(text("key"), F.col("limit").cast("string").cast("binary"), F.expr("cast(cast(window_ms div 1000 as string) as binary)")).alias("args")),
    ]
    ends = state.where("expires_at_ms is not null").select("key", F.lit("PEXPIREAT").alias("cmd"), F.array(text("key"), F.col("expires_at_ms").cast("string").cast("binary")).alias("args"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("turn", F.lit(0)).unionByName(ends.withColumn("turn", F.lit(1)))
    # Keys never meet, so an order within each key is an order of the log; places needn't follow one another.
    place = F.xxhash64("key", "cmd").bitwiseAND(F.lit((1 << 61) - 1)) + F.col("turn") * F.lit(1 << 61)
    return out.select(place.alias("seq"), F.lit(ts_ms).cast("long").alias("ts_ms"), "cmd", "args", F.lit(None).cast("long").alias("txn_id"))
