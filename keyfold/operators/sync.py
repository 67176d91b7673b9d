"""Replicas and clients: change values, applying them, outboxes, acknowledged places, watchers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyfold.functions.glob import glob, glob_column
from keyfold.functions.numbers import format_score
from keyfold.plans.catalog import REPLAYABLE

#: Writes that an outbox holds of a client; the oldest go first.
MAX_PENDING = 10_000
#: Keys of a live query's first state.
MAX_STATE_KEYS = 10_000


def _json(parts: Column) -> Column:
    """An array of texts as a JSON array."""
    return F.to_json(parts)


def change_values(strings: DataFrame, hashes: DataFrame, lists: DataFrame, sets: DataFrame, zsets: DataFrame, documents: DataFrame) -> DataFrame:
    """key and payload: what a client is told of each key. A string is its text; other types are a JSON array of the type and its parts in order: fields and values, elements, members, members and scores, or the document."""
    def tagged(rows: DataFrame, tag: str, order: list[str], *parts: Column) -> DataFrame:
        items = F.sort_array(F.collect_list(F.struct(*order, F.array(*(p.cast("string") for p in parts)).alias("p"))))  # the elements of one key
        return rows.groupBy("key").agg(_json(F.concat(F.array(F.lit(tag)), F.flatten(F.transform(items, lambda x: x["p"])))).alias("payload"))

    col = F.col
    typed = [
        strings.select("key", col("value").cast("string").alias("payload")),
        tagged(hashes, "hash", ["field"], col("field"), col("value")),
        tagged(lists, "list", ["pos"], col("value")),
        tagged(sets, "set", ["member"], col("member")),
        tagged(zsets, "zset", ["score", "member"], col("member"), format_score(col("score"))),
        documents.select("key", _json(F.array(F.lit("json"), col("doc"))).alias("payload")),
    ]
    out = typed[0]
    for t in typed[1:]:
        out = out.unionByName(t)
    return out


def changes(named: DataFrame, values: DataFrame) -> DataFrame:
    """named (seq, key) with the key's payload, null where the key is gone."""
    return named.join(values, "key", "left").select("seq", "key", "payload")


def apply_changes(replica: DataFrame, pushed: DataFrame) -> DataFrame:
    """A replica's payloads (key, payload) after change rows (seq, key, payload): the latest change of a key replaces it as a whole, one without payload removes it."""
    last = pushed.groupBy("key").agg(F.max_by(F.struct("payload"), "seq").alias("c")).select("key", "c.payload")
    return replica.select("key", "payload").join(last.select("key"), "key", "left_anti").unionByName(last.where("payload is not null"))


def elements(values: DataFrame) -> DataFrame:
    """key, type, element and value of payloads: what apply_changes() leaves, taken apart by type. Elements of lists are their places."""
    parts = F.when(F.col("payload").startswith("["), F.from_json("payload", "array<string>"))
    typed = values.withColumn("p", parts).withColumn("type", F.when(F.get("p", F.lit(0)).isin("hash", "list", "set", "zset", "json"), F.get("p", F.lit(0))).otherwise("string"))
    items = F.slice(F.col("p"), F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))
    pair = lambda a, b: F.struct(a.alias("element"), b.alias("value"))
    none = F.lit("")
    # One pass for each half: a lambda that took pair k out of items would make items anew for each k.
    names, told = F.filter(items, lambda x, k: k % 2 == 0), F.filter(items, lambda x, k: k % 2 == 1)
    pairs = F.zip_with(F.slice(names, F.lit(1), F.size(told)), told, pair)  # a name without value is left out
    rows = (
        F.when(F.col("type").isin("hash", "zset"), pairs)
        .when(F.col("type") == "list", F.transform(items, lambda x, k: pair(k.cast("string"), x)))
        .when(F.col("type") == "set", F.transform(items, lambda x: pair(x, none)))
        .when(F.col("type") == "json", F.array(pair(none, F.get(items, F.lit(0)))))
        .otherwise(F.array(pair(none, F.col("payload"))))
    )
    return typed.select("key", "type", F.explode(rows).alias("x")).select("key", "type", "x.*")


def query_state(keys: DataFrame, pattern: str, limit: int = MAX_STATE_KEYS) -> DataFrame:
    """QSUB's first state: key and value of matching keys (key, type, value), the first `limit` by key; a collection's value is its type's name."""
    found = keys.where(glob(F.col("key"), pattern)).orderBy("key").limit(limit)
    return found.select("key", F.when(F.col("type") == "string", F.col("value")).otherwise(F.col("type")).alias("value"))


def get_matching(keys: DataFrame, pattern: str) -> DataFrame:
    """getMatching: key, value (null for a collection) and rank of matching keys (key, type, value)."""
    found = keys.where(glob(F.col("key"), pattern)).select("key", F.when(F.col("type") == "string", F.col("value")).alias("value"))
    return found.withColumn("rank", (F.row_number().over(Window.orderBy("key")) - 1).cast("long"))


def subscribed(requests: DataFrame) -> DataFrame:
    """QSUB, QUNSUB: conn_id and pattern of the live queries that are left after requests (conn_id, pattern, on, seq); an `off` without pattern ends all of its connection."""
    all_off = requests.where("not on and pattern is null").groupBy("conn_id").agg(F.max("seq").alias("cleared"))
    last = requests.where("pattern is not null").groupBy("conn_id", "pattern").agg(F.max_by(F.struct("on", "seq"), "seq").alias("r"))
    left = last.join(all_off, "conn_id", "left").where(F.col("r.on") & (F.col("cleared").isNull() | (F.col("cleared") < F.col("r.seq"))))
    return left.select("conn_id", "pattern")


def notified(writes: DataFrame, watchers: DataFrame) -> DataFrame:
    """Who is told of each write (seq, key): seq, key, conn_id, once for each connection, whether it watches the key itself or patterns (conn_id, kind, pattern). Patterns meet the distinct keys."""
    names = writes.select("key").distinct()
    exact = watchers.where("kind = 'exact'").select(F.col("pattern").alias("key"), "conn_id")
    globs = names.join(watchers.where("kind = 'pattern'"), glob_column(F.col("key"), F.col("pattern"))).select("key", "conn_id")
    return writes.select("seq", "key").join(exact.unionByName(globs).distinct(), "key").select("seq", "key", "conn_id")


def outbox(writes: DataFrame, epoch: int, most: int = MAX_PENDING) -> DataFrame:
    """A client's queue: writes (client, seq, command, acked) with number (from 0 in order of seq), wire_id, by which the server drops repeats, and pending.

    Of more than `most` unsent writes the oldest are dropped; acknowledged ones have left.
    """
    order = Window.partitionBy("client").orderBy("seq")
    numbered = writes.withColumn("number", (F.row_number().over(order) - 1).cast("long"))
    later = F.count_if(~F.col("acked")).over(order.rowsBetween(1, Window.unboundedFollowing))
    wire = F.lit(epoch << 32).cast("long").bitwiseOR(F.col("number").bitwiseAND(F.lit(0xFFFFFFFF)))
    return numbered.withColumns({"wire_id": wire, "pending": ~F.col("acked") & (later < most)})


def restored(pending: DataFrame, first: int) -> DataFrame:
    """What an earlier session left (client, number, wire_id) with fresh numbers from `first` on, newest first, as the queue is filled from its end; wire ids stay."""
    order = Window.partitionBy("client").orderBy(F.col("number").desc())
    return pending.withColumn("new_number", (F.lit(first) + F.row_number().over(order) - 1).cast("long"))


def replayable(log: DataFrame) -> DataFrame:
    """The commands of a log (cmd, ...) that a peer may push into a replica; others are ignored."""
    return log.where(F.upper("cmd").isin(*sorted(REPLAYABLE)))


def lag(log: DataFrame, acks: DataFrame) -> DataFrame:
    """replica, acked and lag: how far each replica's acknowledged place (replica, seq) is behind the log (seq); 0 for an empty log."""
    end = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("end"))
    last = acks.groupBy("replica").agg(F.max("seq").alias("acked"))
    return last.crossJoin(F.broadcast(end)).select("replica", "acked", F.greatest(F.col("end") - F.col("acked"), F.lit(0)).alias("lag"))  # one row


def to_send(log: DataFrame, acks: DataFrame) -> DataFrame:
    """replica and the rows of the log that each replica still lacks; a replica that never acknowledged gets all."""
    last = acks.groupBy("replica").agg(F.max("seq").alias("acked"))
    return log.join(F.broadcast(last), log["seq"] > F.coalesce(last["acked"], F.lit(-1))).drop("acked")  # a row a replica


def swept_marks(marks: DataFrame, now_ms: int, idle_ms: int = 86_400_000, most: int = 10_000) -> DataFrame:
    """DEDUP's marks (client, mark, last_ms) less idle ones, which go only when there are more than `most` clients."""
    n = marks.agg(F.count("*").alias("n"))
    return marks.crossJoin(F.broadcast(n)).where((F.col("n") <= most) | (F.col("last_ms") > now_ms - idle_ms)).drop("n")  # one row
