"""Publishing, live queries, scopes, transactions and exactly-once delivery."""

from __future__ import annotations

import base64
import hashlib
import hmac

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyfold.functions.glob import MAX_PATTERN_BYTES, glob, glob_column


def deliveries(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """SUBSCRIBE, PSUBSCRIBE: a row for each message and subscription it reaches.

    messages: seq, channel, payload; subscriptions: conn_id, kind (`exact` or `pattern`), pattern, from_seq
    and to_seq (null: still open). A connection that holds both kinds gets both. Exact ones are an
    equi-join; patterns meet the distinct channels, not the messages.
    """
    open_ = (F.col("seq") >= F.col("from_seq")) & (F.col("to_seq").isNull() | (F.col("seq") < F.col("to_seq")))
    out = ["seq", "channel", "payload", "conn_id", "kind"]
    exact = messages.join(subscriptions.where("kind = 'exact'").withColumnRenamed("pattern", "channel"), "channel").where(open_).select(*out)
    patterns = subscriptions.where("kind = 'pattern'")
    hit = messages.select("channel").distinct().join(patterns, glob_column(F.col("channel"), F.col("pattern")))
    return exact.unionByName(messages.join(hit, "channel").where(open_).select(*out))


def publish(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """PUBLISH: seq, channel and receivers of each message, 0 if none. Receivers are counted, not listed: a running sum of subscriptions that open and close on the channel."""
    names = messages.select("channel").distinct()
    exact = subscriptions.where("kind = 'exact'").join(names, F.col("pattern") == F.col("channel"), "left_semi").withColumn("channel", F.col("pattern"))
    globs = names.join(subscriptions.where("kind = 'pattern'"), glob_column(F.col("channel"), F.col("pattern")))
    spans = exact.select("channel", "from_seq", "to_seq").unionByName(globs.select("channel", "from_seq", "to_seq"))
    steps = spans.select("channel", F.col("from_seq").alias("seq"), F.lit(1).alias("n")).unionByName(spans.where("to_seq is not null").select("channel", F.col("to_seq").alias("seq"), F.lit(-1).alias("n")))
    steps = steps.where("seq is not null").groupBy("channel", "seq").agg(F.sum("n").alias("n")).withColumn("message", F.lit(False))
    both = messages.select("channel", "seq", F.lit(0).cast("long").alias("n"), F.lit(True).alias("message")).unionByName(steps)
    open_ = F.sum("n").over(Window.partitionBy("channel").orderBy("seq", "message").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("receivers", open_).where("message").select("seq", "channel", "receivers")


def channels(subscriptions: DataFrame, pattern: str = "*") -> DataFrame:
    """PUBSUB CHANNELS, NUMSUB: channels with open exact subscriptions and how many connections hold them."""
    now = subscriptions.where("kind = 'exact' and to_seq is null").where(glob(F.col("pattern"), pattern))
    return now.groupBy(F.col("pattern").alias("channel")).agg(F.count_distinct("conn_id").alias("subscribers"))


def pattern_count(subscriptions: DataFrame) -> DataFrame:
    """PUBSUB NUMPAT: distinct open patterns."""
    return subscriptions.where("kind = 'pattern' and to_seq is null").agg(F.count_distinct("pattern").alias("n"))


def once(log: DataFrame) -> DataFrame:
    """DEDUP: each row (client, id, seq) with `duplicate`: its id is not above all earlier ones of the client."""
    before = F.max("id").over(Window.partitionBy("client").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("duplicate", F.coalesce(F.col("id") <= before, F.lit(False)))


def high_water(log: DataFrame) -> DataFrame:
    """The mark that each client's next id must exceed."""
    return log.groupBy("client").agg(F.max("id").alias("mark"))


def commits(transactions: DataFrame, watches: DataFrame, writes: DataFrame, unwatched: DataFrame | None = None) -> DataFrame:
    """WATCH, UNWATCH, MULTI, EXEC, DISCARD: transactions (txn_id, exec_seq) with `committed`.

    One fails if a key it watches (txn_id, key, watch_seq) was written (key, seq, txn_id or null) by
    another between the watch and the EXEC. unwatched (txn_id, key or null for all, seq) ends the
    watches before it. A transaction with the column `discarded` true is never committed. Each watch
    looks at the next writes of two writers after it, which windows over each key's writes give; no
    watch meets all writes.
    """
    order = Window.partitionBy("key").orderBy("seq")
    w = writes.select("key", "seq", F.struct(F.col("txn_id")).alias("writer"))
    first = F.lag("writer").over(order)
    runs = w.withColumn("run", F.sum((first.isNull() | ~first.eqNullSafe(F.col("writer"))).cast("int")).over(order))
    starts = runs.groupBy("key", "run").agg(F.min("seq").alias("start")).select("key", (F.col("run") - 1).alias("run"), "start")
    w = runs.join(starts, ["key", "run"], "left").select("key", "seq", F.struct("seq", "writer", "start").alias("write"))
    held = watches
    if unwatched is not None:
        ends = unwatched.select("txn_id", F.col("key").alias("__k"), F.col("seq").alias("__s"))
        held = held.join(ends, (held["txn_id"] == ends["txn_id"]) & (F.col("__k").isNull() | (F.col("__k") == held["key"])) & (F.col("__s") > held["watch_seq"]), "left_anti")
    marks = held.select("key", F.col("watch_seq").alias("seq"), "txn_id")
    both = w.select("key", "seq", "write", F.lit(None).cast(marks.schema["txn_id"].dataType).alias("txn_id"), F.lit(1).alias("mark")).unionByName(marks.select("key", "seq", F.lit(None).cast(w.schema["write"].dataType).alias("write"), "txn_id", F.lit(2).alias("mark")))
    after = Window.partitionBy("key").orderBy("seq", "mark").rowsBetween(1, Window.unboundedFollowing)  # a write at the watch's own place comes before it
    seen = both.withColumn("next", F.first("write", ignorenulls=True).over(after)).where("mark = 2 and next is not null")
    own = F.col("next.writer.txn_id").eqNullSafe(F.col("txn_id"))
    spoils = seen.select("txn_id", F.when(own, F.col("next.start")).otherwise(F.col("next.seq")).alias("at")).where("at is not null").groupBy("txn_id").agg(F.min("at").alias("at"))
    out = transactions.join(spoils, "txn_id", "left").withColumn("committed", F.col("at").isNull() | (F.col("at") >= F.col("exec_seq")))
    if "discarded" in transactions.columns:
        out = out.withColumn("committed", F.col("committed") & ~F.coalesce("discarded", F.lit(False)))
    return out.drop("at")


def live_query(state: DataFrame, changes: DataFrame, pattern: str, at_seq: int) -> DataFrame:
    """QSUB: kind, seq, key, value: the matching state at a point, then the later matching changes (a null value: the key went)."""
    snapshot = state.where(glob(F.col("key"), pattern)).select(F.lit("state").alias("kind"), F.lit(at_seq).cast("long").alias("seq"), "key", "value")
    later = changes.where((F.col("seq") > at_seq) & glob(F.col("key"), pattern)).select(F.lit("change").alias("kind"), "seq", "key", "value")
    return snapshot.unionByName(later)


def flush_notices(patterns: DataFrame, seq: int) -> DataFrame:
    """What FLUSHDB tells live queries: one row without value for each pattern."""
    return patterns.select(F.lit("change").alias("kind"), F.lit(seq).cast("long").alias("seq"), F.col("pattern").alias("key"), F.lit(None).cast("string").alias("value"))


def visible(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """SYNC scopes: a row (client, ...) for each client whose scopes (client, pattern) match the key; rows without key reach all clients."""
    keyed = rows.where("key is not null")
    names = keyed.select("key").distinct()
    hit = names.join(scopes, glob_column(F.col("key"), F.col("pattern"))).select("key", "client").distinct()
    everyone = rows.where("key is null").crossJoin(scopes.select("client").distinct())
    return keyed.join(hit, "key").select("client", *rows.columns).unionByName(everyone.select("client", *rows.columns))


def presence(claims: DataFrame, closed: DataFrame) -> DataFrame:
    """ESET: key, value and owner of ephemeral keys that are left: the latest claim (key, value, conn_id, seq) whose connection didn't close after it (conn_id, seq)."""
    last = claims.groupBy("key").agg(F.max_by(F.struct("value", "conn_id", "seq"), "seq").alias("c")).select("key", "c.*")
    ends = closed.groupBy("conn_id").agg(F.max("seq").alias("end"))
    return last.join(ends, "conn_id", "left").where(F.col("end").isNull() | (F.col("end") < F.col("seq"))).select("key", "value", F.col("conn_id").alias("owner"))


def sign_token(secret: str, patterns: list[str], expires_s: int | None = None) -> str:
    """A scope token: patterns, optionally when it ends, and an HMAC-SHA256 of these."""
    text = ",".join(patterns) + (f"|{expires_s}" if expires_s is not None else "")
    code = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    payload = code(text.encode())
    return f"{payload}.{code(hmac.digest(secret.encode(), payload.encode(), hashlib.sha256))}"


def verify_token(secret: str, token: str, now_s: int) -> list[str]:
    """The patterns that a token grants; ValueError if it is forged, over or grants none."""

    def decoded(text: str, what: str) -> bytes:
        try:
            return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_", validate=True)
        except ValueError:
            raise ValueError(f"malformed {what}") from None

    payload, dot, signature = token.partition(".")
    if not dot:
        raise ValueError("malformed token")
    if not hmac.compare_digest(decoded(signature, "signature"), hmac.digest(secret.encode(), payload.encode(), hashlib.sha256)):
        raise ValueError("invalid signature")
    names, bar, end = decoded(payload, "payload").decode().partition("|")
    if bar and not (end.isascii() and end.isdigit()):
        raise ValueError("malformed expiry")
    if bar and now_s >= int(end):
        raise ValueError("token expired")
    patterns = [p.strip() for p in names.split(",") if p.strip()]
    if not patterns:
        raise ValueError("token grants no patterns")
    if any(len(p.encode()) > MAX_PATTERN_BYTES for p in patterns):
        raise ValueError("token grants an over-long pattern")
    return patterns
