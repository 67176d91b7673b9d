"""Keys of all types: liveness, expiry, listing, renaming, accounting, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyfold.functions.glob import glob
from keyfold.functions.ranges import next_cursor, page

#: Accounting bytes of a key besides its name and payload.
OVERHEAD = 64


def is_live(now_ms: Column | int) -> Column:
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > now)


def live(table: DataFrame, now_ms: int) -> DataFrame:
    """Rows that have not expired; the expiry sweep keeps the same rows."""
    return table.where(is_live(now_ms))


def exists(keys: DataFrame, named: DataFrame, now_ms: int) -> DataFrame:
    """EXISTS: `n`, how many of the named keys (repeats counted again) are live."""
    return named.join(live(keys, now_ms).select("key"), "key").agg(F.count("*").alias("n"))


def delete(keys: DataFrame, named: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """DEL, UNLINK: (keys that stay, `n` of the live ones removed)."""
    stay = keys.join(named.select("key").distinct(), "key", "left_anti")
    gone = live(keys, now_ms).join(named.select("key").distinct(), "key", "left_semi").agg(F.count("*").alias("n"))
    return stay, gone


def size(keys: DataFrame, now_ms: int) -> DataFrame:
    """DBSIZE: `n` live keys."""
    return live(keys, now_ms).agg(F.count("*").alias("n"))


def flush(keys: DataFrame) -> DataFrame:
    """FLUSHDB: no keys."""
    return keys.limit(0)


def matching(keys: DataFrame, pattern: str, now_ms: int | None = None) -> DataFrame:
    """KEYS: live keys that match, for an ordered reply sorted by key."""
    found = keys if now_ms is None else live(keys, now_ms)
    return found.where(glob(F.col("key"), pattern))


def scan(keys: DataFrame, cursor: int, count: int = 10, pattern: str = "*", key: str = "key") -> DataFrame:
    """SCAN: one page of the sorted matching keys, with `next`, the cursor of the next page (0 after the last).

    A page is a top-k: rows up to its end are kept by each task, so nothing is sorted as a whole. One
    row beyond the page tells whether there is a next one.
    """
    end = cursor + max(1, count)
    top = keys.where(glob(F.col(key), pattern)).orderBy(key).limit(end + 1)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(key)) - 1)  # end + 1 rows
    total = F.count("*").over(Window.partitionBy())
    return ranked.withColumn("next", next_cursor(total, cursor, count)).where(page(F.col("rank"), cursor, count))


def pages(elements: DataFrame, order: str, count: int, partition: str = "key") -> DataFrame:
    """HSCAN, SSCAN, ZSCAN over all keys: each element with `cursor`, where its page starts, and `next`."""
    w = Window.partitionBy(partition).orderBy(order)
    ranked = elements.withColumns({"rank": F.row_number().over(w) - 1, "total": F.count("*").over(Window.partitionBy(partition))})
    at = F.expr(f"rank div {count} * {count}")
    return ranked.withColumn("cursor", at).withColumn("next", F.when(F.col("total") > F.col("cursor") + count, F.col("cursor") + count).otherwise(0).cast("long")).drop("rank", "total")


def rename(keys: DataFrame, old: str, new: str) -> DataFrame:
    """RENAME: the row of `old`, its expiry included, under the name `new`, in place of what was there; no `old`: no change."""
    there = keys.where(F.col("key") == old).limit(1).withColumn("found", F.lit(True)).select("found")
    flagged = keys.join(F.broadcast(there), how="left")  # one row at most
    kept = flagged.where(~((F.col("key") == new) & F.coalesce("found", F.lit(False)) & (F.lit(old) != new)))
    return kept.withColumn("key", F.when(F.col("key") == old, new).otherwise(F.col("key"))).drop("found")


def rename_all(keys: DataFrame, renames: DataFrame) -> DataFrame:
    """Many renames at once (old, new), none of which has a name in common with another."""
    done = renames.join(keys.select(F.col("key").alias("old")), "old", "left_semi")
    kept = keys.join(done.select(F.col("new").alias("key")), "key", "left_anti")
    return kept.join(done.withColumnRenamed("old", "key"), "key", "left").withColumn("key", F.coalesce("new", "key")).drop("new")


def type_of(keys: DataFrame, named: DataFrame) -> DataFrame:
    """TYPE: key and type, `none` where there is no such key."""
    return named.join(keys.select("key", "type"), "key", "left").select("key", F.coalesce("type", F.lit("none")).alias("type"))


def expire_at(log: DataFrame) -> DataFrame:
    """EXPIRE, PEXPIRE, EXPIREAT, PEXPIREAT, PERSIST: key and expires_at_ms after the last of the log's rows.

    log: key, seq, ts_ms, unit (`s`, `ms`, `at_s`, `at_ms` or `persist`) and amount; negative amounts are refused.
    """
    amount = F.col("amount")
    at = F.when(F.col("unit") == "s", F.col("ts_ms") + amount * 1000).when(F.col("unit") == "ms", F.col("ts_ms") + amount).when(F.col("unit") == "at_s", amount * 1000).when(F.col("unit") == "at_ms", amount)
    fine = log.where((F.col("unit") == "persist") | (amount >= 0))
    return fine.groupBy("key").agg(F.max_by(F.struct(at.alias("expires_at_ms")), "seq").alias("x")).select("key", "x.expires_at_ms")


def pttl(expires_at_ms: Column, now_ms: int, present: Column | None = None) -> Column:
    """PTTL: milliseconds left; -1 without expiry, -2 for an absent or expired key."""
    there = F.lit(True) if present is None else present
    return F.when(~there | (expires_at_ms <= now_ms), -2).when(expires_at_ms.isNull(), -1).otherwise(expires_at_ms - now_ms).cast("long")


def ttl(expires_at_ms: Column, now_ms: int, present: Column | None = None) -> Column:
    """TTL: seconds left, rounded to the nearest; -1 and -2 as pttl()."""
    left = pttl(expires_at_ms, now_ms, present)
    return F.when(left < 0, left).otherwise(F.expr("1") * F.floor((left + 500) / 1000)).cast("long")


def memory_usage(payloads: DataFrame) -> DataFrame:
    """MEMORY USAGE: key and bytes of every key. payloads: (key, bytes), a row for each element; null bytes for a key without elements."""
    return payloads.groupBy("key").agg((OVERHEAD + F.octet_length(F.first("key")) + F.coalesce(F.sum("bytes"), F.lit(0))).cast("long").alias("bytes"))


def sample(keys: DataFrame, now_ms: int) -> DataFrame:
    """The keyspace in one pass: keys, volatile_keys and memory_bytes of live rows (key, expires_at_ms, bytes)."""
    return live(keys, now_ms).agg(F.count("*").alias("keys"), F.count("expires_at_ms").alias("volatile_keys"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("memory_bytes"))


#: Policy -> (which keys may go, what goes first).
POLICIES = {
    "allkeys-lru": (lambda now: F.lit(True), lambda seed: F.col("last_access_ms")),
    "allkeys-random": (lambda now: F.lit(True), lambda seed: F.xxhash64("key", F.lit(seed))),
    "volatile-lru": (lambda now: F.col("expires_at_ms") > now, lambda seed: F.col("last_access_ms")),
    "volatile-ttl": (lambda now: F.col("expires_at_ms") > now, lambda seed: F.col("expires_at_ms")),
}
#: The share of the memory limit that an eviction frees beyond it.
HEADROOM = 16


def eviction_target(limit: int) -> int:
    return limit - limit // HEADROOM


def victims(keys: DataFrame, policy: str, limit: int, now_ms: int, buckets: int = 1024, seed: int = 0) -> DataFrame:
    """Keys to evict, with weight: the first in the policy's order (ties by key) until memory is at most 15/16 of the limit; none below the limit.

    keys: key, expires_at_ms, last_access_ms, bytes. noeviction gives none. The order is exact, where a
    sampling cache takes the best of a few. Running sums go by ranges of the weight first, so that only
    keys of one range at a time are ordered in a task; no more than `buckets` range sums are gathered.
    """
    none = keys.limit(0).select("key", F.lit(0).cast("long").alias("weight"), "bytes")
    total = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    if policy == "noeviction" or total <= limit:
        return none
    may_go, order = POLICIES[policy]
    able = keys.where(may_go(now_ms)).select("key", order(seed).alias("weight"), "bytes")
    low, high = able.agg(F.min("weight"), F.max("weight")).first()
    if low is None:
        return none
    width = max(1, -(-(high - low + 1) // buckets))
    placed = able.withColumn("range", F.expr(f"cast((cast(weight as decimal(38,0)) - {low}) div {width} as int)"))
    free, before, cut = total - eviction_target(limit), 0, None
    for r in sorted(placed.groupBy("range").agg(F.sum("bytes").alias("b")).collect(), key=lambda r: r["range"]):
        if before + r["b"] >= free:
            cut = r["range"]
            break
        before += r["b"]
    if cut is None:
        return able
    run = F.sum("bytes").over(Window.partitionBy("range").orderBy("weight", "key").rowsBetween(Window.unboundedPreceding, -1))
    edge = placed.where(F.col("range") == cut).withColumn("run", F.coalesce(run, F.lit(0))).where(F.col("run") < free - before)
    return placed.where(F.col("range") < cut).select("key", "weight", "bytes").unionByName(edge.select("key", "weight", "bytes"))
