"""Strings: last and first writers, counters, concatenation, ranges, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyfold.functions.numbers import strict_long
from keyfold.functions.ranges import byte_range

LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def set_last(log: DataFrame, *extra: str) -> DataFrame:
    """SET, SETEX, PSETEX: key, value (and `extra` columns) of the latest write. Null values survive."""
    return log.groupBy("key").agg(F.max_by(F.struct("value", *extra), "seq").alias("w")).select("key", "w.*")


def set_with_expiry(log: DataFrame) -> DataFrame:
    """SET with EX, PX, EXAT, PXAT or KEEPTTL, SETEX, PSETEX: key, value and expires_at_ms after a log.

    log: key, value, seq, ts_ms (which doesn't fall as seq grows), option (null: none) and amount.
    Amounts that aren't above 0 are refused. KEEPTTL keeps the expiry of the write before it, unless the
    key had expired by then. Two partial aggregates: a hot key is summed up before it is shuffled.
    """
    amount, option = F.col("amount"), F.upper("option")
    at = F.when(option == "EX", F.col("ts_ms") + amount * 1000).when(option == "PX", F.col("ts_ms") + amount).when(option == "EXAT", amount * 1000).when(option == "PXAT", amount)
    keeps = option.eqNullSafe("KEEPTTL")
    fine = log.where(option.isNull() | keeps | (amount > 0)).select("key", "value", "seq", "ts_ms", keeps.alias("keeps"), at.alias("at"))
    last = F.max_by(F.struct("value", "ts_ms", "keeps"), "seq").alias("l")
    set_ = F.max_by(F.struct("at"), F.when(~F.col("keeps"), F.col("seq"))).alias("e")
    done = fine.groupBy("key").agg(last, set_)
    expires = F.when(F.col("l.keeps") & (F.col("l.ts_ms") >= F.col("e.at")), None).otherwise(F.col("e.at"))
    return done.select("key", "l.value", expires.cast("long").alias("expires_at_ms"))


def set_first(log: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """SETNX, SET NX: key, value, reply of each write; reply 1 for the first write of a key that doesn't exist yet."""
    first = F.row_number().over(Window.partitionBy("key").orderBy("seq")) == 1
    out = log.withColumn("reply", first.cast("int"))
    if existing is not None:
        known = existing.select("key").distinct().withColumn("known", F.lit(True))
        out = out.join(known, "key", "left").withColumn("reply", F.when(F.col("known"), 0).otherwise(F.col("reply"))).drop("known")
    return out


def set_existing(log: DataFrame, existing: DataFrame) -> DataFrame:
    """SET XX: the latest value of keys that exist; others stay away."""
    return set_last(log.join(existing.select("key").distinct(), "key", "left_semi"))


def get_set(log: DataFrame) -> DataFrame:
    """GETSET, SET GET: each write with `old`, the value before it."""
    return log.withColumn("old", F.lag("value").over(Window.partitionBy("key").orderBy("seq")))


def get(strings: DataFrame, keys: DataFrame) -> DataFrame:
    """GET, MGET: pos, key and value for a list of keys (pos, key); null where a key is absent."""
    return keys.join(strings.select("key", "value"), "key", "left").select("pos", "key", "value")


def append(log: DataFrame) -> DataFrame:
    """APPEND: key, value and length in bytes of all parts of a key, joined in order."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda p: p["value"])
    return log.groupBy("key").agg(F.array_join(parts, "").alias("value")).withColumn("length", strlen(F.col("value")))


def strlen(value: Column) -> Column:
    """STRLEN: bytes; 0 for an absent value."""
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")


def get_range(strings: DataFrame, start: Column | int, end: Column | int) -> DataFrame:
    """GETRANGE: strings with `part`, the bytes start..end."""
    return strings.withColumn("part", byte_range(F.col("value"), start, end))


def set_many(*writes: DataFrame) -> DataFrame:
    """MSET: the latest value of keys out of several batches, the later batch winning; each batch has key, value, seq."""
    out = None
    for k, batch in enumerate(writes):
        one = batch.select("key", "value", F.struct(F.lit(k).alias("batch"), F.col("seq").alias("at")).alias("seq"))
        out = one if out is None else out.unionByName(one)
    return set_last(out)


def increments(log: DataFrame, reset: str | None = None) -> DataFrame:
    """INCR, DECR, INCRBY, DECRBY: each row (key, seq, delta) with `total`, the counter after it.

    reset: a column that is not null where the key is set anew, as text; a counter starts from 0 otherwise.
    Exact as long as no total leaves 64 bits, which a total of null shows; replay() refuses single steps.
    """
    key = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    if reset is None:
        start, generation, out = F.lit(0).cast("long"), [], log
    else:
        out = log.withColumn("generation", F.count(reset).over(key))
        generation = ["generation"]
        start = None
    window = Window.partitionBy("key", *generation).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    if start is None:
        start = F.coalesce(F.first(strict_long(F.col(reset).cast("string")), ignorenulls=True).over(window), F.lit(0))
    step = F.coalesce(F.col("delta"), F.lit(0))
    total = F.sum(step.cast("decimal(38,0)")).over(window) + start
    return out.withColumn("total", F.when(total.between(LONG_MIN, LONG_MAX), total).cast("long"))


def counter_totals(log: DataFrame) -> DataFrame:
    """key and total of all deltas: what increments() ends with, by a partial aggregation."""
    total = F.sum(F.col("delta").cast("decimal(38,0)"))
    return log.groupBy("key").agg(F.when(total.between(LONG_MIN, LONG_MAX), total).cast("long").alias("total"))
