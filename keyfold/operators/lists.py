"""Lists: elements (key, pos, value), in order of pos, which may have gaps and be negative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyfold.functions.ranges import bounds, position


def _all():
    return Window.partitionBy("key")


def _order():
    return _all().orderBy("pos")


def push(log: DataFrame) -> DataFrame:
    """LPUSH, RPUSH: elements out of a log (key, seq, value, side `left` or `right`) of pushes alone."""
    n = F.row_number().over(Window.partitionBy("key", "side").orderBy("seq")).cast("long")
    return log.withColumn("pos", F.when(F.col("side") == "left", -n).otherwise(n - 1)).select("key", "pos", "value")


def push_existing(lists: DataFrame, log: DataFrame) -> DataFrame:
    """LPUSHX, RPUSHX: lists with the log's values at their ends, but only for keys that are there."""
    ends = lists.groupBy("key").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    new = push(log).join(ends, "key")
    moved = new.select("key", F.when(F.col("pos") < 0, F.col("lo") + F.col("pos")).otherwise(F.col("hi") + 1 + F.col("pos")).alias("pos"), "value")
    return lists.select("key", "pos", "value").unionByName(moved)


def indexed(lists: DataFrame) -> DataFrame:
    """LLEN, LINDEX: elements with index (from 0) and length."""
    return lists.withColumns({"index": (F.row_number().over(_order()) - 1).cast("long"), "length": F.count("*").over(_all())})


def element(lists: DataFrame, index: Column | int) -> DataFrame:
    """LINDEX: the element of each list at an index, negative from the end."""
    return indexed(lists).where(F.col("index") == position(index, F.col("length")))


def in_range(lists: DataFrame, start: Column | int, stop: Column | int) -> DataFrame:
    """LRANGE, LTRIM: the elements start..stop of each list, with index and length."""
    first, last = bounds(start, stop, F.col("length"))
    return indexed(lists).where((F.col("index") >= first) & (F.col("index") <= last))


def pop(lists: DataFrame, n: int = 1, side: str = "left") -> DataFrame:
    """LPOP, RPOP: elements with `popped` and, for these, `rank` in the reply (from 0)."""
    order = _order() if side == "left" else _all().orderBy(F.col("pos").desc())
    rank = (F.row_number().over(order) - 1).cast("long")
    return lists.withColumn("rank", rank).withColumn("popped", F.col("rank") < n)


def set_element(lists: DataFrame, index: Column | int, value: Column) -> DataFrame:
    """LSET: lists with the element at the index replaced; lists without such an index stay as they are."""
    at = F.col("index") == position(index, F.col("length"))
    return indexed(lists).withColumn("value", F.when(at, value).otherwise(F.col("value")))


def remove(lists: DataFrame, n: int, value: str) -> DataFrame:
    """LREM: what stays after n equal values went from the head (n > 0), the tail (n < 0) or altogether (0)."""
    same = F.col("value").eqNullSafe(F.lit(value))
    if n == 0:
        return lists.where(~same)
    order = F.col("pos") if n > 0 else F.col("pos").desc()
    rank = F.row_number().over(Window.partitionBy("key", same).orderBy(order))
    return lists.withColumn("rank", rank).where(~same | (F.col("rank") > abs(n))).drop("rank")
