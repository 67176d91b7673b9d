"""Sorted sets: elements (key, member, score), ordered by score, then member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyfold.functions.numbers import score_between
from keyfold.functions.ranges import bounds

#: Least change of a score that counts as one.
EPSILON = 2.0**-52


def _order(reverse: bool) -> list[Column]:
    return [F.col("score").desc(), F.col("member").desc()] if reverse else [F.col("score"), F.col("member")]


def add(log: DataFrame, mode: str = "last") -> DataFrame:
    """ZADD: member scores after a log (key, member, score, seq) of writes in one mode: last, first (NX), greatest (GT), least (LT) or sum (INCR, ZINCRBY)."""
    score = {"last": F.max_by("score", "seq"), "first": F.min_by("score", "seq"), "greatest": F.max("score"), "least": F.min("score"), "sum": F.sum("score")}[mode]
    return log.groupBy("key", "member").agg(score.alias("score"))


def add_existing(zsets: DataFrame, log: DataFrame) -> DataFrame:
    """ZADD XX: new scores for members that are there; others are not added."""
    new = add(log).withColumnRenamed("score", "new")
    return zsets.join(new, ["key", "member"], "left").select("key", "member", F.coalesce("new", "score").alias("score"))


def changes(log: DataFrame) -> DataFrame:
    """ZADD CH: of each key, `added` and `changed`, the writes that added a member and those that added or moved one."""
    old = F.lag("score").over(Window.partitionBy("key", "member").orderBy("seq"))
    step = log.withColumn("old", old)
    moved = F.col("old").isNull() | (F.abs(F.col("score") - F.col("old")) > EPSILON)
    return step.groupBy("key").agg(F.count_if(F.col("old").isNull()).alias("added"), F.count_if(moved).alias("changed"))


def ranked(zsets: DataFrame, reverse: bool = False) -> DataFrame:
    """ZRANK, ZREVRANK: elements with rank from 0."""
    return zsets.withColumn("rank", (F.row_number().over(Window.partitionBy("key").orderBy(*_order(reverse))) - 1).cast("long"))


def both_ranks(zsets: DataFrame) -> DataFrame:
    """ZRANK, ZREVRANK: elements with rank and revrank."""
    sizes = zsets.groupBy("key").agg(F.count("*").alias("size"))
    return ranked(zsets).join(sizes, "key").withColumn("revrank", F.col("size") - 1 - F.col("rank")).drop("size")


def by_rank(zsets: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """ZRANGE, ZREVRANGE: elements of the ranks start..stop, with rank. Where both are negative or neither is, only the first few of each key, from the one end or the other, are ever kept."""
    out = ranked(zsets, reverse)
    if start >= 0 and stop >= 0:
        return out.where((F.col("rank") <= stop) & (F.col("rank") >= start))
    if start < 0 and stop < 0:
        from_end = ranked(zsets, not reverse).where((F.col("rank") <= -start - 1) & (F.col("rank") >= -stop - 1))
        sizes = zsets.groupBy("key").agg(F.count("*").alias("size"))
        return from_end.join(sizes, "key").withColumn("rank", F.col("size") - 1 - F.col("rank")).drop("size")
    first, last = bounds(start, stop, F.count("*").over(Window.partitionBy("key")))
    return out.withColumns({"first": first, "last": last}).where((F.col("rank") >= F.col("first")) & (F.col("rank") <= F.col("last"))).drop("first", "last")


def by_score(zsets: DataFrame, low: str, high: str, offset: int = 0, limit: int = -1, reverse: bool = False) -> DataFrame:
    """ZRANGEBYSCORE, ZREVRANGEBYSCORE, LIMIT: elements between the bounds in order, with rank among them."""
    out = ranked(zsets.where(score_between(F.col("score"), low, high)), reverse)
    start = max(0, offset)
    out = out.where(F.col("rank") >= start)
    return out if limit < 0 else out.where(F.col("rank") < start + limit)


def count(zsets: DataFrame, low: str, high: str) -> DataFrame:
    """ZCOUNT, ZCARD: of each key, `n` elements between the bounds and `size`."""
    return zsets.groupBy("key").agg(F.count_if(score_between(F.col("score"), low, high)).alias("n"), F.count("*").alias("size"))


def scores(zsets: DataFrame, named: DataFrame) -> DataFrame:
    """ZSCORE, ZMSCORE: named (pos, key, member) with score, null where absent."""
    return named.join(zsets.select("key", "member", "score"), ["key", "member"], "left")


def remove(zsets: DataFrame, named: DataFrame) -> DataFrame:
    """ZREM: what stays."""
    return zsets.join(named.select("key", "member").distinct(), ["key", "member"], "left_anti")
