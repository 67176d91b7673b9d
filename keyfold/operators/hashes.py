"""Hashes: elements (key, field, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyfold.functions.glob import glob
from keyfold.functions.numbers import strict_long


def set_fields(log: DataFrame) -> DataFrame:
    """HSET, HMSET: the latest value of each field; log: key, field, value, seq."""
    return log.groupBy("key", "field").agg(F.max_by("value", "seq").alias("value"))


def set_new_fields(log: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """HSETNX: the first value of each field that isn't there yet."""
    fresh = log if existing is None else log.join(existing.select("key", "field"), ["key", "field"], "left_anti")
    return fresh.groupBy("key", "field").agg(F.min_by("value", "seq").alias("value"))


def get_all(hashes: DataFrame) -> DataFrame:
    """HGETALL, HKEYS, HVALS, HLEN: key, fields and vals (arrays in order of fields) and length."""
    pairs = F.sort_array(F.collect_list(F.struct("field", "value")))
    return hashes.groupBy("key").agg(pairs.alias("p")).select("key", F.transform("p", lambda x: x["field"]).alias("fields"), F.transform("p", lambda x: x["value"]).alias("vals"), F.size("p").cast("long").alias("length"))


def get_fields(hashes: DataFrame, named: DataFrame) -> DataFrame:
    """HGET, HMGET, HEXISTS: named (pos, key, field) with value, null where absent, and present."""
    found = hashes.select("key", "field", "value", F.lit(True).alias("present"))
    return named.join(found, ["key", "field"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def delete_fields(hashes: DataFrame, named: DataFrame) -> DataFrame:
    """HDEL: what stays. A key whose last field goes is still a key: keys live in their own table."""
    return hashes.join(named.select("key", "field").distinct(), ["key", "field"], "left_anti")


def increment_fields(log: DataFrame) -> DataFrame:
    """HINCRBY: total of each field; log: key, field, delta and, where a field is set, value. A value that is no integer counts as 0."""
    w = Window.partitionBy("key", "field").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    marked = log.withColumn("generation", F.count("value").over(w))
    last = Window.partitionBy("key", "field")
    here = marked.withColumn("last", F.max("generation").over(last)).where(F.col("generation") == F.col("last"))
    start = F.coalesce(strict_long(F.max("value")), F.lit(0))
    return here.groupBy("key", "field").agg((start + F.coalesce(F.sum("delta"), F.lit(0))).alias("total"))


def increment_float_fields(log: DataFrame) -> DataFrame:
    """HINCRBYFLOAT: the sum of each field; null where it is NaN or infinite."""
    total = F.sum("delta")
    return log.groupBy("key", "field").agg(F.when(~F.isnan(total) & (F.abs(total) != float("inf")), total).alias("total"))


def scan_fields(hashes: DataFrame, pattern: str = "*", values: bool = True) -> DataFrame:
    """HSCAN MATCH [NOVALUES]: matching fields of all keys, to be paged by keys.pages()."""
    found = hashes.where(glob(F.col("field"), pattern))
    return found.select("key", "field", "value") if values else found.select("key", "field")
