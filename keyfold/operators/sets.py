"""Sets: distinct elements (key, member)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def add(log: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """SADD: the members after the log's additions."""
    rows = log.select("key", "member")
    return (rows if existing is None else existing.select("key", "member").unionByName(rows)).distinct()


def members(sets: DataFrame) -> DataFrame:
    """SMEMBERS, SCARD: key, members (sorted) and size."""
    return sets.groupBy("key").agg(F.sort_array(F.collect_list("member")).alias("members"), F.count("*").alias("size"))


def cardinality(log: DataFrame) -> DataFrame:
    """SCARD of sets built by a log of additions, without building them first."""
    return add(log).groupBy("key").agg(F.count("*").alias("size"))


def contains(sets: DataFrame, named: DataFrame) -> DataFrame:
    """SISMEMBER, SMISMEMBER: named (pos, key, member) with present 1 or 0."""
    there = sets.select("key", "member", F.lit(1).alias("present"))
    return named.join(there, ["key", "member"], "left").withColumn("present", F.coalesce("present", F.lit(0)))


def remove(sets: DataFrame, named: DataFrame) -> DataFrame:
    """SREM: what stays."""
    return sets.join(named.select("key", "member").distinct(), ["key", "member"], "left_anti")


def _of(sets: DataFrame, key: str) -> DataFrame:
    return sets.where(F.col("key") == F.lit(key)).select("member")


def intersection(sets: DataFrame, keys: list) -> DataFrame:
    """SINTER: members in all of the named sets; one missing set gives none. One aggregation whatever the number of sets."""
    wanted = sorted(set(keys), key=str)
    hit = sets.where(F.col("key").isin(wanted)).groupBy("member").agg(F.count_distinct("key").alias("n"))
    return hit.where(F.col("n") == len(wanted)).select("member")


def union(sets: DataFrame, keys: list) -> DataFrame:
    """SUNION: members in any of the named sets."""
    return sets.where(F.col("key").isin(list(keys))).select("member").distinct()


def difference(sets: DataFrame, keys: list) -> DataFrame:
    """SDIFF: members of the first set that are in none of the others."""
    first = _of(sets, keys[0])
    return reduce(lambda a, k: a.join(_of(sets, k), "member", "left_anti"), keys[1:], first).distinct()


def store(sets: DataFrame, destination: str, result: DataFrame) -> DataFrame:
    """SINTERSTORE, SUNIONSTORE, SDIFFSTORE: the sets with the result in place of the destination."""
    return sets.where(F.col("key") != F.lit(destination)).select("key", "member").unionByName(result.select(F.lit(destination).alias("key"), "member"))


def move(sets: DataFrame, moves: DataFrame) -> DataFrame:
    """SMOVE: the sets after independent moves (source, target, member); members that aren't in their source stay away."""
    real = moves.join(sets.select(F.col("key").alias("source"), "member"), ["source", "member"], "left_semi")
    kept = remove(sets, real.where("source <> target").select(F.col("source").alias("key"), "member"))
    return add(real.select(F.col("target").alias("key"), "member"), kept)


def _drawn(seed: int, *parts: str) -> Column:
    """60 bits of a seeded digest of the parts, the same in every engine that knows MD5."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), *(F.col(p).cast("string") for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def sample(sets: DataFrame, n: int, seed: int) -> DataFrame:
    """SPOP, SRANDMEMBER n >= 0: n members of each set, chosen by a seeded digest, with rank; a rerun chooses the same."""
    return sets.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(_drawn(seed, "key", "member"), "member"))).where(F.col("rank") <= n)


def sample_with_repeats(sets: DataFrame, n: int, seed: int) -> DataFrame:
    """SRANDMEMBER -n: n draws (draw, member) from each set, where a member may come again."""
    ranked = sets.withColumn("rank", (F.row_number().over(Window.partitionBy("key").orderBy("member")) - 1).cast("long"))
    sizes = sets.groupBy("key").agg(F.count("*").alias("size"))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("rank", F.pmod(_drawn(seed, "key", "draw"), F.col("size")))
    return draws.join(ranked, ["key", "rank"]).select("key", "draw", "member")
