"""Snapshots of a state table: SAVE, BGSAVE, LASTSAVE and loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.operators.keys import live


def save(state: DataFrame, path: str, seq: int, now_ms: int) -> None:
    """Writes the live rows as the snapshot of all commands up to seq, by kind and sorted by key; it counts once it is whole."""
    rows = live(state, now_ms).withColumn("saved_ms", F.lit(now_ms).cast("long"))
    rows.repartition("kind", "key").sortWithinPartitions("kind", "key").write.partitionBy("kind").parquet(f"{path}/seq={seq}")


def _saved(spark: SparkSession, path: str) -> list[int]:
    """Places in the log of all whole snapshots, the last one last."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[4:]) for n in names if n.startswith("seq=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def load(spark: SparkSession, path: str, now_ms: int) -> tuple[DataFrame, int]:
    """(live rows of the last snapshot, its place in the log): the log after that place is to be replayed. No snapshot: no rows and -1."""
    schema = "key string, payload binary, expires_at_ms long, saved_ms long, kind string"
    found = _saved(spark, path)
    rows = spark.read.schema(schema).parquet(f"{path}/seq={found[-1]}") if found else spark.createDataFrame([], schema)
    return live(rows, now_ms).select("key", "kind", "payload", "expires_at_ms"), found[-1] if found else -1


def last_save(spark: SparkSession, path: str) -> int | None:
    """LASTSAVE: seconds since 1970, or None."""
    found = _saved(spark, path)
    if not found:
        return None
    row = spark.read.parquet(f"{path}/seq={found[-1]}").agg(F.max("saved_ms")).first()
    return None if row[0] is None else row[0] // 1000


def save_due(conditions: list[tuple[int, int]], seconds: int, changes: int) -> bool:
    """Whether any (seconds, changes) condition is met since the last save."""
    return any(seconds >= s and changes >= n for s, n in conditions)
