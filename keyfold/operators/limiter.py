"""Sliding-window rate limits in 64 buckets: RLSET, RLCHECK."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets that a window is divided into.
BUCKETS = 64


@dataclass
class Limiter:
    """One key's limiter. Denied attempts are not counted; a bucket leaves once all of it is older than the window."""

    limit: int
    window_ms: int
    buckets: list[list[int]] = field(default_factory=list)

    def check(self, now: int) -> tuple[int, int, int]:
        """(allowed, remaining, milliseconds to wait)."""
        width = max(1, self.window_ms // BUCKETS)
        oldest = max(0, now - self.window_ms)
        while self.buckets and self.buckets[0][0] + width <= oldest:
            del self.buckets[0]
        used = sum(n for _, n in self.buckets)
        if used >= self.limit:
            wait = self.buckets[0][0] + width + self.window_ms - now if self.buckets else 0
            return 0, 0, min(max(0, wait), self.window_ms)
        start = now - now % width
        if self.buckets and self.buckets[-1][0] == start:
            self.buckets[-1][1] += 1
        else:
            self.buckets.append([start, 1])
        return 1, self.limit - used - 1, 0


def checks(attempts: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """RLCHECK over a log (key, ts_ms, seq): each attempt with allowed, remaining and retry_after_ms.

    Whether an attempt counts depends on those before it, so each key's attempts are walked in order;
    the walk streams over sorted rows and holds one limiter, however many attempts a key has.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, limiter = None, None
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for k, (now_key, ts) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if limiter is None or now_key != key:
                    key, limiter = now_key, Limiter(limit, window_ms)
                out[:, k] = limiter.check(ts)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in out)], names=[*batch.schema.names, "allowed", "remaining", "retry_after_ms"])

    picked = attempts.select("key", "ts_ms", "seq")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema)
    return picked.repartition("key").sortWithinPartitions("key", "ts_ms", "seq").mapInArrow(walk, f"{types}, allowed long, remaining long, retry_after_ms long")


def surely_allowed(attempts: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """A cheap screen: attempts with `sure`, true where even all attempts of the last window and a bucket, denied ones too, stay within the limit."""
    reach = window_ms + max(1, window_ms // BUCKETS)
    n = F.count("*").over(Window.partitionBy("key").orderBy("ts_ms").rangeBetween(-reach, 0))
    return attempts.withColumn("sure", n <= limit)


def check_counts(configs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Of each configured key (upkeep()) its limit, window and attempts (key, ts_ms) in the last window before the latest of them: an upper bound of what the limiter holds."""
    last = attempts.groupBy("key").agg(F.max("ts_ms").alias("last_ms"))
    reach = configs.join(last, "key", "left")
    near = attempts.join(reach.select("key", "last_ms", "window_ms"), "key").where(F.col("ts_ms") > F.col("last_ms") - F.col("window_ms")).groupBy("key").agg(F.count("*").alias("n"))
    return reach.join(near, "key", "left").select("key", "limit", "window_ms", F.coalesce("n", F.lit(0)).alias("n"))


def upkeep(configs: DataFrame) -> DataFrame:
    """RLSET: the latest limit and window of each key (key, limit, window_s, seq)."""
    return configs.groupBy("key").agg(F.max_by(F.struct("limit", (F.col("window_s") * 1000).alias("window_ms")), "seq").alias("c")).select("key", "c.*")
