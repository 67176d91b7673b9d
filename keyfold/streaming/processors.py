"""Keyed state over command streams, for transformWithStateInPandas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keyfold.functions.glob import glob, glob_column
from keyfold.operators.limiter import Limiter


def _with_state(grouped, processor: StatefulProcessor, schema, idle_ms: int | None) -> DataFrame:
    """Without idle_ms state is kept for good and batches run only for new rows; with it, silent keys' state goes after that time, which takes batches without rows too."""
    return grouped.transformWithStateInPandas(processor, schema, "Append", "None" if idle_ms is None else "ProcessingTime")


class Once(StatefulProcessor):
    """DEDUP: passes on rows (client, id, ...) whose id is above all earlier ones of the client."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "id long", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = self.mark.get()[0] if self.mark.exists() else None
        batch = pd.concat(rows).sort_values("seq", kind="stable")
        keep = []
        for id_ in batch["id"]:
            fresh = mark is None or id_ > mark
            keep.append(fresh)
            mark = id_ if fresh else mark
        self.mark.update((int(mark),))
        yield batch[keep]

    def close(self) -> None:
        pass


def once(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The first delivery of each row (client, id, seq, and whatever else)."""
    return _with_state(stream.groupBy("client"), Once(idle_ms), stream.schema, idle_ms)


class Checks(StatefulProcessor):
    """RLCHECK: each attempt (key, ts_ms, seq) with its answer."""

    def __init__(self, limit: int, window_ms: int, idle_ms: int | None = None):
        self.limit, self.window_ms, self.idle_ms = limit, window_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buckets = handle.getValueState("buckets", "starts array<long>, counts array<long>", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        limiter = Limiter(self.limit, self.window_ms)
        if self.buckets.exists():
            limiter.buckets = [[int(s), int(n)] for s, n in zip(*self.buckets.get())]
        batch = pd.concat(rows).sort_values(["ts_ms", "seq"], kind="stable")
        answers = [limiter.check(int(t)) for t in batch["ts_ms"]]
        self.buckets.update(([s for s, _ in limiter.buckets], [n for _, n in limiter.buckets]))
        yield batch.assign(**{n: [a[k] for a in answers] for k, n in enumerate(("allowed", "remaining", "retry_after_ms"))})

    def close(self) -> None:
        pass


def checks(stream: DataFrame, limit: int, window_ms: int, idle_ms: int | None = None) -> DataFrame:
    """The answer to each attempt (key, ts_ms, seq)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + ", allowed long, remaining long, retry_after_ms long"
    return _with_state(stream.groupBy("key"), Checks(limit, window_ms, idle_ms), schema, idle_ms)


def live_changes(stream: DataFrame, pattern: str, after_seq: int = -1) -> DataFrame:
    """QSUB on a stream of changes (seq, key, value): the matching ones after the snapshot's place."""
    return stream.where((F.col("seq") > after_seq) & glob(F.col("key"), pattern))


def published(stream: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """PUBLISH on a stream of messages (seq, channel, payload): a row for each open subscription (conn_id, kind, pattern) it reaches."""
    exact = stream.join(subscriptions.where("kind = 'exact'").withColumnRenamed("pattern", "channel"), "channel")
    patterns = stream.join(subscriptions.where("kind = 'pattern'"), glob_column(F.col("channel"), F.col("pattern")))
    out = ["seq", "channel", "payload", "conn_id", "kind"]
    return exact.select(*out).unionByName(patterns.select(*out))


class Latest(StatefulProcessor):
    """SET, DEL and expiry on a stream of writes (key, seq, value, expires_at_ms; a null value removes): each change, and at the expiry one without value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "seq long, value string, expires_at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values("seq", kind="stable")
        last = batch.iloc[-1]
        expires = None if pd.isna(last["expires_at_ms"]) else int(last["expires_at_ms"])
        value = None if pd.isna(last["value"]) else last["value"]
        self.state.update((int(last["seq"]), value, expires))
        if expires is not None:
            self.handle.registerTimer(expires)
        yield batch[["key", "seq", "value"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            seq, value, expires = self.state.get()
            if value is not None and expires is not None and expires <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.clear()
                yield pd.DataFrame({"key": [key[0]], "seq": [seq], "value": [None]})

    def close(self) -> None:
        pass


def latest(stream: DataFrame) -> DataFrame:
    """The changes of each key, and its removal when it expires."""
    return stream.select("key", "seq", "value", "expires_at_ms").groupBy("key").transformWithStateInPandas(Latest(), "key string, seq long, value string", "Append", "ProcessingTime")


def upsert_sink(path: str):
    """For foreachBatch: keeps the last change (key, seq, value) of each key in Parquet under path, once for each batch however often it is run."""

    def write(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("key").agg(F.max_by(F.struct("seq", "value"), "seq").alias("c")).select("key", "c.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def state_of_sink(changes: DataFrame) -> DataFrame:
    """key and value of what upsert_sink() wrote, read as one table."""
    return changes.groupBy("key").agg(F.max_by(F.struct("value"), F.struct("seq", "batch")).alias("c")).select("key", "c.value").where("value is not null")
