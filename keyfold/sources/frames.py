"""Command logs as RESP frames: `*n`, then n times `$length` and the bytes, each closed by CR LF."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of a frame: parts, and bytes of a part.
MAX_PARTS = 1_000_000
MAX_BYTES = 64 << 20
#: Bytes of a log file that one task parses; longer logs come as several files.
MAX_FILE_BYTES = 1 << 30


def encode(parts: Iterable[bytes]) -> bytes:
    parts = list(parts)
    return b"".join([b"*%d\r\n" % len(parts), *(b"$%d\r\n%s\r\n" % (len(p), p) for p in parts)])


def decode(data: bytes) -> Iterator[list[bytes]]:
    """The frames at the head of data; ends at the first that is cut off or is no frame."""

    def number(at: int, mark: bytes, most: int) -> tuple[int, int] | None:
        end = data.find(b"\r\n", at)
        if end < 0 or data[at : at + 1] != mark or not data[at + 1 : end].isdigit() or int(data[at + 1 : end]) > most:
            return None
        return int(data[at + 1 : end]), end + 2

    at = 0
    while (head := number(at, b"*", MAX_PARTS)) is not None:
        n, at = head
        parts = []
        for _ in range(n):
            size = number(at, b"$", MAX_BYTES)
            if size is None or data[size[1] + size[0] : size[1] + size[0] + 2] != b"\r\n":
                return
            parts.append(data[size[1] : size[1] + size[0]])
            at = size[1] + size[0] + 2
        yield parts


def read_log(spark: SparkSession, path: str, ts_ms: int = 0) -> DataFrame:
    """seq, ts_ms, cmd, args, txn_id of log files in order of their paths. Frames carry no times: all get ts_ms."""
    files = spark.read.format("binaryFile").load(path)
    names = [r["path"] for r in files.select("path", "length").where(F.when(F.col("length") > MAX_FILE_BYTES, F.raise_error(F.lit("log file too large")).cast("boolean")).otherwise(True)).orderBy("path").collect()]
    place = {n: k << 40 for k, n in enumerate(names)}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [{"seq": place[name] + k, "ts_ms": ts_ms, "cmd": f[0].decode(errors="replace"), "args": f[1:], "txn_id": None} for k, f in enumerate(decode(data)) if f]
                for a in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[a : a + 10_000], pa.schema([("seq", pa.int64()), ("ts_ms", pa.int64()), ("cmd", pa.string()), ("args", pa.list_(pa.binary())), ("txn_id", pa.int64())]))

    return files.select("path", "content").mapInArrow(parse, "seq long, ts_ms long, cmd string, args array<binary>, txn_id long")


def frame_rows(log: DataFrame) -> DataFrame:
    """seq and frame (binary) of a log: what a file or socket sink writes one after the other."""
    part = lambda p: F.concat(F.encode(F.concat(F.lit("$"), F.octet_length(p), F.lit("\r\n")), "UTF-8"), p, F.lit(b"\r\n"))
    parts = F.concat(F.array(F.encode("cmd", "UTF-8")), F.col("args"))
    body = F.aggregate(F.transform(parts, part), F.encode(F.concat(F.lit("*"), F.size(parts), F.lit("\r\n")), "UTF-8"), lambda acc, p: F.concat(acc, p))
    return log.select("seq", body.alias("frame"))
