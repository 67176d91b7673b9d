"""Shared plumbing of the corpus operators: checkpoints, bounded broadcasts and bounded Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a small side table is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 20_000
#: A key with more than one row in this many is a hot one; there can be no more hot keys than this.
HOT_KEYS = 10_000
#: Bytes of one Arrow batch sent to a Python worker; a single longer text makes a batch of its own.
BATCH_BYTES = 4 << 20
#: Bytes of a small table that the driver takes from the executors at once.
GATHER_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small by bytes, so that a run of very long texts can't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def released(scan: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """scan, after which its Python worker gives memory that it no longer uses back to the system: idle workers wait for the next task and would keep it from the others of their executor."""

    @wraps(scan)
    def run(batches: Iterator) -> Iterator:
        yield from scan(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return run


def shared_checkpoints(spark: SparkSession) -> None:
    """Makes checkpoint() write to the folder named by spark.checkpoint.dir; only where none is named, as in tests, to a new local one."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Has Spark delete the shuffle files of the actions inside once each is done; later uses of the same plan would make them anew."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)  # None: not set, whatever its default
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder; survives lost executors."""
    shared_checkpoints(df.sparkSession)
    with _tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under the setting: it counts when a plan is made


def cut_small(df: DataFrame) -> DataFrame:
    """cut() of a result much smaller than what it was made from, in an eighth of the shuffle's partitions: fewer, larger files."""
    n = max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    return cut(df.repartition(n))


def _stored(df: DataFrame) -> str:
    """The path of df, written as Parquet to the shared checkpoint folder."""
    spark = df.sparkSession
    shared_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4()}"
    with _tidy(spark):
        df.write.parquet(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared checkpoint folder and read again."""
    return df.sparkSession.read.parquet(_stored(df))


@contextmanager
def passing(df: DataFrame) -> Iterator[DataFrame]:
    """written(df), whose files are deleted at the end: whatever is made from it has to be computed inside."""
    spark, path = df.sparkSession, _stored(df)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def gathered(rows: DataFrame, size: int) -> Iterator[Row]:
    """The rows, of about `size` bytes in all, on the driver: one job makes them, and each further job fetches up to GATHER_BYTES, however many partitions the shuffles have. They are read from files, so that the shuffles that made them can go."""
    with passing(rows.repartition(max(1, -(-size // GATHER_BYTES)))) as kept:
        for file in kept.inputFiles():  # one for each partition that has rows
            yield from rows.sparkSession.read.schema(kept.schema).parquet(unquote(file)).toLocalIterator()


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows, which is counted; else df, and the join shuffles. df should be a cut() one."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """rows with the columns of the table's row of the same keys, null where there is none; null is a key like any other.

    table: keys, each once; `__n`, about how many rows have them; and the columns to be added. A table of
    at most BROADCAST_ROWS rows is broadcast, and nothing is shuffled. Of a larger one hot keys, which are
    fewer than HOT_KEYS by their definition, are broadcast; their rows go on with `spread` in place of
    their key, so no task gets more than a small share of all rows, however they are spread.
    """
    values = [c for c in table.columns if c not in keys and c != "__n"]
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(table.select(*(F.col(c).alias(f"__h{c}") for c in keys), F.struct(*values).alias("__hv")))
        met = rows.join(small, [rows[k].eqNullSafe(small[f"__h{k}"]) for k in keys], "left")
        return met.select(*rows.columns, *(F.col("__hv")[v].alias(v) for v in values))
    total = table.agg(F.sum("__n")).first()[0] or 0
    renamed = lambda t, mark: t.select(*(F.col(c).alias(f"{mark}{c}") for c in keys), F.struct(*values).alias(f"{mark}v"))
    hot = F.broadcast(renamed(table.where(F.col("__n") * HOT_KEYS > total), "__h"))  # fewer than HOT_KEYS rows
    cold = renamed(table.where(F.col("__n") * HOT_KEYS <= total), "__c").withColumn("__cs", F.lit(0).cast("long"))
    met = rows.join(hot, [rows[k].eqNullSafe(hot[f"__h{k}"]) for k in keys], "left").withColumn("__s", F.when(F.col("__hv").isNull(), F.lit(0).cast("long")).otherwise(spread.bitwiseOR(1)))
    met = met.join(cold, [*(met[k].eqNullSafe(cold[f"__c{k}"]) for k in keys), met["__s"] == cold["__cs"]], "left")
    found = F.coalesce("__hv", "__cv")
    return met.select(*rows.columns, *(found[v].alias(v) for v in values))


def apart(taken: Iterable[str], names: Iterable[str]) -> list[str]:
    """The names, each with as many underscores behind it as it takes to differ from those taken and from one another."""
    used, out = set(taken), []
    for n in names:
        while n in used:
            n += "_"
        used.add(n)
        out.append(n)
    return out


def whole_groups(batches, n_keys: int):
    """Tuples of numpy columns out of record batches sorted by their first n_keys columns, cut only between groups of equal keys.

    Yields (columns, starts, ends) with the first row of each group and the row after its last. Of a
    group that goes on in the next batch nothing is yielded before its end.
    """
    def split(columns):
        change = np.zeros(len(columns[0]) - 1, bool)
        for c in columns[:n_keys]:
            change |= c[1:] != c[:-1]
        at = np.flatnonzero(change) + 1
        return np.concatenate([[0], at]), np.concatenate([at, [len(columns[0])]])

    held = []  # batches of one group that has not ended
    for batch in batches:
        if not batch.num_rows:
            continue
        now = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        starts, ends = split(now)
        if held and all(h[-1] == c[0] for h, c in zip(held[0][:n_keys], now)) and len(starts) == 1:
            held.append(now)
            continue
        last = starts[-1]
        whole = tuple(np.concatenate([*(h[k] for h in held), c[:last]]) for k, c in enumerate(now))
        held = [tuple(c[last:] for c in now)]
        if len(whole[0]):
            yield (whole, *split(whole))
    if held:
        whole = tuple(np.concatenate(c) for c in zip(*held))
        yield (whole, *split(whole))


def numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, renamed c0, c1, ..., so that no name of theirs can clash with one that an operator adds."""
    return df.select(*(F.col(f"`{c}`") for c in columns)).toDF(*(f"c{k}" for k in range(len(columns))))
