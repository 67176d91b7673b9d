"""Document boundaries of flat, unindexed token files by a separator scan.

A flat token file is one run of fixed-width token ids in which an end-of-document id closes each
document; nothing says where documents begin. Files are read as blocks of consecutive tokens that take
no heed of documents. Each block is searched for separators in one array comparison. Three prefix scans
over the blocks of a file then stitch them: the sum of tokens gives places, the sum of separators gives
document numbers, and the maximum of the last separator's place gives where a document that began in an
earlier block starts, however many blocks it spans. The scans run in two steps, within groups of
GROUP blocks and over the groups, so a very large file is no single task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyfold.llm.runtime import bounded_batches, cut

BLOCK_TOKENS = 1 << 20
GROUP = 1_024
#: Bytes of a raw file that is read whole where its file system can't be read by ranges; larger ones are refused there.
MAX_FILE_BYTES = 1 << 30
_KINDS = {1: np.uint8, 2: np.dtype("<u2"), 4: np.dtype("<u4")}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!//)/*", "file:///", path))


def read_flat_tokens(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, tokens: the blocks of raw token files, of `width` bytes a token in little-endian order.

    Files are listed without their contents, and each block is read by its range of bytes in a task of its
    own, so a file may have any size. Only where the workers can't open the paths by themselves are files
    read whole, up to MAX_FILE_BYTES. A file that ends within a token fails the query. Empty files have no block.
    """
    size = block_tokens * width
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    files = files.withColumn("length", F.when(F.col("length") % width == 0, F.col("length")).otherwise(F.raise_error(F.concat(F.lit("ends within a token: "), F.col("path"))).cast("long")))
    listed = files.select("path", "length")
    numbers = F.explode(F.expr(f"transform(sequence(0, (length - 1) div {size}), b -> cast(b as int))")).alias("block")
    some = listed.select("path").limit(1).collect()
    try:
        ranged = not some or _opened(some[0]["path"]) is not None
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        ranged = False
    if not ranged:
        small = files.where(F.when(F.col("length") > MAX_FILE_BYTES, F.raise_error(F.concat(F.lit("file too large: "), F.col("path"))).cast("boolean")).otherwise(True))
        return small.select(F.col("path").alias("file"), "content", numbers).select("file", "block", F.expr(f"substring(content, cast(block as int) * {size} + 1, {size})").alias("tokens"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block in zip(*(c.to_pylist() for c in batch.columns)):
                system, inner = _opened(file)
                with system.open_input_file(inner) as f:
                    f.seek(block * size)
                    data = f.read(size)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int32()), pa.array([data], pa.binary())], names=["file", "block", "tokens"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.select(F.col("path").alias("file"), numbers).repartition(n, "file", "block").mapInArrow(read, "file string, block int, tokens binary")


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], eod: int, width: int = 2, block_tokens: int = BLOCK_TOKENS, text: str = "text") -> DataFrame:
    """Documents as flat token files, one for each partition: rows of (file, block, tokens) and, with tokens null, (file, first, ids), the ids of documents from number `first` on.

    encoder() is called once in a worker and gives a function from a text to its ids, none of them eod.
    A null text has no tokens but its separator.
    """
    bounded_batches(docs.sparkSession)
    kind = _KINDS[width]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = encoder(), TaskContext.get().partitionId()
        held, n, block, first, ids = [], 0, 0, 0, []

        def row(block=None, tokens=None, first=None, ids=None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int32()), pa.array([tokens], pa.binary()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "block", "tokens", "first", "ids"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.asarray(encode(t.as_py() or ""))
                held += [found.astype(kind), np.array([eod], kind)]
                n += len(found) + 1
                ids.append(i)
                if n >= block_tokens:
                    flat = np.concatenate(held)
                    for a in range(0, n - block_tokens + 1, block_tokens):
                        yield row(block=block, tokens=flat[a : a + block_tokens].tobytes())
                        block += 1
                    held = [flat[len(flat) // block_tokens * block_tokens :]]
                    n = len(held[0])
            if ids:
                yield row(first=first, ids=ids)
                first, ids = first + len(ids), []
        if n:
            yield row(block=block, tokens=np.concatenate(held).tobytes())

    return docs.select("doc_id", F.col(text).alias("t")).mapInArrow(write, "file long, block int, tokens binary, first long, ids array<long>")


def block_separators(blocks: DataFrame, eod: int, width: int = 2, rest: tuple[str, ...] = ()) -> DataFrame:
    """`rest` columns, file, block, n (tokens) and seps (places of separators in the block, ascending); null in both for a row without tokens."""
    bounded_batches(blocks.sparkSession)
    kind = _KINDS[width]
    picked = blocks.select(*rest, "file", "block", "tokens")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for cell in batch.column(batch.num_columns - 1):
                if not cell.is_valid:
                    counts.append(None)
                    found.append(None)
                    continue
                tokens = np.frombuffer(cell.as_buffer(), kind)
                counts.append(len(tokens))
                found.append(np.flatnonzero(tokens == eod).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "n", "seps"])

    return picked.mapInArrow(search, f"{types}, n int, seps array<int>")


def stitched(found: DataFrame) -> DataFrame:
    """file, ordinal (from 0), start, n_tokens and ended of every document; found: file, block, n, seps.

    Places count tokens of the file from 0 and separators are in no document's count. Tokens after the
    last separator are a document that has not ended. An empty file has none.
    """
    col = F.col
    each = found.withColumn("group", F.expr(f"block div {GROUP}"))
    inner = Window.partitionBy("file", "group").orderBy("block")
    back = inner.rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({"t": F.coalesce(F.sum("n").over(back), F.lit(0)), "s": F.coalesce(F.sum(F.size("seps")).over(back), F.lit(0))})
    each = each.withColumn("last", F.when(F.size("seps") > 0, col("t") + F.element_at("seps", -1)))  # place in the group
    each = each.withColumn("l", F.max("last").over(back))
    groups = each.groupBy("file", "group").agg(F.sum("n").alias("gn"), F.sum(F.size("seps")).alias("gs"), F.max("last").alias("gl"))
    outer = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumns({"gt": F.coalesce(F.sum("gn").over(outer), F.lit(0)), "g0": F.coalesce(F.sum("gs").over(outer), F.lit(0))})
    groups = groups.withColumn("before", F.max(col("gt") + col("gl")).over(outer)).withColumn("is_last", col("group") == F.max("group").over(Window.partitionBy("file")))
    both = each.join(groups.select("file", "group", "gt", "g0", "before", "is_last"), ["file", "group"])
    both = both.withColumns({"at": col("gt") + col("t"), "base": col("g0") + col("s"), "begun": F.coalesce(col("gt") + col("l"), col("before"), F.lit(-1)) + 1})
    block_end = col("at") + col("n")
    # A document that has not ended is closed at the end of the file's last block.
    open_at = F.when(F.size("seps") > 0, col("at") + F.element_at("seps", -1) + 1).otherwise(col("begun"))
    is_end = col("is_last") & (col("block") == F.max("block").over(Window.partitionBy("file", "group")))
    both = both.withColumns({"open_at": open_at, "open_n": F.when(is_end, block_end - open_at).otherwise(0)})
    ended = F.transform("seps", lambda s, k: F.struct((col("base") + k).alias("ordinal"), F.when(k == 0, col("begun")).otherwise(col("at") + F.get("seps", k - 1) + 1).alias("start"), (col("at") + s).alias("end"), F.lit(True).alias("ended")))
    tail = F.when(col("open_n") > 0, F.array(F.struct((col("base") + F.size("seps")).alias("ordinal"), col("open_at").alias("start"), block_end.alias("end"), F.lit(False).alias("ended")))).otherwise(F.array())
    rows = both.select("file", F.explode(F.concat(ended, tail)).alias("x"))
    return rows.select("file", "x.ordinal", "x.start", (col("x.end") - col("x.start")).alias("n_tokens"), "x.ended")


def scan_separators(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """stitched() of blocks (file, block, tokens), numbered from 0 without gaps in each file."""
    return stitched(cut(block_separators(blocks, eod, width)))


def count_tokens(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], eod: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, file, ordinal, start and n_tokens of every document, from flat token files made of docs (doc_id, text).

    The token blocks pass from the packing to the scan within a task; only places of separators and ids
    of documents are kept. Repeated rows are documents of their own; null ids stay null. No rows: no rows.
    """
    packed = pack(docs, encoder, eod, width, block_tokens)
    found = cut(block_separators(packed, eod, width, rest=("first", "ids")))
    scanned = stitched(found.where("n is not null").select("file", "block", "n", "seps"))
    named = found.where("n is null").select("file", F.posexplode("ids").alias("k", "doc_id"), "first").select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return named.join(scanned, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
