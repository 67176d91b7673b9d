"""Mixing sources to target weights, in blocks of words.

The texts of a source, laid end to end in a fixed order, are cut into blocks of `block_words` words. A
mix is a row of slots, each of which takes one block of one source; a shard is a run of `shard_slots`
slots. How many slots of each source a shard has is a multinomial draw, conditioned on the sources' totals (a
multivariate hypergeometric one), so that the totals meet the targets: shards are halved from the whole
down, source by source, each half drawn from a seed of its own, and any shard finds its counts by
itself. One law and one way of drawing serve all sizes.
The j-th slot of a source takes block P(j mod n) of its n blocks, where P is a pseudorandom
permutation keyed by the source and by j div n: every block is taken once before any is taken twice.
Slots and blocks are then joined by (source, block).

Places in a source come from running sums in two steps, over chunks of rows and within them, so that a
source with a third of all rows is no single task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keyfold.llm.runtime import bounded_batches, looked_up, released, written
from keyfold.llm.textblocks import blocks, mix

WEIGHTS = (1, 2, 3)
#: Times its size that a source is taken at most.
CEILING = 3
BLOCK_WORDS = 128
SHARD_SLOTS = 1 << 14
SEED = 7
#: Sources that a mix may have; their table is held on the driver.
MAX_SOURCES = 100_000
#: Rows of a chunk of the running sums, about.
CHUNK_ROWS = 2_048
#: Chunks of a group of the running sums.
GROUP_CHUNKS = 65_536


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, ceiling: int = CEILING) -> list[float]:
    """Words to take from each source: shares of all words by repeating weights, at most ceiling * size, the excess shared anew by weight."""
    share = [float(weights[k % len(weights)]) for k in range(len(sizes))]
    out = [0.0] * len(sizes)
    open_ = [k for k in range(len(sizes)) if sizes[k]]
    left = float(sum(sizes))
    while open_:
        total = sum(share[k] for k in open_)
        over = [k for k in open_ if left * share[k] / total > ceiling * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * share[k] / total
            break
        for k in over:
            out[k] = float(ceiling * sizes[k])
        left -= sum(out[k] for k in over)
        open_ = [k for k in open_ if k not in set(over)]
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the given places: a four-round Feistel network, walked until it is below n."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & low
        for r in range(4):
            left, right = right, left ^ (mix(right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & low)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _stirling(k: int) -> float:
    """log(k!) less Stirling's formula."""
    if k == 0:
        return 0.0
    if k < 16:
        return math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * k * k)) / (k * k)) / (k * k)) / k


def _deviance(k: int, mean: float) -> float:
    """k log(k / mean) + mean - k, precise where k is near the mean, too."""
    if abs(k - mean) < 0.1 * (k + mean):
        v = (k - mean) / (k + mean)
        out, term, j = (k - mean) * v, 2 * k * v, 1
        while True:
            term *= v * v
            more = out + term / (2 * j + 1)
            if more == out:
                return out
            out, j = more, j + 1
    return (k * math.log(k / mean) if k else 0.0) + mean - k


def _log_binomial(x: int, n: int, p: float) -> float:
    """Log of the probability of x successes in n at p in (0, 1), by deviances, which keep their precision however large n is."""
    y = n - x
    if x == 0:
        return n * math.log1p(-p)
    if y == 0:
        return n * math.log(p)
    return _stirling(n) - _stirling(x) - _stirling(y) - _deviance(x, n * p) - _deviance(y, n * (1 - p)) - 0.5 * math.log(2 * math.pi * x * (y / n))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` out of good + bad are good. Rejection from a flat top with exponential tails, which lies above any log-concave law; a few tries at any size."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    p = drawn / total
    whole = _log_binomial(drawn, total, p)
    log_p = lambda x: _log_binomial(x, good, p) + _log_binomial(drawn - x, bad, p) - whole
    mode = min(max((drawn + 1) * (good + 1) // (total + 2), low), high)
    top = log_p(mode)
    height = math.exp(top)
    flat = 1 + height / 2
    while True:
        u, v, w, sign = rng.random(4)
        if u <= flat / (1 + flat):
            far, hat = v * flat / height, 0.0
        else:
            e = -math.log1p(-v)
            far, hat = (flat + e) / height, -e
        x = mode + int(far + 0.5) * (1 if sign < 0.5 else -1)
        if low <= x <= high and math.log(w or 5e-324) + hat <= log_p(x) - top:
            return x


@lru_cache(maxsize=4_096)
def _half(counts: tuple[int, ...], slots: int, seed: int, lo: int, hi: int) -> tuple[int, ...]:
    """How many of each source's slots are among the first `slots` of all."""
    rng = np.random.default_rng([seed, lo, hi])
    rest, out = sum(counts), []
    for n in counts:
        rest -= n
        k = hypergeometric(rng, n, rest, slots)
        slots -= k
        out.append(k)
    return tuple(out)


def shard_counts(shard: int, totals: np.ndarray, shard_slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For one shard, the first slot number of each source and its number of slots."""
    counts, first = tuple(int(n) for n in totals), np.zeros(len(totals), np.int64)
    lo, hi = 0, -(-sum(counts) // shard_slots)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        half = _half(counts, (mid - lo) * shard_slots, seed, lo, hi)
        if shard < mid:
            counts, hi = half, mid
        else:
            counts, first, lo = tuple(a - b for a, b in zip(counts, half)), first + np.array(half, np.int64), mid
    return first, np.array(counts, np.int64)


def with_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, a hash of the whole row, and size, the number of words (null text: 0)."""
    bounded_batches(docs.sparkSession)
    row = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    picked = docs.select("doc_id", "source", row.alias("row_hash"), F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*picked.schema.fields[:3], T.StructField("size", T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [b.n_words for _, _, b in blocks(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64))], names=["doc_id", "source", "row_hash", "size"])

    return picked.mapInArrow(released(scan), schema)


class Mix:
    """A planned mix. layout: a row for each document with its source's number, size and target, and its place in the source in words."""

    def __init__(self, docs: DataFrame, weights: Sequence[float] = WEIGHTS, ceiling: int = CEILING, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED):
        self.block_words, self.shard_slots, self.seed, self.spark = block_words, shard_slots, seed, docs.sparkSession
        sized = written(with_sizes(docs))
        by_source = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).orderBy(F.col("source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
        if len(by_source) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        self.sizes = [r["n"] for r in by_source]
        self.targets = targets(self.sizes, weights, ceiling)
        self.n_blocks = np.array([-(-n // block_words) for n in self.sizes], np.int64)
        exact = [t / s * b if s else 0 for t, s, b in zip(self.targets, self.sizes, self.n_blocks)]
        self.slots = np.array([min(round(x), ceiling * int(b)) for x, b in zip(exact, self.n_blocks)], np.int64)
        numbered = self.spark.createDataFrame([(k, r["source"], r["n"], t, r["rows"]) for k, (r, t) in enumerate(zip(by_source, self.targets))], "source_no int, named string, source_size long, target double, rows long")
        by_rows = numbered.withColumnsRenamed({"named": "source", "rows": "__n"})
        placed = looked_up(sized, by_rows, ["source"], F.xxhash64("doc_id", "row_hash"))
        chunks = max(1, -(-sum(r["rows"] for r in by_source) // CHUNK_ROWS))
        placed = placed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(chunks)).cast("int"))
        sums = placed.groupBy("source_no", "chunk").agg(F.sum("size").alias("n"))
        # Running sums over a source's chunks, in two steps: within groups of chunks and over the groups.
        sums = sums.withColumn("group", F.expr(f"chunk div {GROUP_CHUNKS}"))
        inside = F.sum("n").over(Window.partitionBy("source_no", "group").orderBy("chunk")) - F.col("n")
        groups = sums.groupBy("source_no", "group").agg(F.sum("n").alias("g"))
        groups = groups.select("source_no", "group", (F.sum("g").over(Window.partitionBy("source_no").orderBy("group")) - F.col("g")).alias("base"))
        before = sums.withColumn("inside", inside).join(groups, ["source_no", "group"]).select("source_no", "chunk", (F.col("base") + F.col("inside")).alias("before"))
        within = Window.partitionBy("source_no", "chunk").orderBy("doc_id", "row_hash")
        run = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        self.layout = written(placed.withColumn("run", run).join(before, ["source_no", "chunk"]).withColumn("offset", F.col("before") + F.col("run")).drop("chunk", "run", "before"))

    def slot_rows(self) -> DataFrame:
        """shard, slot, source_no, pass, block: what every slot of the mix takes."""
        totals, n_blocks, size, seed = self.slots, self.n_blocks, self.shard_slots, self.seed

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    first, counts = shard_counts(shard, totals, size, seed)
                    source = np.repeat(np.arange(len(counts)), counts)
                    j = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
                    turn, at = np.divmod(j, np.maximum(1, n_blocks[source]))
                    block = np.empty(len(j), np.int64)
                    for k in np.flatnonzero(counts):
                        mine = np.flatnonzero(source == k)
                        for p in np.unique(turn[mine]):
                            those = mine[turn[mine] == p]
                            block[those] = permuted(at[those], int(n_blocks[k]), int(k) * 64 + int(p) + seed * 1_000_003)
                    slot = permuted(np.arange(len(j)), len(j), shard + 31 * seed) + shard * size if len(j) else j
                    columns = [pa.array(np.full(len(j), shard, np.int64)), pa.array(slot), pa.array(source.astype(np.int32)), pa.array(turn.astype(np.int32)), pa.array(block)]
                    yield pa.RecordBatch.from_arrays(columns, names=["shard", "slot", "source_no", "pass", "block"])

        n = -(-int(totals.sum()) // size)
        return self.spark.range(0, n, 1, max(1, min(n, 10_000))).mapInArrow(released(draw), "shard long, slot long, source_no int, pass int, block long")

    def pieces(self) -> DataFrame:
        """shard, slot, source_no, pass, block, and of each document in the block: offset, doc_id, row_hash, first_word and n_words."""
        b = F.lit(self.block_words).cast("long")
        end = F.col("offset") + F.col("size")
        spread = self.layout.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"offset div {self.block_words}"), F.expr(f"(offset + size - 1) div {self.block_words}"))))
        start = F.greatest(F.col("offset"), F.col("block") * b)
        parts = spread.select("source_no", "block", "offset", "doc_id", "row_hash", (start - F.col("offset")).alias("first_word"), (F.least(end, (F.col("block") + 1) * b) - start).alias("n_words"))
        # The planner takes the slots for as few rows as there are shards and would broadcast them.
        return self.slot_rows().hint("merge").join(parts, ["source_no", "block"])

    def taken(self) -> DataFrame:
        """doc_id, row_hash, size, source_size, target and taken, the words that the mix takes of the document, repeats counted."""
        sums = self.pieces().groupBy("source_no", "offset").agg(F.sum("n_words").alias("taken"))
        mine = [self.layout["source_no"] == sums["source_no"], self.layout["offset"] == sums["offset"], self.layout["size"] > 0]
        return self.layout.join(sums, mine, "left").select("doc_id", "row_hash", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def plan_mix(docs: DataFrame, **options) -> Mix:
    """The mix of docs (doc_id, text, source; other columns only tell repeated rows apart).

    A null text has no words; a null source is the last of the sources. Repeated rows are documents of
    their own. A source or table without words takes nothing. Reruns over the same rows agree, in
    whatever order or files they come.
    """
    return Mix(docs, **options)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents with docs' columns: of each pass a document's taken blocks, neighbouring ones in one row.

    A row's text reaches from its first taken word to its last, as it stands in the document; a document
    taken whole keeps its text as it is. n_chars, where there is such a column, is counted anew.
    """
    bounded_batches(docs.sparkSession)
    planned = Mix(docs, **options)
    runs = planned.pieces().groupBy("source_no", "offset").agg(F.sort_array(F.collect_list(F.struct("pass", "first_word", "n_words"))).alias("runs"))  # a document's own blocks
    same = Window.partitionBy("doc_id", "row_hash")
    layout = planned.layout.where("size > 0").withColumn("copy", F.row_number().over(same.orderBy("offset", "source_no")))
    slim = layout.join(runs, ["source_no", "offset"]).select(F.col("doc_id").alias("__d"), F.col("row_hash").alias("__h"), F.col("copy").alias("__c"), F.col("runs").alias("__runs"))
    names = docs.columns
    inner = docs.toDF(*(f"c{k}" for k in range(len(names))))
    at = {n: f"c{k}" for k, n in enumerate(names)}
    keyed = inner.withColumn("__h", F.xxhash64(*inner.columns))
    keyed = keyed.withColumn("__c", F.row_number().over(Window.partitionBy(at["doc_id"], "__h").orderBy("__h"))).withColumn("__d", F.col(at["doc_id"]))
    met = keyed.join(slim, keyed["__d"].eqNullSafe(slim["__d"]) & (keyed["__h"] == slim["__h"]) & (keyed["__c"] == slim["__c"])).select(*inner.columns, "__runs")
    schema = T.StructType([inner.schema[c] for c in inner.columns])
    text_at = names.index("text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at)
            rows, out = [], []
            for a, _, block in blocks(texts):
                for k in range(block.n):
                    first = block.word_at[k]
                    n = int(block.word_at[k + 1] - first)
                    spans: list[list[int]] = []
                    for r in batch.column(len(names))[a + k].as_py():
                        if spans and spans[-1][0] == r["pass"] and spans[-1][2] == r["first_word"]:
                            spans[-1][2] += r["n_words"]
                        else:
                            spans.append([r["pass"], r["first_word"], r["first_word"] + r["n_words"]])
                    for _, x, y in spans:
                        rows.append(a + k)
                        if x == 0 and y == n:
                            lo, hi = block.offsets[k], block.offsets[k + 1]
                        else:
                            lo, hi = block.starts[first + x], block.ends[first + y - 1]
                        out.append(block.data[lo:hi].tobytes().decode())
            columns = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[: len(names)]]
            columns[text_at] = pa.array(out, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pc.utf8_length(columns[text_at]).cast(columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return met.mapInArrow(released(write), schema).toDF(*names)
