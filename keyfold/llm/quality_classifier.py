"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and pairs of neighbouring words are hashed into `buckets` cells. The target model is fitted on
texts of labelled good quality, at most MAX_LABELS of them, chosen by a hash of their ids; the raw model
counts every text. A text's log weight is the sum over its n-grams of log(p_target / p_raw). With a
Gumbel number added that depends on the id and seed alone, the k largest sums are a sample without
replacement in proportion to the weights. k is the labelled share of good texts, with two standard
errors to the safe side, times the number of texts. The k-th largest sum is found by counting within
ever narrower ranges, so nothing is sorted and no list of texts is gathered.

Logarithms are whole multiples of 2^-20, so sums do not depend on the order of rows or batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyfold.llm.runtime import apart, bounded_batches, cut, numbered
from keyfold.llm.textblocks import TextBlock, blocks, mix

BUCKETS = 1 << 14
#: Labelled texts that the target model is fitted on at most.
MAX_LABELS = 50_000
SEED = 11
UNIT = 1 << 20
#: Cells of one counting round in the search for the k-th largest.
CELLS = 4_096


def ngram_cells(block: TextBlock, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(cell of every word, cell of every word with its next one in the same text, else -1)."""
    words, of = block.word_hashes(), block.text_of_words()
    pairs = np.full(len(words), -1, np.int64)
    if len(words) > 1:
        both = (mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) % np.uint64(buckets)).astype(np.int64)
        pairs[:-1] = np.where(of[1:] == of[:-1], both, -1)
    return (words % np.uint64(buckets)).astype(np.int64), pairs


def fit(docs: DataFrame, good: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """For each cell the log ratio of the two models in UNITs. good: the doc_ids of target texts, at most MAX_LABELS rows."""
    bounded_batches(docs.sparkSession)
    chosen = F.broadcast(good.select(F.col("doc_id").alias("__good")).distinct())  # at most MAX_LABELS rows
    marked = docs.select("doc_id", F.col(text).alias("t")).join(chosen, F.col("doc_id") == F.col("__good"), "left").select(F.col("__good").isNotNull().alias("g"), "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, block in blocks(batch.column(1)):
                mine = np.repeat(good[a:b], block.n_words)
                for cells in ngram_cells(block, buckets):
                    some = cells >= 0
                    raw += np.bincount(cells[some], minlength=buckets)
                    target += np.bincount(cells[some & mine], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["cell", "raw", "target"])

    rows = marked.mapInArrow(count, "cell int, raw long, target long").groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # one row a cell
    raw, target = np.ones(buckets), np.ones(buckets)
    for r in rows:
        raw[r["cell"]] += r["raw"]
        target[r["cell"]] += r["target"]
    if target.sum() == buckets:  # no target text: no preference
        return np.zeros(buckets, np.int64)
    return np.rint((np.log(target / target.sum()) - np.log(raw / raw.sum())) * UNIT).astype(np.int64)


def gumbel(ids: np.ndarray, seed: int = SEED) -> np.ndarray:
    """A Gumbel number for each id, in UNITs."""
    u = ((mix(ids.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return np.rint(-np.log(-np.log(u)) * UNIT).astype(np.int64)


def scored(docs: DataFrame, ratios: np.ndarray, keep: list[str], text: str = "text", seed: int = SEED) -> DataFrame:
    """`keep`, which begins with doc_id, as k0, k1, ..., and n_words, log_weight and sample_key of every row; a null text has no n-grams and weight 0."""
    buckets = len(ratios)
    schema = T.StructType([T.StructField(f"k{k}", docs.schema[c].dataType) for k, c in enumerate(keep)] + [T.StructField(n, T.LongType()) for n in ("n_words", "log_weight", "sample_key")])
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # one number a cell

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.append(shared.value, 0)  # the last for no n-gram
        for batch in batches:
            words, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, block in blocks(batch.column(batch.num_columns - 1)):
                one, two = ngram_cells(block, buckets)
                words.append(block.n_words.astype(np.int64))
                weights.append(block.per_text_words(table[one] + table[two]))
            weight = np.concatenate(weights)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(words)), pa.array(weight), pa.array(weight + gumbel(ids, seed))], names=schema.names)

    return numbered(docs, [*keep, text]).mapInArrow(score, schema)


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest long of a column, or None if there are fewer; each round gathers at most CELLS counts."""
    ends = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1 or ends[2] < k:
        return None
    lo, hi = ends[0], ends[1]
    while hi > lo:
        width = -(-(hi - lo + 1) // CELLS)
        inside = df.where(F.col(column).between(lo, hi)).groupBy(F.expr(f"({column} - {lo}L) div {width}L").alias("cell")).count().collect()
        for r in sorted(inside, key=lambda r: -r["cell"]):
            if k <= r["count"]:
                lo, hi = lo + r["cell"] * width, min(hi, lo + (r["cell"] + 1) * width - 1)
                break
            k -= r["count"]
    return lo


def resample(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, share: float | None = None, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """`keep` (default doc_id) of every document, n_words, log_weight and sample_key (in nats), and kept, whether it is in the sample.

    labels: doc_id, quality (1: good). share: of the documents that are sampled; default: the labelled
    share of good ones and two standard errors. Documents whose key equals the k-th largest are all kept.
    No labels of good quality: all weights are 0 and, unless share is given, all are kept. A null text
    has weight 0; null ids share one Gumbel number; repeated rows share their fate; very long texts are
    scanned whole. No rows: no rows. A kept column that has the name of a result gets underscores behind it.
    """
    keep = keep or ["doc_id"]
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    good = cut(good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELS))
    if share is None:
        n, mean = labels.agg(F.count("quality"), F.avg((F.col("quality") == 1).cast("double"))).first()
        share = min(1.0, mean + 2 * math.sqrt(mean * (1 - mean) / n)) if n and mean else 1.0
    rows = cut(scored(docs, fit(docs, good, buckets=buckets), ["doc_id", *keep], seed=seed))
    total = rows.count()
    least = kth_largest(rows, "sample_key", min(total, math.ceil(share * total)))
    out = rows.withColumn("kept", F.lit(least is not None) & (F.col("sample_key") >= F.lit(least or 0)))
    results = ("n_words", "log_weight", "sample_key", "kept")
    return out.select(*(F.col(f"k{k}").alias(c) for k, c in enumerate(apart(results, keep), 1)), "n_words", (F.col("log_weight") / UNIT).alias("log_weight"), (F.col("sample_key") / UNIT).alias("sample_key"), "kept")
