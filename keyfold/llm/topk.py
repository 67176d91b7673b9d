"""Exact top-k by inner product with Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are cut into blocks of BLOCK_ROWS rows or, in large tables, more, and every block is indexed
once for each run of queries: for each dimension the rows in descending order of that component. A query reads all lists side by side (a list
from its other end where the query's component is negative), scores every row it meets for the first
time by looking up its whole vector, and stops when the sum over dimensions of component times the last
value read is below the k-th best score so far: no row not yet met can reach it. Equal bounds go on, as
such a row may win its tie. Depth doubles from round to round so that a round is a few array operations.
A query first searches one block of the longest vectors; the k-th score found there goes with it to all
others as a bound, so that a block without better rows is left early.

Queries are a stated set and meet all candidates, block by block: the rows shuffled are candidates and
queries times candidate blocks, never a pair of rows. That product is many times the size that Spark
expects of it, so these joins are merged by hint and never broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyfold.llm.runtime import bounded_batches, written

BLOCK_ROWS = 2_048
QUERY_ROWS = 512
#: Blocks grow, up to so many times these rows, where a table has more than MANY of them; then fewer copies of each query are shuffled.
GROWTH = 8
MANY = 64
#: Components of one grown block.
BLOCK_COMPONENTS = 1 << 20
FIRST_DEPTH = 32
_LONG = (-(1 << 63), (1 << 63) - 1)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as doubles; null if the vector is null or holds a null, NaN or infinite component."""
    ok = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(ok, F.transform(vector, lambda x: _floor(x.cast("double") * scale)))


def _floor(x: Column) -> Column:
    """floor() as a double: Spark's is a long, which ends at 2^63, above which every double is whole."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


class BlockIndex:
    """Sorted lists of one block of candidates."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.order = np.argsort(-matrix, axis=0, kind="stable")  # [depth, dimension]
        self.lists = np.take_along_axis(matrix, self.order, axis=0)
        self.exact = float(np.abs(matrix).max(initial=0))

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) of this block, best first: larger score, then smaller id. Rows of the id `own` take no part, and rows that score below `floor` need not be found."""
        best: list[tuple[int, int]] = []
        n, dims = self.matrix.shape
        met = np.zeros(n, bool)
        met[self.ids == own] = True
        used = np.flatnonzero(query)
        down = query[used] > 0
        whole = self.exact * float(np.abs(query).max(initial=0)) * max(dims, 1) < 2.0**53
        depth, done = FIRST_DEPTH, 0
        while True:
            depth = min(depth, n)
            if len(used) == 0:
                rows = np.flatnonzero(~met)  # every score is 0
            else:
                top, low = used[down], used[~down]
                seen = np.concatenate([self.order[done:depth, top].ravel(), self.order[n - depth : n - done, low].ravel()])
                flag = np.zeros(n, bool)
                flag[seen] = True
                rows = np.flatnonzero(flag & ~met)
            met[rows] = True
            if len(rows):
                if whole:
                    scores = (self.matrix[rows] @ query).astype(np.int64)
                    ids = self.ids[rows]
                    if len(rows) > k:
                        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                        near = scores >= kth
                        scores, ids = scores[near], ids[near]
                    found = [(int(s), int(i)) for s, i in zip(scores, ids)]
                else:  # Python's whole numbers, kept within a long
                    q = [int(x) for x in query]
                    found = [(min(max(sum(int(a) * b for a, b in zip(v, q)), _LONG[0]), _LONG[1]), int(i)) for v, i in zip(self.matrix[rows], self.ids[rows])]
                best = sorted([*best, *found], key=lambda x: (-x[0], x[1]))[:k]
            if depth >= n or len(used) == 0:
                return best
            bound = max([best[-1][0]] * (len(best) == k) + [floor] * (floor is not None), default=None)
            if bound is not None and whole:
                edge = np.where(down, self.lists[depth - 1, used], self.lists[n - depth, used])
                if float(edge @ query[used]) < bound:
                    return best
            done, depth = depth, depth * 2


def _rows_of_block(rows: int, least: int, dims: int) -> int:
    """Rows of one block: `least`, and more in a table of more than MANY such blocks."""
    most = min(GROWTH * least, BLOCK_COMPONENTS // max(dims, 1))
    return max(least, min(most, rows // MANY))


def _blocks(rows: DataFrame, block: Column, name: str, *more: str) -> DataFrame:
    """dims, block and the rows of each block: array<struct<id, v, more>>, in order of ids."""
    return rows.groupBy("dims", block.cast("int").alias(f"{name}_block")).agg(F.sort_array(F.collect_list(F.struct("id", "v", *more))).alias(f"{name}_rows"))


def _arrays(rows: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of one cell of a rows column."""
    return rows.field(0).to_numpy(zero_copy_only=False).astype(np.int64), rows.field(1).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dims)


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id and score: the k best of each block for each of its queries (id, v, floor). pairs: dims, index_block, index_rows, query_rows."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, block = None, None
        for batch in batches:
            for at, (d, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if of != (d, b):  # rows of one block come one after the other
                    of, block = (d, b), BlockIndex(*_arrays(batch.column(2)[at].values, d))
                asked = batch.column(3)[at].values
                found = [(int(q), i, s) for q, v, f in zip(*_arrays(asked, d), asked.field(2).to_pylist()) for s, i in block.search(v, int(q), k, f)]
                q, i, s = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

    return pairs.select("dims", "index_block", "index_rows", "query_rows").sortWithinPartitions("dims", "index_block").mapInArrow(search, "query_id long, vec_id long, score long")


def _first_k(found: DataFrame, k: int) -> DataFrame:
    """found with rank: the k best of each query; no more than k of a query leave a task."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row its k best other rows by integer inner product.

    Vectors that are null or hold null or non-finite components, and rows without id, take no part.
    Repeated ids: each row is a candidate, for queries of other ids, and the rows of one query id ask
    together. Vectors of unlike length never meet; very long ones are searched like others. Ties go to
    the smaller id; fewer than k candidates give fewer rows. Scores beyond a long are cut to its ends. No
    rows: no rows. Other columns are not read, whatever their names.
    """
    bounded_batches(vectors.sparkSession)
    clean = vectors.select(F.col(id_column).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and v is not null")
    clean = written(clean.withColumns({"dims": F.size("v"), "square": F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)}))
    total, asked, dims = clean.agg(F.count("*"), F.count_if("q"), F.coalesce(F.max("dims"), F.lit(0))).first()
    n, m = max(1, -(-total // _rows_of_block(total, BLOCK_ROWS, dims))), max(1, -(-asked // _rows_of_block(asked, QUERY_ROWS, dims)))
    index = _blocks(clean, F.pmod(F.xxhash64("id", "v"), F.lit(n)), "index")
    queries = written(clean.where("q").select("dims", "id", "v", F.lit(None).cast("long").alias("floor")))
    block_of = F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(m))
    # The bound: the longest vectors of each length are one more block, searched first.
    longest = clean.withColumn("r", F.row_number().over(Window.partitionBy("dims").orderBy(F.col("square").desc(), "id"))).where(F.col("r") <= BLOCK_ROWS)
    first = _blocks(queries, block_of, "query", "floor").join(_blocks(longest, F.lit(0), "index").hint("merge"), "dims")
    floors = _first_k(_searched(first.repartition("dims", "query_block"), k), k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    bounded = queries.drop("floor").join(floors, "id", "left")
    spread = _blocks(bounded, block_of, "query", "floor").withColumn("index_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    found = _searched(spread.join(index.hint("merge"), ["dims", "index_block"]), k)  # the right side, held for each key, is one row
    return _first_k(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
