"""Connected components of an edge list by alternating large-star and small-star steps.

Each step joins every edge with the least neighbour of its end: a partial aggregation and a join in
which the rows of hubs, nodes with very many neighbours, are spread (runtime.looked_up), so a hub is
neither gathered in one row nor in one task. Edges are written to the shared checkpoint folder after
each round; the rounds go on until nothing changes, and their number grows with the logarithm of the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.runtime import cut_small, looked_up


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties the larger neighbours of each node to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("__n"))
    return looked_up(both.where("b > a"), least, ["a"], F.xxhash64("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Ties each node and its smaller neighbours to the least of these; edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("__n"))
    moved = looked_up(edges, least, ["a"], F.xxhash64("b")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of an edge (a, b) the least node of its component. Self-loops count as nodes; null ends are left out."""
    whole = edges.select("a", "b").where("a is not null and b is not null")
    pairs = cut_small(whole.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        pairs = cut_small(_small_star(_large_star(pairs)))
        # A star forest stays as it is: no node is both an end and a root, and the next round changes nothing.
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == now or pairs.select("b").distinct().join(pairs.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() == 0 and pairs.groupBy("a").count().where("count > 1").limit(1).count() == 0:
            break
        state = now
    loops = whole.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
    found = pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    return found.unionByName(loops.join(found, "node", "left_anti"))
