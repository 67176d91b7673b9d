"""SimHash fingerprints and near-duplicate groups by a Gray-order hierarchical index.

Fingerprints that differ in at most r of 64 bits agree in at least b - r of b blocks of bits. Each
choice of b - r blocks is an upper node pattern: a mask, and the bits under it that all fingerprints of
the node share. An upper node of more than `most` fingerprints is split into nodes of the same kind
over the bits that its mask leaves, level by level; in the end too few bits are left for a node to be
larger. So every pair within r bits meets in some node, and no task holds more than a bounded group.

Within a node the fingerprints are sorted by Gray rank, where neighbours in the order differ in few
bits, and runs of them form a binary tree of masked patterns (the bits that a run shares). Two runs are
compared from the top down by the bits in which their patterns differ under both masks; as soon as
these exceed r the whole pair of groups is pruned. Exact copies share one fingerprint and were merged
before, and a node passes on links as a spanning forest, not as pairs.

Texts whose shingle sets have a Jaccard similarity of 4/5 differ in about 15 % of their fingerprints'
bits, too many for nodes that hold every pair. similar_groups() therefore takes fingerprints of 256 bits
and draws the masks of the upper nodes, so many that such a pair meets with a stated probability, and
verifies the pairs on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import ceil, comb, log
from random import Random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keyfold.llm.graph import components
from keyfold.llm.runtime import apart, bounded_batches, broadcast_if_small, cut_small, looked_up, numbered, released, whole_groups, written
from keyfold.llm.textblocks import TextBlock, blocks, mix

SEED = 42
#: Fingerprints of an upper node beyond which it is split.
MOST = 512
#: Radius -> blocks of the upper nodes.
BLOCKS = {0: 1, 1: 3, 2: 4, 3: 6, 4: 7}
#: Bits in which texts of similarity 4/5 differ on average, of 256, and the most in which a pair is verified: 2.8 standard deviations more.
MEAN, WIDE = 39, 55
#: Probability with which a pair that differs in MEAN bits meets in some node.
MEETS = 0.98
#: Fingerprints that a node of drawn masks has on average if no texts are alike; beyond GROUP it is dealt to several tasks.
SPREAD, GROUP = 512, 4_096
_SEEDS = tuple(np.uint64(x) for x in (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Of each byte its bits, as the bytes of a number.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_hashes(text: bytes, shingle: int = 3) -> np.ndarray:
    """XXH64 of each run of `shingle` words. A-Z count as a-z; fewer words than a shingle: the whole sequence; no word: none."""
    words = text.lower().split()  # bytes: A-Z and 0x20, 0x09-0x0D only
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    parts = [np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], np.uint64) for at in range(0, len(starts), 1 << 16)]
    return np.concatenate(parts)


def fingerprint_of(hashes: np.ndarray) -> int:
    """64 bits: each set if over half of the hashes have it; no hash: 0."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """fingerprint_of() the shingles of a text."""
    return fingerprint_of(shingle_hashes(text, shingle))


def with_fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 3) -> DataFrame:
    """The columns `keep` as k0, k1, ..., and `fp`, the fingerprint of each text as a signed long; a null text has no word."""
    bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(f"k{k}", docs.schema[c].dataType) for k, c in enumerate(keep)] + [T.StructField("fp", T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(batch.num_columns - 1).cast(pa.binary()), b"")
            found = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=schema.names)

    return numbered(docs, [*keep, text]).mapInArrow(released(scan), schema)


def gray_rank(code: Column) -> Column:
    """Position of a 64-bit word in Gray order, less 2^63 so that signed order is right."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(free: list[int], radius: int, parted: int | None = None) -> list[tuple[int, list[int]]]:
    """(mask, bits left) of the nodes that between them hold every pair within the radius over the free bits, parted in so many blocks (default: BLOCKS)."""
    n = min(BLOCKS[radius] if parted is None else parted, len(free))
    if n <= radius:
        return [(0, free)]
    parts = [[int(x) for x in p] for p in np.array_split(np.array(free), n)]
    out = []
    for chosen in combinations(range(n), n - radius):
        mask = sum(1 << b for k in chosen for b in parts[k])
        out.append((mask, [b for k in range(n) if k not in chosen for b in parts[k]]))
    return out


def _forest(codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a spanning forest over the codes, in Gray order, of the links within the radius."""
    n = len(codes)
    limit = np.uint64(radius)
    size = 1 << max(0, n - 1).bit_length()
    padded = np.concatenate([codes, np.repeat(codes[-1:], size - n)])
    # level k: runs of 2^k codes; diff: bits in which a run's codes are not all alike
    diffs, firsts = [np.zeros(size, np.uint64)], [padded]
    while len(firsts[-1]) > 1:
        d, f = diffs[-1], firsts[-1]
        diffs.append(d[::2] | d[1::2] | (f[::2] ^ f[1::2]))
        firsts.append(f[::2])
    left, right = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(len(firsts) - 2, -1, -1):
        same = left == right
        x, y = left * 2, right * 2
        left = np.concatenate([x, x, x + 1, (x + 1)[~same]])
        right = np.concatenate([y, y + 1, y + 1, y[~same]])
        f, d = firsts[level], diffs[level]
        near = np.bitwise_count((f[left] ^ f[right]) & ~d[left] & ~d[right]) <= limit
        inside = (left << level) < n
        inside &= (right << level) < n
        left, right = left[near & inside], right[near & inside]
    keep = left != right
    left, right = left[keep], right[keep]
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, right, label[left])
        np.minimum.at(label, left, label[right])
        label = label[label]
        if (label == before).all():
            break
    at = np.flatnonzero(label != np.arange(n))
    return codes[at], codes[label[at]]


def _linked(nodes: DataFrame, radius: int) -> DataFrame:
    """a, b: links found in nodes (node, pattern, fp), each small enough for one task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, fp), starts, ends in whole_groups((b.select([0, 1, 2]) for b in batches), 2):
            codes = fp.view(np.uint64)
            sizes = ends - starts
            two = starts[sizes == 2]
            near = two[np.bitwise_count(codes[two] ^ codes[two + 1]) <= radius]
            a, b = [codes[near]], [codes[near + 1]]
            for s, e in zip(starts[sizes > 2], ends[sizes > 2]):
                x, y = _forest(codes[s:e], radius)
                a.append(x)
                b.append(y)
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = nodes.repartition(n, "node", "pattern").sortWithinPartitions("node", "pattern", gray_rank(F.col("fp")))
    return ordered.mapInArrow(released(scan), "a long, b long").distinct()


def links(fps: DataFrame, radius: int = 2, most: int = MOST) -> DataFrame:
    """a, b: links between distinct fingerprints `fp` that connect all that a chain of pairs within the radius connects."""
    if radius not in BLOCKS:
        raise ValueError(f"radius must be one of {sorted(BLOCKS)}")
    spark = fps.sparkSession
    level = [(k, mask, free) for k, (mask, free) in enumerate(_masks(list(range(64)), radius))]
    node = lambda k, mask: F.struct(F.lit(k).alias("node"), F.lit(_signed(mask)).cast("long").alias("mask"))
    exploded = fps.select("fp", F.explode(F.array(*(node(k, mask) for k, mask, _ in level))).alias("x"))
    nodes = exploded.select(F.col("x.node").alias("node"), F.col("fp").bitwiseAND(F.col("x.mask")).alias("pattern"), "fp")
    out = None
    while True:
        large = cut_small(nodes.groupBy("node", "pattern").count().where(F.col("count") > most).select("node", "pattern"))
        last = not large.limit(1).count()
        small = nodes if last else nodes.join(large, ["node", "pattern"], "left_anti")
        found = _linked(small, radius)
        out = found if out is None else out.unionByName(found)
        if last:
            return out
        deeper, masks = [], []
        for k, mask, free in level:
            for j, (more, rest) in enumerate(_masks(free, radius)):
                child = k * 64 + j
                deeper.append((child, mask | more, rest))
                masks.append((k, child, _signed(mask | more)))
        if all(len(free) <= radius for _, _, free in level):  # at most 2^radius fingerprints
            return out.unionByName(_linked(nodes.join(large, ["node", "pattern"], "left_semi"), radius))
        level = deeper
        split = F.broadcast(spark.createDataFrame(masks, "node int, child int, mask long"))  # the masks of one level
        nodes = nodes.join(large, ["node", "pattern"], "left_semi").join(split, "node").select(F.col("child").alias("node"), F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), "fp")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, id_column: str = "doc_id", text: str = "text", keep: list[str] | None = None, most: int = MOST) -> DataFrame:
    """`keep` (default: the id) of each row, fp, and component_id: the smallest id among the rows whose fingerprints a chain of links reaches.

    Rows of one fingerprint are linked; texts that are null, empty or without a word have fingerprint 0
    and are linked with each other. Very long texts count whole. Null ids count only where a component has
    no other. Repeated rows each get their row. No rows: no rows. Other columns are not read unless named
    in `keep`; one that has the name of a result gets underscores behind it.
    """
    keep = keep or [id_column]
    names = [f"k{k}" for k in range(len(keep))]
    prints = written(with_fingerprints(docs, [*keep, id_column], text, shingle))
    id_ = f"k{len(keep)}"
    fps = written(prints.groupBy("fp").agg(F.min(id_).alias("least"), F.count("*").alias("__n")))
    found = written(components(links(fps.select("fp"), radius, most)))
    reached = found.join(fps, found["node"] == fps["fp"]).select("node", "root", "least")
    least = reached.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("__n"))
    of = looked_up(reached, least, ["root"], F.xxhash64("node")).select(F.col("node").alias("fp"), F.col("component_id").alias("__linked"))
    table = fps.join(of, "fp", "left").select("fp", F.coalesce("__linked", "least").alias("component_id"), "__n")
    done = looked_up(prints, table, ["fp"], F.xxhash64(*prints.columns))
    return done.select(*(F.col(n).alias(c) for n, c in zip(names, apart(("fp", "component_id"), keep))), "fp", "component_id")


def block_shingles(block: TextBlock, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the shingles of each text, A-Z as a-z, in order; where each text's begin). Fewer words than a shingle: the whole sequence; no word: none."""
    data = np.where((block.data >= 65) & (block.data <= 90), block.data + np.uint8(32), block.data).astype(np.uint8)
    words = TextBlock(data, block.offsets).word_hashes()
    n = block.n_words
    count = np.where(n == 0, 0, np.maximum(1, n - shingle + 1))
    at = np.concatenate([[0], np.cumsum(count)])
    of = np.repeat(np.arange(block.n), count)
    first = np.arange(at[-1]) - at[of] + block.word_at[of]
    last = block.word_at[of + 1]
    out = np.zeros(at[-1], np.uint64)
    for k in range(shingle):
        there = first + k < last
        out[there] += mix(words[first[there] + k] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
    return mix(out), at


def wide_fingerprints(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """256 bits of each text, as four numbers: each bit set if over half of its hashes have it; no hash: 0."""
    n = len(at) - 1
    out = np.zeros((n, 4), np.uint64)
    some = np.flatnonzero(np.diff(at))
    if not len(some):
        return out
    size = np.diff(at)[some]
    runs = -(-size // 255)  # counts of a run fit into a byte
    first = np.cumsum(runs) - runs
    starts = np.repeat(at[some], runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    for lane, seed in enumerate(_SEEDS):
        spread = _BITS[mix(hashes ^ seed).view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(spread, starts, axis=0).view(np.uint8).reshape(len(starts), 64)
        total = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
        out[some, lane] = np.packbits(2 * total > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


_FP = ["f0", "f1", "f2", "f3"]


def with_sketches(docs: DataFrame, keep: list[str], text: str, shingle: int) -> DataFrame:
    """The columns `keep` of each row, f0 to f3 (its wide fingerprint), unit (a 128-bit hash of its set of shingles) and n (their number)."""
    bounded_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(f, T.LongType()) for f in _FP] + [T.StructField("unit", T.BinaryType()), T.StructField("n", T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, units, sizes = [np.zeros((0, 4), np.uint64)], [], []
            for _, _, block in blocks(batch.column(batch.num_columns - 1)):
                hashes, at = block_shingles(block, shingle)
                fps.append(wide_fingerprints(hashes, at))
                for a, b in zip(at, at[1:]):
                    one = np.unique(hashes[a:b])
                    units.append(xxhash.xxh3_128_digest(one.tobytes()))
                    sizes.append(len(one))
            wide = np.concatenate(fps).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(wide[:, k].copy()) for k in range(4)), pa.array(units, pa.binary()), pa.array(sizes, pa.int64())], names=schema.names)

    return numbered(docs, [*keep, text]).mapInArrow(released(scan), schema)


def drawn_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of the upper nodes for n fingerprints of 256 bits: of so many bits that unlike texts fill a node with about SPREAD, and so many masks that texts which differ in MEAN bits meet with probability MEETS."""
    bits = max(6, (n // SPREAD).bit_length())
    together = comb(256 - MEAN, bits) / comb(256, bits)
    draw = Random(bits)
    picked = [draw.sample(range(256), bits) for _ in range(ceil(log(1 - MEETS) / log(1 - together)))]
    return [tuple(sum(1 << (b & 63) for b in p if b >> 6 == w) for w in range(4)) for p in picked]


def _nodes(units: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """node, pattern and the columns of units (unit, n, f0 to f3, root): a row for each mask; the pattern is a 64-bit hash of the bits under it."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("node"), F.xxhash64(*(F.col(f).bitwiseAND(F.lit(_signed(m))) for f, m in zip(_FP, mask) if m)).alias("pattern")) for k, mask in enumerate(masks))))
    return units.select(rows.alias("x"), *units.columns).select("x.*", *units.columns)


def _dealt(nodes: DataFrame, pairs: bool) -> DataFrame:
    """nodes with part and side. A node of more than GROUP rows is dealt to salts, each a part of its own, and with `pairs` every two salts make one more; one whose units all have one root has nothing left to find and goes. Side 0 meets all of its part, 1 and 2 each other."""
    one = F.lit(0).cast("long").alias("part"), F.lit(0).alias("side")
    size = nodes.groupBy("node", "pattern").agg(F.count("*").alias("c"), F.min("root").alias("a"), F.max("root").alias("b")).where(F.col("c") > GROUP)
    large = cut_small(size.select("node", "pattern", F.when(F.col("a") == F.col("b"), 0).otherwise(F.ceil(F.col("c") / GROUP)).cast("int").alias("salts")))
    if not large.limit(1).count():
        return nodes.select(*nodes.columns, *one)
    met = nodes.join(broadcast_if_small(large), ["node", "pattern"], "left").where("salts is null or salts > 0").withColumn("salts", F.coalesce("salts", F.lit(1)))
    met = met.withColumn("mine", F.pmod(F.xxhash64("unit", F.lit(3)), F.col("salts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)) if pairs else F.col("mine"))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    part = F.least("mine", "other").cast("long") * (1 << 31) + F.greatest("mine", "other")
    return met.withColumns({"part": part, "side": side}).drop("salts", "mine", "other")


def _met(nodes: DataFrame, take: int | None) -> DataFrame:
    """x, y, more: units of different roots that are near each other and of fitting size. nodes: node, pattern, part, side, and unit, n, f0 to f3 and root.

    take None: each part's first unit and all others that are near it. Else at most `take` for each
    unit and part, and `more` is true where a unit had more.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, side, unit, n, *fp, root), starts, ends in whole_groups(batches, 3):
            fp = np.stack([f.view(np.uint64) for f in fp], axis=1)
            for s, e in zip(starts, ends):
                if e - s < 2:
                    continue
                which = root[s:e]
                if (which == which[0]).all():
                    continue
                x, y = [], []
                given = np.zeros(e - s, np.int64)
                rows = 1 if take is None else e - s - 1
                step = max(1, (1 << 18) // (e - s))
                for a in range(0, rows, step):
                    b = min(rows, a + step)
                    i, j = np.arange(a, b)[:, None], np.arange(a + 1, e - s)[None, :]
                    differ = sum(np.bitwise_count(fp[s + a : s + b, w][:, None] ^ fp[s + a + 1 : e, w][None, :]).astype(np.int16) for w in range(4))
                    small, large = np.minimum(n[s + a : s + b][:, None], n[s + a + 1 : e][None, :]), np.maximum(n[s + a : s + b][:, None], n[s + a + 1 : e][None, :])
                    ok = (differ <= WIDE) & (5 * small >= 4 * large) & (j > i) & (which[a:b][:, None] != which[a + 1 :][None, :])
                    if side[s:e].any():
                        ok &= (side[s + a : s + b][:, None] == 0) | (side[s + a : s + b][:, None] != side[s + a + 1 : e][None, :])
                    p, q = np.nonzero(ok)
                    p, q = p + a, q + a + 1
                    if take is not None:
                        order = np.arange(len(p)) - np.searchsorted(p, p)  # p ascends
                        room = order < take
                        given += np.bincount(p[~room], minlength=e - s)
                        p, q = p[room], q[room]
                    x.append(p)
                    y.append(q)
                over = np.flatnonzero(given)
                p, q = np.concatenate([*x, over]), np.concatenate([*y, over])
                if len(p):
                    flag = np.zeros(len(p), bool)
                    flag[len(p) - len(over) :] = True
                    yield pa.RecordBatch.from_arrays([pa.array(unit[s:e][p], pa.binary()), pa.array(unit[s:e][q], pa.binary()), pa.array(flag)], names=["x", "y", "more"])

    k = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = nodes.select("node", "pattern", "part", "side", "unit", "n", *_FP, F.xxhash64("root").alias("root"))
    return columns.repartition(k, "node", "pattern", "part").sortWithinPartitions("node", "pattern", "part", "unit").mapInArrow(released(scan), "x binary, y binary, more boolean")


def _sets(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """unit and shingles (8 bytes each, distinct) of docs (unit, text), one row a unit."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for _, _, block in blocks(batch.column(1)):
                hashes, at = block_shingles(block, shingle)
                raw += [np.unique(hashes[a:b]).tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["unit", "shingles"])

    return docs.select("unit", text).mapInArrow(released(scan), "unit binary, shingles binary").dropDuplicates(["unit"])


def _similar(pairs: DataFrame) -> DataFrame:
    """a, b: the pairs (x, y, p, q: shingles of either) whose Jaccard similarity is 4/5 or more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for p, q in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_py(), np.uint64) for v in (p, q))
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(5 * both >= 4 * (len(p) + len(q) - both))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return pairs.select("x", "y", "p", "q").mapInArrow(released(scan), "a binary, b binary")


def _confirmed(pairs: DataFrame, prints: DataFrame, docs: DataFrame, keep: list[str], text: str, shingle: int) -> DataFrame:
    """a, b: the pairs (x, y) of units that are similar. A hot unit's rows are spread."""
    counts = pairs.select(F.explode(F.array("x", "y")).alias("unit")).groupBy("unit").agg(F.count("*").alias("__n"))
    one = written(prints.join(counts, "unit").groupBy("unit").agg(F.min(F.struct(*keep)).alias("k"), F.max("__n").alias("__n")).select("unit", "__n", *(F.col("k")[c].alias(c) for c in keep)))
    same = [docs[c].eqNullSafe(one[c]) for c in keep]
    sets = written(_sets(docs.join(broadcast_if_small(one.drop("__n")), reduce(Column.__and__, same)).select("unit", text), text, shingle).join(one.select("unit", "__n"), "unit"))
    met = looked_up(pairs, sets.select(F.col("unit").alias("x"), F.col("shingles").alias("p"), "__n"), ["x"], F.xxhash64("y"))
    met = looked_up(met, sets.select(F.col("unit").alias("y"), F.col("shingles").alias("q"), "__n"), ["y"], F.xxhash64("x"))
    return _similar(met)


def similar_groups(docs: DataFrame, shingle: int, text: str, keep: list[str], take: int = 16) -> DataFrame:
    """`keep` of each row and group: the same for rows that a chain of similar pairs connects.

    Similar: of equal shingle sets (by 128-bit hashes), or of Jaccard similarity 4/5 or more, which is
    counted on the whole sets of 64-bit shingle hashes. Pairs are looked for among those that meet in a
    node and differ in WIDE of 256 bits or fewer. First each node's units meet its first one only, which
    ties a cluster of copies together without its pairs; then units of different groups meet, at most
    `take` for each unit and node, more in further rounds, until no unit has more.
    docs: `keep`, which tells texts apart, and text.
    """
    prints = written(with_sketches(docs, keep, text, shingle))
    units = written(prints.select("unit", "n", *_FP).dropDuplicates(["unit"]))
    masks = drawn_masks(units.count())
    roots = tried = edges = None
    step: int | None = None
    while True:
        rooted = units.withColumn("root", F.col("unit")) if roots is None else looked_up(units, roots.withColumnRenamed("node", "unit").withColumn("__n", F.lit(1)), ["unit"], F.xxhash64("n")).withColumn("root", F.coalesce("root", "unit"))
        nodes = _nodes(rooted, masks)
        found = written(_met(_dealt(nodes, step is not None), step))
        pairs = found.where("not more").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["x", "y"], "left_anti")
        pairs = written(pairs)
        new = _confirmed(pairs, prints, docs, keep, text, shingle)
        edges = written(new if edges is None else edges.unionByName(new))
        tried = pairs if tried is None else written(tried.unionByName(pairs))
        roots = written(components(edges))
        if step is not None and not found.where("more").limit(1).count():
            break
        step = take if step is None else step * 16
    table = looked_up(units.select("unit"), roots.withColumnRenamed("node", "unit").withColumn("__n", F.lit(1)), ["unit"], F.xxhash64("unit"))
    table = table.join(prints.groupBy("unit").agg(F.count("*").alias("__n")), "unit").select("unit", F.coalesce("root", "unit").alias("group"), "__n")
    return looked_up(prints, table, ["unit"], F.xxhash64(*keep)).select(*keep, "group")


def _first_of_each(docs: DataFrame, text: str, grouped: Callable[[DataFrame, str, str, list[str]], tuple[DataFrame, list[Column]]]) -> DataFrame:
    """One row of each group, with docs' own columns: that of the smallest (doc_id, row hash), null ids last; of equal rows one."""
    names = docs.columns
    inner = docs.toDF(*(f"c{k}" for k in range(len(names))))
    id_column, text_column = f"c{names.index('doc_id')}", f"c{names.index(text)}"
    keyed = inner.withColumns({"__row": F.xxhash64(*inner.columns), "__text": F.xxhash64(F.col(text_column), F.lit(1))})
    groups, group = grouped(keyed, id_column, text_column, [id_column, "__row", "__text"])
    best = F.min(F.struct(F.col(id_column).isNull().alias("n"), F.col(id_column).alias("d"), F.col("__row").alias("r"), F.col("__text").alias("t")))
    keep = groups.groupBy(*group).agg(best.alias("b")).select(F.col("b.r").alias("__row"), F.col("b.t").alias("__text"))
    met = keyed.join(keep, ["__row", "__text"])
    one = F.row_number().over(Window.partitionBy("__row", "__text").orderBy(id_column))
    return met.withColumn("__n", one).where("__n = 1").select(*inner.columns).toDF(*names)


def drop_near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 5, text: str = "text", most: int = MOST) -> DataFrame:
    """_first_of_each() group of near_duplicates()."""
    # A group is known by its smallest id, but rows without ids may make groups of their own: the fingerprint tells these apart.
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp"))]
    return _first_of_each(docs, text, lambda keyed, id_column, text_column, keep: (near_duplicates(keyed, radius, shingle, id_column, text_column, keep, most), group))


def drop_similar(docs: DataFrame, shingle: int = 5, text: str = "text") -> DataFrame:
    """_first_of_each() group of similar_groups()."""
    return _first_of_each(docs, text, lambda keyed, id_column, text_column, keep: (similar_groups(keyed, shingle, text_column, keep), [F.col("group")]))
