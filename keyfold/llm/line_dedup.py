"""Line dedup by an exact set-similarity join of lines.

A line is its set of words. Lines of equal sets are merged first; a set is known by two independent
64-bit hashes of its words, 128 bits in all. The words of a set are put in one fixed order, rare ones
first; two sets of Jaccard similarity 4/5 or more then share one of their first n - ceil(4n/5) + 1 words
(prefix filter). Sets that meet at such a word pass on if their sizes allow it (length filter), if the
words before and after it can still make up the overlap (positional filter), and if their 128-bit parity
signatures differ in no more bits than the sets may differ in words. What is left is verified on the
words themselves. A line goes if an earlier line, by (doc_id, line number, and for repeated ids a hash),
has an equal set or one that is similar enough, whether that line stays or not.

Rarity comes from counts of all words in a table of cells; words that share a cell count together, which
changes the order but not the result. A word of the prefix is left out where no other set of a fitting
size has it in its prefix, which a bitmap tells; a full bitmap leaves out less and the result is the
same. The tables grow with the number of documents up to a fixed bound (see Tables).

The sets of one word are compared in groups of at most about 2 * GROUP: a word of more entries is dealt
to salts by set, and every two salts make a group of their own, so no task grows with one word. A set is
known once it has one earlier match, so a search gives at most `take` candidates for each set and group,
and only sets without a match that had more candidates are searched again, with more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keyfold.llm.runtime import apart, bounded_batches, cut, cut_small, gathered, passing, released, written
from keyfold.llm.textblocks import TextBlock, blocks, mix

#: Words from which a line is judged; shorter ones stay.
MIN_WORDS = 1
#: Entries of one word from which it is dealt to several groups.
GROUP = 1 << 13
_CHUNK = 1 << 16
#: Candidates of a set in one group in the first search; each further search gives 16 times as many.
TAKE = 16
#: Pairs of entries that are compared at once.
_PAIRS = 1 << 15
#: Pairs of a set that are verified at first.
FIRST_PAIRS = 4
#: Documents for each bucket of the index of words.
BUCKET_DOCS = 1_000
_NULL_ID = -(1 << 63)
_LINES = 1 << 18
#: What is cut off a word's 64-bit hash to make its token, which orders, counts and groups words.
_SHORT = np.uint64(24)
_TOKEN = np.uint64((1 << 40) - 1)


@dataclass(frozen=True)
class Tables:
    """Sizes of the shared tables, powers of two: cells of the word counts (a byte each where they are used, 4 while they are made), and bits of the bitmap of partners (two of them) and of the filters of sets (two)."""

    cells: int
    partner_bits: int
    filter_bits: int

    @staticmethod
    def of(n_docs: int) -> Tables:
        """16 cells, 256 and 32 bits a document; at most 64 MB for any one table, however many documents there are."""
        size = lambda n, most: min(most, max(1 << 19, 1 << (n - 1).bit_length()))
        n = max(1, n_docs)
        return Tables(size(16 * n, 1 << 24), size(256 * n, 1 << 29), size(32 * n, 1 << 29))


def _classes(counts: np.ndarray) -> np.ndarray:
    """Half-octaves of counts: 0 for 1 (or none), at most 63."""
    return np.minimum(63, np.floor(2 * np.log2(np.maximum(1, counts)))).astype(np.uint8)


def line_spans(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line: its text, its number in the text, its first word, and the word after its last."""
    starts, ends, texts = block.lines()
    number = np.arange(len(texts)) - np.searchsorted(texts, texts)
    return texts, number, np.searchsorted(block.starts, starts), np.searchsorted(block.starts, ends)


class LineSets:
    """The word sets of a block's judged lines, at most _LINES of them: words of line k are at[k]:at[k + 1], in order of (class, token, word)."""

    def __init__(self, block: TextBlock, first: np.ndarray, last: np.ndarray, classes: np.ndarray | None):
        words, others = block.word_hashes(), block.other_hashes()
        count = last - first
        line = np.repeat(np.arange(len(first), dtype=np.uint64), count)
        if (first[1:] == last[:-1]).all():  # every word of the run
            at = np.arange(first[0], last[-1])
            word = words[first[0] : last[-1]]
        else:
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
            word = words[at]
        token = word >> _SHORT
        key = line << np.uint64(46) | token
        if classes is not None:
            key |= classes[(token & np.uint64(len(classes) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(40)
        order = np.argsort(key)
        sorted_key, sorted_word = key[order], word[order]
        same = sorted_key[1:] == sorted_key[:-1]
        if (same & (sorted_word[1:] != sorted_word[:-1])).any():  # different words of one token in one line
            order = np.lexsort((word, key))
            sorted_key, sorted_word = key[order], word[order]
            same = sorted_key[1:] == sorted_key[:-1]
        new = np.concatenate([[True], ~same | (sorted_word[1:] != sorted_word[:-1])])
        key = sorted_key[new]
        #: Where in the block each word of the sets stands.
        self.place = at[order[new]]
        self.token = key & _TOKEN
        self.rarity = key >> np.uint64(40) & np.uint64(63)
        #: Whether a word is the first of its token in its line.
        self.fresh = np.concatenate([[True], key[1:] != key[:-1]])
        self.n = np.bincount((key >> np.uint64(46)).astype(np.int64), minlength=len(first))
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.spread, size = sorted_word[new], self.n.astype(np.uint64)
        self.key = mix(np.add.reduceat(self.spread, self.at[:-1]) * np.uint64(0x9E3779B97F4A7C15) + size).view(np.int64)
        self.check = mix(np.add.reduceat(others[self.place], self.at[:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + size).view(np.int64)

    def parity(self) -> list[np.ndarray]:
        """128 bits of each set: those that an odd number of its words have, as two halves."""
        bit = np.uint64(1) << (self.spread & np.uint64(63))
        half = (self.spread >> np.uint64(6) & np.uint64(1)).astype(bool)
        return [np.bitwise_xor.reduceat(np.where(half == k, bit, np.uint64(0)), self.at[:-1]) for k in (False, True)]


def _judged(block: TextBlock, min_words: int, classes: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, LineSets]]:
    """(text, line number, sets) for runs of judged lines."""
    texts, number, first, last = line_spans(block)
    lines = np.flatnonzero(last - first >= max(1, min_words))
    for a in range(0, len(lines), _LINES):
        k = lines[a : a + _LINES]
        yield texts[k], number[k], LineSets(block, first[k], last[k], classes)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("d"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))


def _sparse(held: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(chunk, places in it, counts) of an array of counts that has some."""
    for c in range(len(held) // _CHUNK):
        part = held[c * _CHUNK : (c + 1) * _CHUNK]
        at = np.flatnonzero(part)
        if len(at):
            yield c, at.astype("<u2").tobytes(), part[at].tobytes()


def _summed(parts: DataFrame, cells: int, made, kind: type) -> np.ndarray:
    """made(sums) of all counts of parts (chunk, places, counts), an array of `cells` of a small kind."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                sums.setdefault(chunk, np.zeros(_CHUNK, np.int64))[np.frombuffer(at, "<u2")] += np.frombuffer(n, np.uint32)
        for chunk, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([made(total).astype(kind).tobytes()], pa.binary())], names=["chunk", "made"])

    n = min(max(1, cells // _CHUNK), int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = np.zeros(cells, kind)
    for r in gathered(parts.repartition(n, "chunk").mapInArrow(released(add), "chunk int, made binary"), out.nbytes):  # one small number a cell
        out[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["made"], kind)
    return out


def rarity_table(docs: DataFrame, tables: Tables, text: str = "text") -> np.ndarray:
    """The class of every cell, over all words of docs; a byte a cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(tables.cells, np.uint32)
        for batch in batches:
            for _, _, block in blocks(batch.column(2)):
                np.add.at(held, ((block.word_hashes() >> _SHORT) & np.uint64(tables.cells - 1)).astype(np.int64), np.uint32(1))
        for c, at, n in _sparse(held):
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([at], pa.binary()), pa.array([n], pa.binary())], names=["chunk", "places", "counts"])

    return _summed(_keyed(docs, text).mapInArrow(released(count), "chunk int, places binary, counts binary"), tables.cells, _classes, np.uint8)


def _bands(n: np.ndarray) -> np.ndarray:
    """Bands of set sizes: sets of similarity 4/5 are in the same band or in neighbouring ones."""
    return np.floor(np.log(n) / np.log(1.25) + 1e-9).astype(np.int64)


def _prefix(s: LineSets, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in s.token, set) of the prefix tokens of the chosen sets; words of count 1 meet no other set, and sets of under 4 words only equal ones, which share a key."""
    sets = np.flatnonzero(chosen & (s.n >= 4))
    length = s.n[sets] - -(-4 * s.n[sets] // 5) + 1
    of = np.repeat(sets, length)
    use = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length) + s.at[of]
    some = (s.rarity[use] > 0) & s.fresh[use]
    return use[some], of[some]


def _cell(word: np.ndarray, band: np.ndarray, bits: int) -> np.ndarray:
    return (mix(word * np.uint64(64) + band.astype(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _set(bitmap: np.ndarray, cells: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, cells >> 3, np.uint8(1) << (cells & 7).astype(np.uint8))


def _has(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return bitmap[cells >> 3] >> (cells & 7).astype(np.uint8) & 1 == 1


def _places(bitmap: np.ndarray) -> np.ndarray:
    """The places of the set bits of a bitmap with few of them."""
    at = np.flatnonzero(bitmap)
    row, bit = np.nonzero(np.unpackbits(bitmap[at], bitorder="little").reshape(-1, 8))
    return (at[row] * 8 + bit).astype(np.uint32)


def _distinct(s: LineSets, *order: np.ndarray) -> np.ndarray:
    """The first line, by `order` (the last being the first key), of each set of a run."""
    rows = np.lexsort((*order, s.check, s.key))
    key, check = s.key[rows], s.check[rows]
    return rows[np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])]


#: A line of a set: the set, and the document and line where it stands.
_LINE_FIELDS = (("key", np.uint64), ("check", np.int64), ("d", np.int64), ("line", np.int64), ("h", np.int64))


def _earliest(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Of columns of _LINE_FIELDS the earliest line of each set, by key."""
    order = np.argsort(columns[0])
    columns = [c[order] for c in columns]
    tied = np.append(False, columns[0][1:] == columns[0][:-1])
    tied[:-1] |= tied[1:]
    many = np.flatnonzero(tied)
    if not len(many):
        return columns
    order = many[np.lexsort([c[many] for c in reversed(columns)])]
    for c in columns:
        c[many] = c[order]
    key, check = columns[:2]
    fresh = np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]))
    return [c[fresh] for c in columns]


_SETS = "kind int, chunk int, once binary, twice binary, lines binary"


def line_sets(docs: DataFrame, classes: np.ndarray, tables: Tables, buckets: int, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """Rows of three kinds. Kind 0: lines of sets, the earliest of each run at least, packed by bucket (chunk) of the set. Kind 1: chunk, once, twice, places in two bitmaps of the words and bands that one set, and that more than one, has in its prefix. Kind 2: chunk, once, twice, cells of such words and how many entries they have."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # a byte a cell
    names = [c.split()[0] for c in _SETS.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def side(kind: int, chunk: int, a: bytes, b: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((kind, chunk, a, b, None), kinds)], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = tables.partner_bits // 8
        once, twice, entries = np.zeros(size, np.uint8), np.zeros(size, np.uint8), np.zeros(tables.cells, np.uint32)
        held: list[list[np.ndarray]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            columns = _earliest([np.concatenate(c) for c in zip(*held)])
            held.clear()
            bucket = ((columns[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            for at, blobs in _by_bucket(bucket, columns):
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(at), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(blobs, pa.binary())], names=names)

        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, _, block in blocks(batch.column(2)):
                for texts, number, s in _judged(block, min_words, shared.value):
                    d, h = ids[a + texts], hashes[a + texts]
                    first = _distinct(s, h, number, d)
                    chosen = np.zeros(len(s.n), bool)
                    chosen[first] = True
                    use, of = _prefix(s, chosen)
                    cells, n = np.unique(_cell(s.token[use], _bands(s.n[of]), tables.partner_bits), return_counts=True)
                    _set(twice, cells[(n > 1) | _has(once, cells)])
                    _set(once, cells)
                    np.add.at(entries, (s.token[use] & np.uint64(tables.cells - 1)).astype(np.int64), np.uint32(1))
                    held.append([s.key[first].view(np.uint64), s.check[first], d[first], number[first].astype(np.int64), h[first]])
                    count += len(first)
                    if count >= 100_000:
                        yield from flush()
                        count = 0
        if count:
            yield from flush()
        for c in range(max(1, size // _CHUNK)):
            part = slice(c * _CHUNK, (c + 1) * _CHUNK)
            if once[part].any():
                yield side(1, c, *(_places(b[part]).tobytes() for b in (once, twice)))
        for c, at, n in _sparse(entries):
            yield side(2, c, at, n)

    return _keyed(docs, text).mapInArrow(released(scan), _SETS)


def first_lines(sets: DataFrame) -> DataFrame:
    """key, check, d, line, h: the earliest line of each set of line_sets()."""

    def first(blobs: list[bytes]) -> pa.RecordBatch:
        columns = _earliest([np.concatenate(c) for c in zip(*(_unpacked(b, _LINE_FIELDS) for b in blobs))])
        kinds = (np.int64, np.int64, np.int64, np.int32, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, kinds)], names=[name for name, _ in _LINE_FIELDS])

    packed = sets.where("kind = 0").select(F.col("chunk").alias("bucket"), F.col("lines").alias("blob"))
    return _each_bucket(packed, first, "key long, check long, d long, line int, h long")


def _partners(sets: DataFrame, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """The two bitmaps of line_sets(), over all of docs; 2 * partner_bits bits."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for chunk, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                once, twice = sums.setdefault(chunk, (np.zeros(_CHUNK, np.uint8), np.zeros(_CHUNK, np.uint8)))
                a, b = (np.frombuffer(x, np.uint32).astype(np.int64) for x in (a, b))
                _set(twice, np.concatenate([b, a[_has(once, a)]]))
                _set(once, a)
        for chunk, (once, twice) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([once.tobytes()], pa.binary()), pa.array([twice.tobytes()], pa.binary())], names=["chunk", "once", "twice"])

    size = tables.partner_bits // 8
    n = min(max(1, size // _CHUNK), int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = np.zeros((2, max(size, _CHUNK)), np.uint8)
    for r in gathered(sets.where("kind = 1").select("chunk", "once", "twice").repartition(n, "chunk").mapInArrow(released(add), "chunk int, once binary, twice binary"), out.nbytes):  # 2 * partner_bits bits in all
        out[:, r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["once"], np.uint8), np.frombuffer(r["twice"], np.uint8)
    return out[0], out[1]


def _salts(sets: DataFrame, tables: Tables) -> np.ndarray:
    """Of each cell the number of salts that its entries are dealt to: 1 up to GROUP entries."""
    parts = sets.where("kind = 2").select("chunk", "once", "twice")
    return np.maximum(1, _summed(parts, tables.cells, lambda n: np.minimum(-(-n // GROUP), (1 << 16) - 1), np.uint16))


#: An entry of the index: its group (a token, or a token and two salts), size, 4 times the place of the word and its side of the group, two halves of the parity signature, set, and its earliest line of a run.
_FIELDS = (("group", np.uint64), ("n", np.int64), ("at", np.int64), ("low", np.uint64), ("high", np.uint64), ("key", np.int64), ("check", np.int64), ("d", np.int64), ("line", np.int64))


def _squeezed(blob: bytes) -> bytes:
    """A packed group, compressed: checkpoints are not."""
    return len(blob).to_bytes(8, "little") + pa.compress(blob, codec="zstd", asbytes=True)


def _loose(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _dealt(token: np.ndarray, key: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, group, side): the groups that each entry goes to. Side 0 meets all of its group, 1 and 2 each other."""
    many = np.flatnonzero(salts > 1)
    one = np.flatnonzero(salts == 1)
    n = salts[many].astype(np.int64)
    entry = np.repeat(many, n)
    other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    mine = np.repeat((mix(key[many].view(np.uint64)) % n.astype(np.uint64)).astype(np.int64), n)
    a, b = np.minimum(mine, other).astype(np.uint64), np.maximum(mine, other).astype(np.uint64)
    group = mix(mix(token[entry] + np.uint64(1)) + (a << np.uint64(32) | b)) | np.uint64(1 << 63)  # tokens have 40 bits
    side = np.where(mine == other, 0, np.where(mine < other, 1, 2))
    return np.concatenate([one, entry]), np.concatenate([token[one], group]), np.concatenate([np.zeros(len(one), np.int64), side])


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns byte plane by byte plane, so that the many zero bytes lie together and compress."""
    return b"".join(c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)


def _unpacked(blob: bytes, fields: tuple = _FIELDS) -> list[np.ndarray]:
    planes = np.frombuffer(blob, np.uint8).reshape(len(fields), 8, -1)
    return [np.ascontiguousarray(planes[k].T).reshape(-1).view(kind) for k, (_, kind) in enumerate(fields)]


def _by_bucket(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Runs of (buckets, packed columns of each); rows come by bucket."""
    ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
    starts = np.append(0, ends[:-1])
    for k in range(0, len(starts), 1_000):
        part = slice(k, k + 1_000)
        yield bucket[starts[part]], [_packed([c[x:y] for c in columns]) for x, y in zip(starts[part], ends[part])]


def _each_bucket(packed: DataFrame, made: Callable[[list[bytes]], pa.RecordBatch], schema: str) -> DataFrame:
    """made(blobs) of each bucket of packed (bucket, blob)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []
        for batch in batches:
            for b, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket and blobs:
                    yield made(blobs)
                    blobs = []
                bucket = b
                blobs.append(blob)
        if blobs:
            yield made(blobs)

    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(released(scan), schema)


def index_entries(docs: DataFrame, classes: np.ndarray, partners: tuple[np.ndarray, np.ndarray], salts: np.ndarray, tables: Tables, buckets: int, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """bucket, entries: the index of prefix words, packed by bucket of the group. Words without a set of a fitting size to meet are left out."""
    shared = docs.sparkSession.sparkContext.broadcast((classes, *partners, salts))  # 3 bytes a cell and 2 * partner_bits bits

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, once, twice, dealt = shared.value
        held: list[list[np.ndarray]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            bucket = (mix(columns[0]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for at, blobs in _by_bucket(bucket[order], [c[order] for c in columns]):
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "entries"])

        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, _, block in blocks(batch.column(2)):
                for texts, number, s in _judged(block, min_words, rare):
                    d = ids[a + texts]
                    chosen = np.zeros(len(s.n), bool)
                    chosen[_distinct(s, hashes[a + texts], number, d)] = True
                    use, of = _prefix(s, chosen)
                    token, band = s.token[use], _bands(s.n[of])
                    there = lambda bits, b: _has(bits, _cell(token, b, tables.partner_bits))  # noqa: B023, E731
                    some = there(twice, band) | there(once, band + 1) | there(once, np.maximum(0, band - 1)) & (band > 0)
                    use, of = use[some], of[some]
                    token = s.token[use]
                    entry, group, side = _dealt(token, s.key[of], dealt[(token & np.uint64(len(dealt) - 1)).astype(np.int64)])
                    use, of = use[entry], of[entry]
                    low, high = s.parity()
                    held.append([group, s.n[of].astype(np.int64), 4 * (use - s.at[:-1][of]) + side, low[of], high[of], s.key[of], s.check[of], d[of], number[of].astype(np.int64)])
                    count += len(use)
                    if count >= 100_000:
                        yield from flush()
                        count = 0
        if count:
            yield from flush()

    return _keyed(docs, text).mapInArrow(released(scan), "bucket int, entries binary")


def _pairs(blobs: list[bytes], keys: list[int] | None, take: int) -> pa.RecordBatch:
    """Of the entries of some groups: pairs (x, x2, y, y2) of sets (key and check), y the later one, that pass the filters, at most `take` for each y and group.

    keys: the sets that search; None: all. Groups in which a set had more come once again as a row of all
    their entries and, in `more`, the keys of these sets.
    """
    columns = [np.concatenate(c) for c in zip(*map(_unpacked, blobs))]
    order = np.lexsort((columns[5], columns[1], columns[0]))
    columns = [c[order] for c in columns]
    group, n, at, low, high, key, check, d, line = columns
    fresh = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]) | (check[1:] != check[:-1]))
    if not fresh.all():  # sets of several runs: their earliest line counts
        of = np.cumsum(fresh) - 1
        many = np.flatnonzero(np.bincount(of)[of] > 1)
        many = many[np.lexsort((line[many], d[many], of[many]))]
        many = many[np.append(True, of[many][1:] != of[many][:-1])]
        first = np.flatnonzero(fresh)[of[many]]
        d[first], line[first] = d[many], line[many]
        columns = [c[fresh] for c in columns]
    group, n, at, low, high, key, check, d, line = columns
    side, at = at & 3, at >> 2
    sided = bool(side.any())
    probe = np.ones(len(key), bool) if keys is None else np.isin(key, np.array(keys, np.int64))
    given = np.zeros(len(group), np.int64)
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # Sorted by group and size: the partners of each entry are the entries behind it, up to the first that is too large.
    place = np.cumsum(np.append(0, group[1:] != group[:-1])) << 32
    length = np.searchsorted(place | n, place | 5 * n // 4, side="right") - np.arange(1, len(group) + 1)
    sums, a = np.cumsum(length), 0
    while a < len(group):
        b = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + _PAIRS, side="right")))
        i = np.repeat(np.arange(a, b), length[a:b])
        j = i + np.arange(1, len(i) + 1) - np.repeat(np.cumsum(length[a:b]) - length[a:b], length[a:b])
        a = b
        total = n[i] + n[j]
        least = -(-4 * total // 9)
        alike = np.bitwise_count(low[i] ^ low[j]).astype(np.int64) + np.bitwise_count(high[i] ^ high[j]) <= total - 2 * least
        i, j = i[alike], j[alike]
        able = np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j]) >= least[alike]
        if sided:
            able &= (side[i] == 0) | (side[i] != side[j])
        able &= (key[i] != key[j]) | (check[i] != check[j])
        p, q = i[able], j[able]
        later = (d[p] > d[q]) | (d[p] == d[q]) & ((line[p] > line[q]) | (line[p] == line[q]) & ((key[p] > key[q]) | (key[p] == key[q]) & (check[p] > check[q])))
        y, x = np.where(later, p, q), np.where(later, q, p)
        y, x = y[probe[y]], x[probe[y]]
        if len(y):
            order = np.argsort(y, kind="stable")
            y, x = y[order], x[order]
            room = given[y] + np.arange(len(y)) - np.searchsorted(y, y) < take
            np.add.at(given, y, 1)
            xs.append(x[room])
            ys.append(y[room])
    over = given > take
    x, y = np.concatenate(xs), np.concatenate(ys)
    order = np.lexsort((check[x], key[x], check[y], key[y]))
    both = [key[x[order]], check[x[order]], key[y[order]], check[y[order]]]
    if len(order):
        new = np.append(True, np.any([c[1:] != c[:-1] for c in both], axis=0))
        both = [c[new] for c in both]
    found = np.unique(group[over])
    groups = [(_squeezed(_packed([c[a:b] for c in columns])), key[a:b][over[a:b]].tolist()) for a, b in zip(np.searchsorted(group, found), np.searchsorted(group, found, side="right"))]
    blank = [None] * len(both[0])
    padded = [pa.array(np.append(c, np.zeros(len(groups), np.int64)), mask=np.arange(len(c) + len(groups)) >= len(c)) for c in both]
    return pa.RecordBatch.from_arrays([*padded, pa.array(blank + [g for g, _ in groups], pa.binary()), pa.array(blank + [k for _, k in groups], pa.list_(pa.int64()))], names=["x", "x2", "y", "y2", "entries", "more"])


_FOUND = "x long, x2 long, y long, y2 long, entries binary, more array<long>"


def _candidates(entries: DataFrame, take: int) -> DataFrame:
    """_pairs() of the whole index (bucket, entries)."""
    return _each_bucket(entries, lambda blobs: _pairs(blobs, None, take), _FOUND)


def _more_candidates(groups: DataFrame, take: int) -> DataFrame:
    """_pairs() of the entries of single groups (entries, more), searched for the sets `more`."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, keys in zip(*(c.to_pylist() for c in batch.columns)):
                yield _pairs([_loose(blob)], keys, take)

    return groups.select("entries", "more").mapInArrow(released(scan), _FOUND)


def _filter_of(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap with the places of all keys set."""
    at = F.pmod(F.xxhash64("key"), F.lit(bits))
    rows = keys.select((at + 1).alias("at")).groupBy((F.bitmap_bucket_number("at")).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(bits // 8 + (1 << 13), np.uint8)
    for r in gathered(rows, out.nbytes):  # `bits` bits in all
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _whole_sets(docs: DataFrame, keys: DataFrame, first: DataFrame, tables: Tables, min_words: int, text: str) -> DataFrame:
    """key, check, n, w0 to w3 (a parity signature of 256 bits) and words (with spaces between them) of the whole sets of keys (key, check)."""
    home = F.xxhash64("d", "h")
    homes = first.join(keys, ["key", "check"], "left_semi").select(home.alias("key"))
    shared = docs.sparkSession.sparkContext.broadcast((_filter_of(keys, tables.filter_bits), _filter_of(homes, tables.filter_bits)))  # 2 * filter_bits bits

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, home_bits = shared.value
        at = lambda x: _xxhash64_long(x) & np.int64(tables.filter_bits - 1)
        for batch in batches:
            # Only documents that hold the first line of a key need be looked at.
            for _, _, block in blocks(batch.column(1).filter(pa.array(_has(home_bits, at(batch.column(0).to_numpy()))))):
                for _, _, s in _judged(block, min_words, None):
                    first = _distinct(s)
                    hit = first[_has(bitmap, at(s.key[first]))]
                    if not len(hit):
                        continue
                    wide, raw = [], []
                    for k in hit:
                        mine = slice(s.at[k], s.at[k + 1])
                        spread = s.spread[mine] >> np.uint64(32) & np.uint64(255)
                        wide.append(np.packbits((np.bincount(spread.astype(np.int64), minlength=256) & 1).astype(np.uint8)))
                        raw.append(b" ".join([block.data[block.starts[w] : block.ends[w]].tobytes() for w in s.place[mine]]))
                    wide = np.stack(wide).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(s.key[hit]), pa.array(s.check[hit]), pa.array(s.n[hit].astype(np.int32)), *(pa.array(wide[:, k].copy()) for k in range(4)), pa.array(raw, pa.binary())], names=["key", "check", "n", "w0", "w1", "w2", "w3", "words"])

    found = _keyed(docs, text).select(home.alias("home"), "t").mapInArrow(released(scan), "key long, check long, n int, w0 long, w1 long, w2 long, w3 long, words binary")
    return found.join(keys, ["key", "check"], "left_semi").dropDuplicates(["key", "check"])


def _verified(pairs: DataFrame) -> DataFrame:
    """key, check: y and y2 of the pairs (y, y2, a, b: words of either) whose similarity is 4/5 or more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for k, (a, b) in enumerate(zip(batch.column(2), batch.column(3))):
                a, b = a.as_py().split(b" "), b.as_py().split(b" ")
                both = len(set(a).intersection(b))
                good[k] = 5 * both >= 4 * (len(a) + len(b) - both)
            good = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["key", "check"])

    return pairs.select("y", "y2", "a", "b").mapInArrow(released(scan), "key long, check long")


def _xxhash64_long(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a column of longs, made non-negative modulo any power of two by numpy's own modulo."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # the fixed primes of XXH64
    turn = lambda v, r: v << np.uint64(r) | v >> np.uint64(64 - r)
    out = np.uint64(42) + p5 + np.uint64(8) ^ turn(x.view(np.uint64) * p2, 31) * p1
    out = turn(out, 27) * p1 + p4
    out = (out ^ out >> np.uint64(33)) * p2
    out = (out ^ out >> np.uint64(29)) * p3
    return (out ^ out >> np.uint64(32)).view(np.int64)


_Y = ["y", "y2"]


def _without(pairs: DataFrame, done: DataFrame | None) -> DataFrame:
    """pairs (y, y2, ...) whose y isn't among done (key, check)."""
    return pairs if done is None else pairs.join(done.toDF(*_Y), _Y, "left_anti")


def _settled(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """key, check: the y of pairs (x, x2, y, y2) that have a similar x. Of each y FIRST_PAIRS are verified, and then all others of those that are left."""
    # Two sets differ in at least as many words as their parity signatures differ in bits.
    slim = lambda k: whole.select(F.col("key").alias(k), F.col("check").alias(f"{k}2"), F.col("n").alias(f"n{k}"), *(F.col(f"w{i}").alias(f"{k}w{i}") for i in range(4)))
    near = pairs.join(slim("x"), ["x", "x2"]).join(slim("y"), _Y)
    differ = sum((F.bit_count(F.col(f"xw{i}").bitwiseXOR(F.col(f"yw{i}"))) for i in range(4)), F.lit(0))
    total = F.col("nx") + F.col("ny")
    near = near.where(differ <= total - 2 * F.ceil(4 * total / 9)).select("x", "x2", "y", "y2")
    ranked = written(near.withColumn("rank", F.row_number().over(Window.partitionBy("y", "y2").orderBy("x", "x2"))))  # the candidates of one set, `take` a group
    done, low, high = None, 0, FIRST_PAIRS
    while True:
        these = _without(ranked.where((F.col("rank") > low) & (F.col("rank") <= high)), done)
        words = lambda k, name: whole.select(F.col("key").alias(k), F.col("check").alias(f"{k}2"), F.col("words").alias(name))
        new = _verified(these.join(words("x", "a"), ["x", "x2"]).join(words("y", "b"), _Y)).distinct()
        done = cut_small(new if done is None else done.unionByName(new))
        low, high = high, 1 << 30
        if not _without(ranked.where(F.col("rank") > low), done).limit(1).count():
            return done


def similar_later(docs: DataFrame, entries: DataFrame, first: DataFrame, tables: Tables, min_words: int = MIN_WORDS, text: str = "text", take: int = TAKE) -> DataFrame:
    """key, check: the sets that have an earlier similar set. Rows that hold the entries of whole groups are checkpointed, not written as Parquet, which is read by thousands of rows at once. entries: index_entries() of docs; first: key, check, d, h, line of the first line of each set."""
    found, done = cut(_candidates(entries, take)), None
    while True:
        pairs = written(_without(found.where("x is not null").select("x", "x2", "y", "y2").distinct(), done))
        keys = written(pairs.select(F.explode(F.array(F.struct(F.col("x").alias("key"), F.col("x2").alias("check")), F.struct(F.col("y").alias("key"), F.col("y2").alias("check")))).alias("k")).select("k.*").distinct())
        new = _settled(pairs, written(_whole_sets(docs, keys, first, tables, min_words, text)))
        done = new if done is None else cut_small(done.unionByName(new))
        groups = found.where("entries is not null").select("entries", "more", F.xxhash64("entries").alias("g"))
        left = groups.select("g", F.explode("more").alias("key")).join(done.select("key"), "key", "left_anti").groupBy("g").agg(F.collect_list("key").alias("more"))  # sets of one group
        if not left.limit(1).count():
            return done
        take *= 16
        found = cut(_more_candidates(groups.drop("more").join(left, "g"), take))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", take: int = TAKE) -> DataFrame:
    """docs with later similar lines cut out of `text`, and n_lines and n_removed.

    Lines are split at \\n. Lines of fewer than min_words words, and those without any, stay. Null texts
    stay null, with 0 lines; an empty text has 1 line. Rows of equal doc_id and text are one document: each
    keeps the same lines. Null ids come first. No rows: no rows. Very long texts are scanned whole, each in
    a block of its own. Other columns pass through; one that has the name of a result gets underscores
    behind it.
    """
    tables = Tables.of(n_docs := docs.count())
    classes = rarity_table(docs, tables, text)
    buckets = max(1, n_docs // BUCKET_DOCS)
    with passing(line_sets(docs, classes, tables, buckets, min_words, text)) as sets:
        partners, salts = _partners(sets, tables), _salts(sets, tables)
        first = written(first_lines(sets))
    gone = similar_later(docs, index_entries(docs, classes, partners, salts, tables, buckets, min_words, text), first, tables, min_words, text, take)
    stay = first.join(gone, ["key", "check"], "left_anti").groupBy(F.col("d").alias("__d"), F.col("h").alias("__h")).agg(F.collect_list("line").alias("__stay"))  # lines of one document
    names = docs.columns
    inner = docs.toDF(*(f"c{k}" for k in range(len(names))))
    text_at, id_at = names.index(text), names.index("doc_id")
    keyed = inner.withColumns({"__d": F.coalesce(F.col(f"c{id_at}").cast("long"), F.lit(_NULL_ID)), "__h": F.xxhash64(f"c{text_at}")})
    met = keyed.join(stay, ["__d", "__h"], "left").select(*inner.columns, "__stay")
    schema = T.StructType([*inner.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stays = batch.column(text_at), batch.column(len(names))
            valid = texts.is_valid().to_numpy(zero_copy_only=False)
            stay_at, stay = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(stays), 0).to_numpy())]), pc.list_flatten(stays).to_numpy()
            out, n_lines, n_removed = [pa.array([], pa.large_string())], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for a, b, block in blocks(texts):
                starts, ends, of = block.lines()
                at = np.searchsorted(of, np.arange(block.n + 1))
                keep = np.searchsorted(block.starts, ends) - np.searchsorted(block.starts, starts) < max(1, min_words)
                mine = slice(stay_at[a], stay_at[b])
                keep[stay[mine] + np.repeat(at[:-1], np.diff(stay_at[a : b + 1]))] = True
                n_lines[a:b] = np.diff(at) * valid[a:b]
                n_removed[a:b] = n_lines[a:b] - np.add.reduceat(keep, at[:-1], dtype=np.int64) * valid[a:b]
                # What is kept of the bytes: lines, each but the last of its text with its break.
                line = np.flatnonzero(keep)
                ends[line[:-1]] += of[line[1:]] == of[line[:-1]]
                edge = np.zeros(len(block.data) + 1, np.int8)
                np.add.at(edge, starts[line], np.int8(1))
                np.subtract.at(edge, ends[line], np.int8(1))
                bytes_of = np.bincount(of[line], ends[line] - starts[line], block.n).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(bytes_of)])
                data = block.data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
                out.append(pa.LargeStringArray.from_buffers(block.n, pa.py_buffer(offsets), pa.py_buffer(data), pa.py_buffer(np.packbits(valid[a:b], bitorder="little"))))
            columns = list(batch.columns[: len(names)])
            columns[text_at] = pa.concat_arrays(out).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=schema.names)

    return met.mapInArrow(released(rewrite), schema).toDF(*apart(("n_lines", "n_removed"), names), "n_lines", "n_removed")
