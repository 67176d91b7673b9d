"""Quality rules whose cutoffs adapt to each language and source.

Five ratios of every text go into mergeable quantile sketches, one for each (lang, source): a sketch
counts values in bins of fixed borders (sixteen an octave of the value in millionths, so a quantile is
known to about 5 %), and two sketches merge by adding counts. Adding is what a partial aggregation
does, so a source with a third of all rows is summed up within each task before anything is shuffled,
and the result does not depend on the order of rows. A group of fewer than `least` texts takes the
merged sketch of its language, and a language of fewer than that the merged sketch of all.

The cutoff of a ratio is the group's high quantile (9 of 10 texts) plus `reach` times its distance from
the median: what an ordinary text of the group has, and some more. No fixed cutoff takes part; a small
`guard` is added, so that a ratio which is 0 in nearly all texts of a group does not reject a text for
a single occurrence. The texts are then joined with their group's cutoffs and filtered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keyfold.llm.runtime import apart, bounded_batches, cut, cut_small, looked_up, numbered, released
from keyfold.llm.textblocks import TextBlock, blocks

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Texts of a group from which its own sketch is used.
LEAST = 100
REACH = 3
#: The quantiles of a sketch, in tenths, that make its cutoff.
MIDDLE, HIGH = 5, 9
#: Ratio in millionths -> what is added to its cutoff. In order: symbols a character; repeated words, repeated lines, words equal to the one before, and characters a word.
GUARD = {"symbol_ppm": 10_000, "repeat_ppm": 100_000, "dup_line_ppm": 20_000, "echo_ppm": 20_000, "long_word_ppm": 250_000}
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_echo_words")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def block_features(block: TextBlock) -> dict[str, np.ndarray]:
    """FEATURES of each text of a block. Lines and windows are compared by 64-bit hashes within their text."""
    salt = np.arange(block.n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = {"n_words": block.n_words.astype(np.int64), "word_chars": block.per_text(block.is_word & ((block.data & 0xC0) != 0x80)), "n_symbols": block.per_text(_SYMBOLS[block.data])}
    starts, ends, texts = block.lines()
    worded = np.searchsorted(block.starts, ends) > np.searchsorted(block.starts, starts)
    keys = block.hashes(starts[worded], ends[worded]) ^ salt[texts[worded]]
    later = np.ones(len(keys), bool)
    later[np.unique(keys, return_index=True)[1]] = False
    out["n_dup_lines"] = np.bincount(texts[worded][later], minlength=block.n).astype(np.int64)
    n, words, of = len(block.starts), block.word_hashes(), block.text_of_words()
    echo = np.zeros(n, np.int64)
    echo[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    out["n_echo_words"] = block.per_text_words(echo)
    covered = np.zeros(n, np.int64)
    if n >= WINDOW:
        window = np.zeros(n - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            window = window * np.uint64(0xD6E8FEB86659FD93) + words[k : n - WINDOW + 1 + k]
        window ^= salt[of[: n - WINDOW + 1]]
        inside = of[: n - WINDOW + 1] == of[WINDOW - 1 :]
        at = np.flatnonzero(inside)
        ordered = np.sort(window[at])
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            hit = at[np.isin(window[at], twice)]
            edges = np.zeros(n + 1, np.int64)
            np.add.at(edges, hit, 1)
            np.add.at(edges, hit + WINDOW, -1)
            covered = (np.cumsum(edges)[:n] > 0).astype(np.int64)
    out["n_repeat_words"] = block.per_text_words(covered)
    return out


def with_features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs and FEATURES of its texts; a null text has no words."""
    bounded_batches(docs.sparkSession)
    source = numbered(docs, [*keep, text])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(f, T.LongType()) for f in FEATURES])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            parts = [block_features(b) for _, _, b in blocks(texts)]
            found = [pa.array(np.concatenate([p[f] for p in parts]) if parts else np.zeros(0, np.int64)) for f in FEATURES]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=schema.names)

    return source.mapInArrow(released(scan), schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """The sketched ratios in whole millionths; null where a text has no words."""
    per = lambda a, b: F.expr(f"1000000 * {a} div nullif({b}, 0)")
    return {"symbol_ppm": per("n_symbols", "word_chars"), "repeat_ppm": per("n_repeat_words", "n_words"), "dup_line_ppm": per("n_dup_lines", "n_words"), "echo_ppm": per("n_echo_words", "n_words"), "long_word_ppm": per("word_chars", "n_words")}


def bin_of(v: Column) -> Column:
    """The sketch bin of a whole number >= 0: 16 bins an octave, borders at 16 to 31 times powers of two; whole-number arithmetic only."""
    bits = F.length(F.bin(v)) - 5
    return F.when(v < 16, v).otherwise(F.lit(16) * bits + F.call_function("shiftright", v, bits.cast("int")))


def bin_top(b: Column) -> Column:
    """The largest value of a bin."""
    # bin = 16 * bits + m with m in 16..31
    bits = F.floor(b / 16) - 1
    m = b - 16 * bits
    return F.when(b < 16, b).otherwise(F.call_function("shiftleft", m + 1, bits.cast("int")) - 1)


def cutoffs(features: DataFrame, least: int = LEAST, reach: int = REACH, guard: dict[str, int] | None = None) -> DataFrame:
    """lang, source, __n (its texts) and cut_<ratio>, the cutoff of each ratio. features: lang, source and FEATURES of all texts.

    Texts that the base rules reject are sketched too, and null is a group like any other.
    """
    guard = GUARD if guard is None else guard
    names = list(guard)
    ppm = ratios()
    # A text without words has no ratios; bin -1 counts it for __n alone.
    binned = features.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(n).alias("ratio"), F.coalesce(bin_of(ppm[n]), F.lit(-1)).cast("int").alias("bin")) for n in names))).alias("x"))
    sketch = cut_small(binned.select("lang", "source", "x.ratio", "x.bin").groupBy("lang", "source", "ratio", "bin").agg(F.count("*").alias("n")))

    def quantiles(keys: list[str]) -> DataFrame:
        """keys, ratio, all and cut."""
        merged = sketch.where("bin >= 0").groupBy(*keys, "ratio", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "ratio")
        run = merged.withColumns({"upto": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(w)})
        at = lambda q: F.min(F.when(F.col("upto") * 10 >= F.col("all") * q, F.col("bin")))
        q = run.groupBy(*keys, "ratio").agg(at(MIDDLE).alias("b5"), at(HIGH).alias("b9"), F.max("all").alias("all"))
        extra = F.create_map(*(F.lit(y) for x in guard.items() for y in x))
        middle, high = bin_top(F.col("b5")), bin_top(F.col("b9"))
        return q.select(*keys, "ratio", "all", (high + reach * (high - middle) + extra[F.col("ratio")]).cast("long").alias("cut"))

    groups = sketch.where(F.col("ratio") == names[0]).groupBy("lang", "source").agg(F.sum("n").alias("__n"))
    x = groups.withColumn("ratio", F.explode(F.array(*map(F.lit, names)))).alias("g")
    o, lg, everything = quantiles(["lang", "source"]).alias("o"), quantiles(["lang"]).alias("l"), quantiles([]).alias("a")
    col = F.col
    x = x.join(o, col("g.lang").eqNullSafe(col("o.lang")) & col("g.source").eqNullSafe(col("o.source")) & (col("g.ratio") == col("o.ratio")), "left")
    x = x.join(lg, col("g.lang").eqNullSafe(col("l.lang")) & (col("g.ratio") == col("l.ratio")), "left")
    x = x.join(F.broadcast(everything), col("g.ratio") == col("a.ratio"), "left")  # one row a ratio
    chosen = F.when(col("o.all") >= least, col("o.cut")).when(col("l.all") >= least, col("l.cut")).otherwise(col("a.cut"))
    return x.groupBy(col("g.lang").alias("lang"), col("g.source").alias("source")).agg(F.max("g.__n").alias("__n"), *(F.max(F.when(col("g.ratio") == n, chosen)).alias(f"cut_{n}") for n in names))


def judged(features: DataFrame, limits: DataFrame) -> DataFrame:
    """features with base_failed and kept: neither base-failed nor above a cutoff of its group. limits: cutoffs()."""
    names = [c.removeprefix("cut_") for c in limits.columns if c.startswith("cut_")]
    joined = looked_up(features, limits, ["lang", "source"], F.xxhash64(*features.columns))
    ppm = ratios()
    over = F.lit(False)
    for n in names:
        over = over | F.coalesce(ppm[n] > F.col(f"cut_{n}"), F.lit(False))
    out = joined.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & ~over).drop(*(f"cut_{n}" for n in names))


def _inner(docs: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, list[str]]:
    """lang, source, the columns `keep` under names that nothing here uses, and the text; and these names."""
    names = [f"__{k}" for k in range(len(keep))]
    return docs.select("lang", "source", *(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)), F.col(f"`{text}`").alias("__text")), names


def judge_documents(docs: DataFrame, keep: list[str] | None = None, **options) -> DataFrame:
    """`keep` (default doc_id) of every document, its features, base_failed and kept.

    docs: doc_id, text, lang, source. Null text: no words, so base_failed. Null lang or source: a group
    like any other. Repeated rows are judged one by one and count each time. No rows: no rows. Very long
    texts are scanned whole, each in a block of its own. Other columns of docs are not read unless named
    in `keep`; one that has the name of a result gets underscores behind it.
    """
    keep = keep or ["doc_id"]
    limits = cut(cutoffs(with_features(docs, ["lang", "source"]), **options))
    inner, names = _inner(docs, keep, "text")
    results = [*FEATURES, "base_failed", "kept"]
    done = judged(with_features(inner, ["lang", "source", *names], "__text"), limits)
    return done.select(*(F.col(n).alias(c) for n, c in zip(names, apart(results, keep))), *results)


def filter_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with docs' own columns."""
    limits = cut(cutoffs(with_features(docs, ["lang", "source"]), **options))
    inner, names = _inner(docs, docs.columns, "text")
    kept = judged(with_features(inner, ["lang", "source", *names], "__text"), limits).where("kept")
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
