"""The corpus operators on small tables: brute force, round trips, and the odd cases that their docstrings define."""

import itertools
import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tiktoken
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyfold.llm import chat_format, graph, line_dedup, mixing, piece_encode, quality_classifier, quality_rules, queries, runtime, simhash, textblocks, token_scan, topk, url_filter

DOCS = "doc_id long, text string, lang string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "one", "a\tb\x0bc", "é ü 😀 中国", "x" * 50_000, "word " * 3_000, "a\u00a0b\u2028c", "tail \n"]


def make(seed=0, n=120):
    """Random documents with copies, near copies, repeated lines, nulls, ties and repeated rows."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7))) for _ in range(400)]
    line = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    common = [line(8) for _ in range(3)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.15 and rows:
            text = r.choice(rows)[1]
        elif kind < 0.35 and rows and rows[-1][1]:
            words = (r.choice(rows)[1] or "x y").split(" ")
            words[r.randrange(len(words))] = r.choice(vocab)
            text = " ".join(words)
        else:
            text = "\n".join(r.choice(common) if r.random() < 0.3 else line(r.randrange(1, 30)) for _ in range(r.randrange(1, 6)))
        rows.append((i, text, r.choice(["en", "fr", None]), r.choice(["a", "a", "b", None])))
    rows += [(1000 + k, t, "en", "a") for k, t in enumerate(ODD)]
    rows += [rows[0], rows[0], (3, "another text of the same id with quite a few words", "en", "b"), (None, "no id here but some words", None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return WORD.findall(text or "")


@settings(deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té\u00a0", max_size=30), min_size=1, max_size=8))
def test_blocks_find_words_and_lines(texts):
    import pyarrow as pa

    seen = []
    for a, b, block in textblocks.blocks(pa.array(texts), most=20):
        starts, ends, of = block.lines()
        for k in range(b - a):
            text = texts[a + k]
            x, y = block.word_at[k], block.word_at[k + 1]
            assert [block.data[s:e].tobytes().decode() for s, e in zip(block.starts[x:y], block.ends[x:y])] == words_of(text)
            assert [block.data[s:e].tobytes().decode() for s, e in zip(starts[of == k], ends[of == k])] == text.split("\n")
        seen += range(a, b)
        hashes = {}
        for s, e, h in zip(block.starts, block.ends, block.word_hashes()):
            assert hashes.setdefault(int(h), block.data[s:e].tobytes()) == block.data[s:e].tobytes()
        assert len(set(hashes.values())) == len(hashes)
    assert seen == list(range(len(texts)))


# ---- 1


def test_classifier_separates_held_out_texts(spark):
    r = random.Random(1)
    good, bad = [f"good{k}" for k in range(300)], [f"bad{k}" for k in range(300)]
    rows = [(k, " ".join(r.choice(good if k % 5 else bad) for _ in range(60)), "en", "a") for k in range(1000)]
    labels = spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(0, 400)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.kept for x in quality_classifier.resample(spark.createDataFrame(rows, DOCS), labels).collect()}
    held_out = range(400, 1000)
    assert sum(got[k] == (k % 5 > 0) for k in held_out) >= 0.94 * len(held_out) and all(got[k] for k in held_out if k % 5)


def test_classifier_against_brute_force(spark, docs, rows):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 60)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.resample(docs, labels, keep=["doc_id", "text"], share=0.6, buckets=64).collect()
    good = {k for k in range(0, 60) if k % 2}
    import pyarrow as pa

    def cells(text):
        (_, _, block), = textblocks.blocks(pa.array([text or ""]))
        one, two = quality_classifier.ngram_cells(block, 64)
        return [*one, *two[two >= 0]]

    raw, target = Counter(), Counter()
    for d, t, *_ in rows:
        raw.update(cells(t))
        if d in good:
            target.update(cells(t))
    lr = {c: round((np.log((target[c] + 1) / (sum(target.values()) + 64)) - np.log((raw[c] + 1) / (sum(raw.values()) + 64))) * quality_classifier.UNIT) for c in range(64)}
    keys = []
    for x in got:
        weight = sum(lr[c] for c in cells(x.text))
        assert x.log_weight * quality_classifier.UNIT == pytest.approx(weight, abs=len(cells(x.text)) + 1) and x.n_words == len(words_of(x.text))
        keys.append(x.sample_key)
    least = sorted(keys, reverse=True)[int(np.ceil(0.6 * len(keys))) - 1]
    assert all(x.kept == (x.sample_key >= least) for x in got) and len(got) == len(rows)
    assert quality_classifier.kth_largest(spark.createDataFrame([(v,) for v in (5, -9, 5, 1 << 60, None)], "v long"), "v", 3) == 5


def test_classifier_odd_cases(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.resample(none, labels).count() == 0
    assert {(x.log_weight, x.kept) for x in quality_classifier.resample(docs, labels).collect()} == {(0.0, True)}


# ---- 2


ROLE = st.one_of(st.none(), st.sampled_from(["user", "assistant", "system", "tool\nx", "a</turn>", "\\"]))
TEXT = st.one_of(st.none(), st.text(alphabet='a\\</turn>\n#:"é', max_size=25), st.sampled_from(["\\### Assistant: </turn> ok", "<\\/turn>", "\\n", "</turn>\n<turn>user\nx"]))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(ROLE, TEXT), min_size=1, max_size=5), min_size=1, max_size=6))
def test_formatting_reads_back(spark, chats):
    rows = [(c, k, r, t) for c, turns in enumerate(chats) for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(chat_format.as_records(df)).withColumn("back", chat_format.read_back(F.col("formatted")))
    for x in out.collect():
        expected = [(r or "", t or "") for r, t in chats[x.conv_id]]
        assert [(b.role, b.text) for b in x.back] == expected == [(b.role, b.text) for b in x.turns]
        parts = [x.formatted[s.start : s.start + s.length] for s in x.loss_spans]
        assert [re.sub(r"\\(.)", lambda m: {"n": "\n"}.get(m[1], m[1]), p) for p in parts] == [t for r, t in expected if r == "assistant"]


def test_layouts(spark):
    records = [
        '{"messages":[{"role":"user","content":"q"},{"content":"a","role":"assistant"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"completion":"a","prompt":"q"}', '{"instruction":"q","input":"","output":"a"}',
        '{"chat":{"turns":[{"utterance":"q","speaker":"user"},{"speaker":"assistant","utterance":"a"}]}}', '{"system":"","instruction":"q","output":"a"}', '{"prompt":"q","response":"a"}', '{"other":1}', "no json", None, "{}", '{"instruction":"q","output":null}',
    ]
    out = {x.record: x for x in chat_format.format_chats(spark.createDataFrame([(r, "extra") for r in records], "record string, layout_hint string")).collect()}
    assert all([(t.role, t.text) for t in out[r].turns] == [("user", "q"), ("assistant", "a")] for r in records[:7])
    assert len({out[r].formatted for r in records[:7]}) == 1 and len({out[r].fingerprint for r in records[:7]}) == 7
    assert all(out[r].layout is None and out[r].formatted is None for r in records[7:11]) and out["no json"].fingerprint is None
    assert [(t.role, t.text) for t in out[records[11]].turns] == [("user", "q")]
    assert chat_format.format_chats(spark.createDataFrame([], "record string")).count() == 0


def test_struct_records_have_the_fingerprints_of_json(spark):
    """Each layout as a struct with null for what it lacks; and a text that JSON's parser would give up on."""
    rows = [(k, t, r, f"{r} {k}") for k in range(200) for t, r in enumerate([["user", "assistant"], ["system", "user", "assistant"], ["user", "user", "assistant"], ["user"], ["human", "gpt"]][k % 5])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(queries.varied(chat_format.as_records(df))).collect()
    assert {x.layout for x in out} == {m.name for m in chat_format.MAPPINGS}
    for x in out:
        assert [(t.role, t.text) for t in x.turns] == [(r, t) for k, _, r, t in rows if k == x.conv_id]
    samples = spark.createDataFrame([(m.name, m.sample) for m in chat_format.MAPPINGS], "name string, sample string")
    prints = {x.name: x.f for x in samples.select("name", chat_format.fingerprint(F.col("sample")).alias("f")).collect()}
    assert all(x.fingerprint == prints[x.layout] for x in out)


def test_very_long_conversations(spark):
    n = 2_100_000
    text = F.concat(F.lit("\\</turn>"), F.repeat(F.lit("abcd efgh\n"), n), F.lit("\\"))
    long = spark.range(2).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.when(F.col("id") == 0, text).otherwise("x").alias("text"))
    done = chat_format.format_chats(chat_format.as_records(long))
    back = done.select("loss_spans", chat_format.read_back(F.col("formatted")).alias("t"))
    (x,) = back.select((F.col("t")[0]["text"] == text).alias("same"), F.col("t")[1]["text"].alias("second"), F.col("loss_spans")[0]["length"].alias("masked")).collect()
    assert (x.same, x.second, x.masked) == (True, "x", 10 * n + 12)
    too_long = spark.range(1).select(F.concat(F.lit('{"prompt":"'), F.repeat(F.lit("abcde"), 4_100_000), F.lit('","completion":""}')).alias("record"))
    with pytest.raises(Exception, match="too long for the JSON parser"):
        chat_format.format_chats(too_long).select("layout").collect()


def test_formatting_runs_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat_format.format_chats(chat_format.as_records(df))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 3


@pytest.mark.parametrize("block", [37, 2048])
def test_topk_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", block)
    r = random.Random(2)
    rows = [(i, [r.choice([-1.5, 0.0, 0.25, r.random() - 0.5]) for _ in range(6)]) for i in range(300)] + [(i, [1.0] * 6) for i in range(300, 320)] + [(400, None), (402, [float("nan")] * 6), (404, [None] * 6), (406, [float("inf")] + [0.0] * 5), (None, [0.0] * 6), (408, [0.5] * 3), (410, [0.25] * 3), (412, []), (3, rows_3 := [0.0] * 6), (4, [0.25] * 6), (5, [1.0] * 6), (5, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = defaultdict(list)
    for x in topk.exact_top_k(df, F.col("vec_id") % 2 == 0, k=5).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.score, x.vec_id))
        assert x["rank"] == len(got[x.query_id])
    vectors = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q = [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]
            vectors.append((i, q))
    expected = {}
    for q in {i for i, _ in vectors if i % 2 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for own, v in vectors if own == q for i, w in vectors if i != q and len(w) == len(v))[:5]
        if best:
            expected[q] = [(-s, i) for s, i in best]
    assert got == expected and rows_3


def test_topk_stops_early_and_takes_large_numbers():
    r = np.random.default_rng(3)
    m = np.floor(r.normal(size=(2000, 4)) * 50)
    index = topk.BlockIndex(np.arange(2000), m)
    for q in np.floor(r.normal(size=(20, 4)) * 50):
        best = sorted(zip((-(m @ q)).astype(int), range(2000)))[:5]
        assert index.search(q, -1, 5) == [(-s, i) for s, i in best]
        assert [x for x in index.search(q, -1, 5, -best[2][0]) if x[0] >= -best[2][0]] == [(-s, i) for s, i in best if s <= best[2][0]]
    big = topk.BlockIndex(np.arange(3), np.array([[2.0**60], [1.0], [-(2.0**60)]]))
    assert big.search(np.array([8.0]), -1, 3) == [((1 << 63) - 1, 0), (8, 1), (-(1 << 63), 2)]
    assert topk.BlockIndex(np.arange(3), np.ones((3, 2))).search(np.zeros(2), 1, 5) == [(0, 0), (0, 2)]


def test_topk_of_very_long_vectors(spark):
    r = np.random.default_rng(5)
    m = r.normal(size=(12, 20_000)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(m)], "vec_id long, embedding array<float>, id int")
    whole = np.floor(m.astype(np.float64) * 256)
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in topk.exact_top_k(df, F.col("vec_id") == 0, k=3).collect()}
    best = sorted(((-int(whole[0] @ whole[i]), i) for i in range(1, 12)))[:3]
    assert got == {(0, k + 1): (i, -s) for k, (s, i) in enumerate(best)}


def test_topk_broadcasts_no_copies_of_queries(spark):
    r = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(5_000, 4)))], "vec_id long, embedding array<double>")
    found = topk.exact_top_k(df, F.col("vec_id") % 10 == 0, k=1)
    assert found.count() == 500
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Generate explode" in plan
    for at in re.finditer("BroadcastExchange", plan):
        depth = plan[plan.rfind("\n", 0, at.start()) + 1 : at.start()]
        below = itertools.takewhile(lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)")) > len(depth), plan[at.end() :].split("\n")[1:])
        assert not any("Generate explode" in line for line in below)


def test_topk_blocks_grow_with_the_table():
    assert topk._rows_of_block(51_282, topk.BLOCK_ROWS, 64) == topk.BLOCK_ROWS
    assert topk._rows_of_block(15_000_000, topk.BLOCK_ROWS, 64) == topk.GROWTH * topk.BLOCK_ROWS
    assert topk._rows_of_block(15_000_000, topk.BLOCK_ROWS, 20_000) == topk.BLOCK_ROWS


def test_topk_of_nothing(spark):
    assert topk.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0).count() == 0


# ---- 4


def scanned(files, eod=9):
    out = set()
    for f, tokens in files.items():
        start = n = 0
        for k, t in enumerate(tokens):
            if t == eod:
                out.add((f, n, start, k - start, True))
                start, n = k + 1, n + 1
        if start < len(tokens):
            out.add((f, n, start, len(tokens) - start, False))
    return out


@pytest.mark.parametrize("width", [1, 2, 4])
def test_separator_scan(spark, tmp_path, width, monkeypatch):
    monkeypatch.setattr(token_scan, "GROUP", 3)
    r = random.Random(width)
    kind = token_scan._KINDS[width]
    files = {}
    for k in range(6):
        tokens = [r.choice([1, 2, 3, 4, 9]) if r.random() < 0.7 or k == 1 else 5 for _ in range(r.randrange(1, 200))] if k else [7] * 150
        path = tmp_path / f"{k}.bin"
        path.write_bytes(np.array(tokens, kind).tobytes())
        files[f"file:{path}"] = tokens
    (tmp_path / "empty.bin").write_bytes(b"")
    blocks = token_scan.read_flat_tokens(spark, str(tmp_path), width, block_tokens=7)
    got = {(x.file, x.ordinal, x.start, x.n_tokens, x.ended) for x in token_scan.scan_separators(blocks, 9, width).collect()}
    assert got == scanned(files)
    # a file system that the workers can't open by themselves
    monkeypatch.setattr(token_scan, "_opened", lambda path: (_ for _ in ()).throw(OSError()))
    again = token_scan.read_flat_tokens(spark, str(tmp_path), width, block_tokens=7)
    assert sorted(again.collect()) == sorted(blocks.collect())
    monkeypatch.undo()
    if width > 1:
        (tmp_path / "odd.bin").write_bytes(b"abcde")
        with pytest.raises(Exception, match="ends within a token"):
            token_scan.read_flat_tokens(spark, str(tmp_path / "odd.bin"), width).collect()


def test_large_token_files(spark, tmp_path):
    """A sparse file of over 4 GiB, read by ranges: its last blocks alone hold tokens other than 0."""
    path = tmp_path / "large.bin"
    with open(path, "wb") as f:
        f.seek((1 << 32) + 10)
        f.write(np.array([5, 9, 6, 7], "<u2").tobytes())
    rows = token_scan.read_flat_tokens(spark, str(path), 2, block_tokens=1 << 24)
    assert rows.select("block").count() == 129
    last = rows.where("block = 128").collect()
    assert [np.frombuffer(x.tokens, "<u2").tolist() for x in last] == [[0, 0, 0, 0, 0, 5, 9, 6, 7]]


def test_token_counts(spark, docs, rows, none):
    encode = queries.byte_bpe()
    got = token_scan.count_tokens(docs, queries.byte_bpe, queries.END_OF_DOCUMENT, block_tokens=64)
    assert Counter((x.doc_id, x.n_tokens) for x in got.collect()) == Counter((d, len(encode(t or ""))) for d, t, *_ in rows)
    assert token_scan.count_tokens(none, queries.byte_bpe, queries.END_OF_DOCUMENT).count() == 0
    assert isinstance(encode.__self__, tiktoken.Encoding)


# ---- 5


def slow_features(text):
    text = text or ""
    w = words_of(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), sum(a == b for a, b in zip(w, w[1:])))


def slow_bin(v):
    return v if v < 16 else 16 * (v.bit_length() - 5) + (v >> (v.bit_length() - 5))


def slow_top(b):
    return b if b < 16 else ((b - 16 * (b // 16 - 1) + 1) << (b // 16 - 1)) - 1


def slow_rules(rows, least=100, reach=3):
    feats = [slow_features(t) for _, t, *_ in rows]
    names = list(quality_rules.GUARD)

    def ppm(f):
        n, chars, symbols, dup, repeat, echo = f
        per = lambda a, b: 1_000_000 * a // b if b else None
        return {"symbol_ppm": per(symbols, chars), "repeat_ppm": per(repeat, n), "dup_line_ppm": per(dup, n), "echo_ppm": per(echo, n), "long_word_ppm": per(chars, n)}

    groups = defaultdict(list)
    for (_, _, lang, source), f in zip(rows, feats):
        for name, v in ppm(f).items():
            if v is not None:
                for key in ((lang, source), (lang,), ()):
                    groups[key, name].append(slow_bin(v))
    out = []
    for (_, _, lang, source), f in zip(rows, feats):
        failed = f[0] < 20 or 100 * f[4] > 30 * f[0]
        over = False
        for name in names:
            v = ppm(f)[name]
            if v is None:
                continue
            bins = sorted(next(g for g in (groups[k, name] for k in ((lang, source), (lang,), ())) if len(g) >= least or g is groups[(), name]))
            middle, high = (slow_top(bins[-(-len(bins) * q // 10) - 1]) for q in (5, 9))
            over |= v > high + reach * (high - middle) + quality_rules.GUARD[name]
        out.append((f, failed, not failed and not over))
    return out


@pytest.mark.parametrize("least", [1, 30, 10_000])
def test_rules_against_brute_force(docs, rows, least):
    got = quality_rules.judge_documents(docs, keep=["doc_id", "text"], least=least).collect()
    expected = Counter((d, t, *f, failed, kept) for (d, t, *_), (f, failed, kept) in zip(rows, slow_rules(rows, least)))
    assert Counter((x.doc_id, x.text, *(x[n] for n in quality_rules.FEATURES), x.base_failed, x.kept) for x in got) == expected


def test_groups_have_their_own_cutoffs(spark):
    """The same text is ordinary in a source of long words and rejected in a source of short ones."""
    r = random.Random(12)
    text = lambda n: " ".join("".join(r.choice("abcdef") for _ in range(n + r.randrange(3))) for _ in range(60))
    rows = [(k, text(12 if k % 2 else 4), "en", "long" if k % 2 else "short") for k in range(400)] + [(900, x := text(11), "en", "long"), (901, x, "en", "short"), (902, x, "en", "small"), (903, x, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    cuts = {(c.lang, c.source): c.cut_long_word_ppm for c in quality_rules.cutoffs(quality_rules.with_features(df, ["lang", "source"])).collect()}
    assert cuts["en", "short"] < 8_000_000 < 13_000_000 < cuts["en", "long"]
    got = {x.doc_id: x.kept for x in quality_rules.judge_documents(df).collect()}
    assert got[900] and not got[901] and got[902] and got[903] and all(got[k] for k in range(400))  # small groups go by their language, and by all
    assert {d: k for (d, *_), (_, _, k) in zip(rows, slow_rules(rows))} == got


def test_structured_lines_are_told_apart(spark):
    """Thue-Morse words and their complements are equal under polynomials modulo 2^64."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    (x,) = quality_rules.judge_documents(spark.createDataFrame([(1, f"{a}\n{b}", "en", "a")], DOCS)).collect()
    assert (x.n_dup_lines, x.n_echo_words, x.n_words) == (0, 0, 2)


def test_rules_keep_columns(spark, docs, rows, none):
    odd = docs.withColumns({"n_words": F.lit("mine"), "__text": F.lit(1), "kept": F.lit(False), "cut_symbol_ppm": F.lit(0)})
    got = quality_rules.filter_documents(odd)
    assert got.columns == odd.columns and {x.n_words for x in got.collect()} == {"mine"}
    assert Counter(x.text for x in got.collect()) == Counter(t for (_, t, *_), (_, _, kept) in zip(rows, slow_rules(rows)) if kept)
    assert quality_rules.judge_documents(none).count() == 0 and quality_rules.filter_documents(none).count() == 0
    clash = quality_rules.judge_documents(odd, keep=["doc_id", "n_words", "lang"])
    assert clash.columns == ["doc_id", "n_words_", "lang", *quality_rules.FEATURES, "base_failed", "kept"] and {x.n_words_ for x in clash.collect()} == {"mine"}


# ---- 6


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


PARTS = [" ", "  ", "\u2581", "\u2581\u2581", "a", "b", "the", "ing", "\n", "\t", "é", "ß", "😀", "中", ".", "!!", "###", "<s>", "<0x0A>", "0", "\r", "\u00a0", "\u0301", "THE", "\x00"]


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), st.text(max_size=40)))
def test_encoding_is_the_librarys(library, text):
    m = piece_encode.model(MODEL)
    ids = np.frombuffer(m.encode(text), np.int32)
    assert ids.tolist() == library.encode(text) and m.decode(ids) == library.decode(library.encode(text))


@settings(max_examples=400, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(0, 2), st.integers(3, 258), st.integers(0, 31_999)), max_size=12))
def test_decoding_is_the_librarys(library, ids):
    """Any ids: control and unknown pieces, bytes that are no character, pieces in any order."""
    assert piece_encode.model(MODEL).decode(np.array(ids, np.int64)) == library.decode(ids)


def test_encoding_of_clashing_columns(spark, library):
    df = spark.createDataFrame([(1, "a text", 5, "x"), (2, None, None, None)], "doc_id long, text string, ids int, decoded string")
    coded = piece_encode.encode_documents(df, MODEL, decode=True)
    assert coded.columns == ["doc_id", "ids_", "decoded_", "ids", "decoded"]
    assert {(x.doc_id, x.ids_, x.decoded_, tuple(x.ids), x.decoded) for x in coded.collect()} == {(1, 5, "x", tuple(library.encode("a text")), "a text"), (2, None, None, (), "")}


def test_encoding_of_whole_tables(docs, rows, none, library):
    coded = piece_encode.encode_documents(docs.select("doc_id", "text"), MODEL, decode=True)
    got = Counter((x.doc_id, tuple(x.ids), x.decoded) for x in coded.collect())
    assert got == Counter((d, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for d, t, *_ in rows)
    back = piece_encode.decode_documents(coded.drop("decoded"), MODEL)
    assert Counter((x.doc_id, x.decoded) for x in back.collect()) == Counter((d, dec) for (d, _, dec), n in got.items() for _ in range(n))
    assert piece_encode.encode_documents(none, MODEL).count() == 0


@pytest.mark.parametrize("text", ["a" * 40_000, "ab" * 20_000, " " * 3_000, "=-" * 9_000, "the" * 17_000])
def test_encoding_of_long_parts(library, text):
    assert np.frombuffer(piece_encode.model(MODEL).encode(text), np.int32).tolist() == library.encode(text)


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(open(MODEL, "rb").read().replace(b"\x18\x02 \x80\xfa\x01", b"\x18\x01 \x80\xfa\x01"))
    with pytest.raises(ValueError, match="not a BPE model"):
        piece_encode.PieceModel(str(tmp_path / "m"))


# ---- 7


def slow_fingerprint(text, k=3):
    w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(codes, radius):
    label = list(range(len(codes)))
    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_simhash_against_brute_force(docs, rows, none):
    got = simhash.near_duplicates(docs, keep=["doc_id", "text"]).collect()
    codes = sorted({slow_fingerprint(t) for _, t, *_ in rows})
    label = dict(zip(codes, slow_components(codes, 2)))
    least = defaultdict(list)
    for d, t, *_ in rows:
        least[label[slow_fingerprint(t)]].append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    assert Counter((x.doc_id, x.text, x.fp & (1 << 64) - 1, x.component_id) for x in got) == Counter((d, t, c := slow_fingerprint(t), least[label[c]]) for d, t, *_ in rows)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("radius,most", [(2, 4), (3, 1000)])
def test_links_against_brute_force(spark, radius, most):
    r = random.Random(radius)
    centres = [r.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    codes = set()
    for k in range(200):
        c = centres[0] if k % 3 == 0 else r.choice(centres)  # one centre with a third of all
        for _ in range(r.randrange(0, 9)):
            c ^= 1 << r.randrange(64)
        codes.add(c)
    codes = sorted(codes)
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    found = {x.node & (1 << 64) - 1: x.root for x in graph.components(simhash.links(df, radius, most)).collect()}
    got, expected = defaultdict(set), defaultdict(set)
    for c, k in zip(codes, slow_components(codes, radius)):
        expected[k].add(c)
        got[found.get(c, c)].add(c)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_gray_rank(spark):
    codes = [n ^ n >> 1 for n in [*range(64), (1 << 64) - 1, 1 << 63]]
    df = spark.createDataFrame([(k, c - (1 << 64) if c >> 63 else c) for k, c in enumerate(codes)], "k int, c long")
    ranks = {x.k: x.r for x in df.select("k", simhash.gray_rank(F.col("c")).alias("r")).collect()}
    assert [ranks[k] + (1 << 63) for k in range(len(codes))] == [*range(64), (1 << 64) - 1, 1 << 63]


def test_one_of_each_group_stays(docs, rows, none):
    got = simhash.drop_near_duplicates(docs, radius=2, shingle=3).collect()
    groups = {x.component_id if x.component_id is not None else ("null", x.fp) for x in simhash.near_duplicates(docs).collect()}
    assert len(got) == len(groups) and len(set(got)) == len(got) and set(got[0].asDict()) == {"doc_id", "text", "lang", "source"}
    ids = {x.doc_id for x in simhash.near_duplicates(docs).where("doc_id = component_id").collect()}
    assert {x.doc_id for x in got if x.doc_id is not None} == ids
    assert simhash.drop_near_duplicates(none).count() == 0


def slow_similar(texts, k=5):
    """Pairs of texts with a shingle similarity of 4/5 or more."""
    def grams(text):
        w = words_of(text.lower())
        return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or {" ".join(w)}
    sets = [grams(t) for t in texts]
    return {(i, j) for j in range(len(texts)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}


def near_copies(n, seed=1):
    """Texts of 60 to 300 words, each with a copy of a few changed words, so that similarities lie about 0.8."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(50_000)}"
    texts = []
    for _ in range(n):
        w = [word() for _ in range(r.randrange(60, 300))]
        texts.append(" ".join(w))
        for _ in range(max(1, len(w) * r.randrange(1, 5) // 200)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    return texts


def connected(n, pairs):
    label = list(range(n))
    for i, j in sorted(pairs):
        label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return label


@pytest.mark.parametrize("group", [8, 4096])
def test_similar_texts_against_brute_force(spark, group, monkeypatch):
    """No text is grouped without a chain of similar ones, and hardly a similar pair is missed."""
    monkeypatch.setattr(simhash, "GROUP", group)
    texts = near_copies(100)
    similar = slow_similar(texts)
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], DOCS)
    got = {x.doc_id: bytes(x.group) for x in simhash.similar_groups(df, 5, "text", ["doc_id"]).collect()}
    label = connected(len(texts), similar)
    assert all(label[i] == label[j] for i in got for j in got if got[i] == got[j])
    assert len(similar) > 50 and sum(got[i] == got[j] for i, j in similar) >= 0.97 * len(similar)
    kept = {x.doc_id for x in simhash.drop_similar(df).collect()}
    assert kept == {min(k for k in got if got[k] == g) for g in got.values()}


@pytest.mark.parametrize("group", [16, 4096])
def test_cluster_of_near_copies(spark, group, monkeypatch):
    """A third of all texts are copies of one with changed words, each like the first, but not all like each other; others are chains."""
    monkeypatch.setattr(simhash, "GROUP", group)
    r = random.Random(21)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(200)] = f"x{r.randrange(10_000)}"
        texts.append(" ".join(w))
    chain = [f"c{k}" for k in range(150)]
    for k in range(30):
        texts.append(" ".join(chain))
        chain[5 * k : 5 * k + 3] = [f"d{k}", f"e{k}", f"f{k}"]
    texts += [" ".join(f"u{r.randrange(3_000)}" for _ in range(100)) for _ in range(90)]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)] + [(500, None, None, None), (501, " ", None, None), (None, texts[0], None, None)], DOCS)
    label = connected(len(texts), slow_similar(texts))
    kept = {x.doc_id for x in simhash.drop_similar(df).collect()}
    assert kept == {i for i, k in enumerate(label) if i == k} | {500}


def test_wide_fingerprints_against_brute_force():
    import pyarrow as pa

    texts = ["", "One", "a B c d e f", "x " * 700 + "y", "e f a b"]
    (_, _, block), = textblocks.blocks(pa.array(texts))
    hashes, at = simhash.block_shingles(block, 5)
    found = simhash.wide_fingerprints(hashes, at)
    assert np.diff(at).tolist() == [0, 1, 2, 697, 1]
    for k in range(len(texts)):
        for lane, seed in enumerate(simhash._SEEDS):
            h = [int(x) for x in textblocks.mix(hashes[at[k] : at[k + 1]] ^ seed)]
            assert int(found[k, lane]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    (_, _, other), = textblocks.blocks(pa.array(["ONE", "A b C D E f", "x " * 5, "b a c d e"]))
    again, _ = simhash.block_shingles(other, 5)
    assert again[0] == hashes[0] and again[1] == hashes[1] and again[3] == hashes[3] and again[4] not in hashes


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (None, 1), (20, 20), *((k, k + 1) for k in range(100, 120))]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 5: 5, 20: 20, **{k: 100 for k in range(100, 121)}}


# ---- 8


def slow_lines(rows, min_words=1):
    lines = []
    for i, (d, t, *_) in enumerate(rows):
        for k, line in enumerate((t or "").split("\n")):
            w = words_of(line)
            if len(w) >= max(1, min_words):
                lines.append((d if d is not None else -(1 << 63), k, i, frozenset(w)))
    gone = set()
    for d, k, i, s in lines:
        for e, m, j, o in lines:
            if (e, m) < (d, k) and 5 * len(s & o) >= 4 * len(s | o):
                gone.add((i, k))
                break
    return ["\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) if t is not None else None for i, (_, t, *_) in enumerate(rows)]


@pytest.mark.parametrize("take", [1, 16])
def test_lines_against_brute_force(spark, none, take):
    rows = [x for x in make(4, 150) if x[0] not in (3, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({"n_lines": F.lit(1), "key": F.lit("k")}).drop("n_lines")
    got = line_dedup.dedup_lines(df, take=take).collect()
    assert Counter((x.doc_id, x.text) for x in got) == Counter((d, t) for (d, *_), t in zip(rows, slow_lines(rows)))
    assert {x.key for x in got} == {"k"} and all((x.n_lines, x.n_removed) == (0, 0) for x in got if x.text is None)
    assert line_dedup.dedup_lines(none).count() == 0


def test_lines_of_one_cluster(spark):
    """Very many variants of one line: each has an earlier match, found in further searches if not in the first."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(30)]
    rows = [(0, " ".join(base), "en", "a")]
    for i in range(1, 200):
        w = list(base)
        for _ in range(2):
            w[r.randrange(30)] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(w), "en", "a"))
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS), take=1).collect()}
    assert got == {d: t for (d, *_), t in zip(rows, slow_lines(rows))}


def test_lines_of_repeated_ids(spark):
    rows = [(1, "a b c d\nq r s t", "en", "a"), (1, "a b c d\nother words stand here", "en", "b"), (1, "a b c d\nq r s t", "en", "a"), (None, "a b c d", "en", "a")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()
    texts = Counter(x.text for x in got)
    assert texts["a b c d"] == 1 and texts["q r s t"] == 2 and texts["other words stand here"] == 1  # the row without id comes first


def test_words_of_one_token_differ(spark):
    """The hashes of 10189477 and 12445445 share their first 40 bits."""
    rows = [(1, "Visitor number 10189477", "en", "a"), (2, "Visitor number 12445445", "en", "a"), (3, "both 10189477 12445445 here", "en", "a"), (4, "here 12445445 both 10189477 10189477", "en", "a"), (5, "a b c d e f g 10189477", "en", "a"), (6, "a b c d e f g 12445445", "en", "a")]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {d: t if d != 4 else "" for d, t, *_ in rows} == {d: t for (d, *_), t in zip(rows, slow_lines(rows))}


def test_lines_jobs_do_not_grow_with_partitions(spark):
    """The driver fetches small tables in a few jobs, not in one for each partition of the shuffles."""
    rows = [(i, f"one two three four five six {i % 7}\nseven eight nine ten eleven {i}", "en", "a") for i in range(40)]
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before, jobs = [spark.conf.get(n) for n in names], []
    try:
        for n in (4, 24):
            for name, value in zip(names, (str(n), "false")):
                spark.conf.set(name, value)
            spark.sparkContext.setJobGroup(f"lines-{n}", "lines")
            line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"lines-{n}")))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    assert jobs[1] <= jobs[0] + 5, jobs


def shuffle_files(spark):
    """The data files of shuffles that are on disk."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in Path(d.getPath()).rglob("shuffle_*.data")}


def test_gathered_leaves_no_shuffle(spark, monkeypatch):
    """Rows come whole, in several parts, and the shuffles that made them don't stay on disk."""
    monkeypatch.setattr(runtime, "GATHER_BYTES", 1 << 10)
    before = shuffle_files(spark)
    rows = spark.range(500).groupBy((F.col("id") % 50).alias("k")).agg(F.count("*").alias("n"))
    assert sorted((r.k, r.n) for r in runtime.gathered(rows, 5 << 10)) == [(k, 10) for k in range(50)]
    assert list(runtime.gathered(rows.where("n < 0"), 0)) == []
    for _ in range(40):  # they are deleted in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.25)
    assert not shuffle_files(spark) - before


def test_lines_leave_no_packed_sets(spark):
    """The packed sets of all lines are of no use once the first lines are known, and go before the index is made; the result, computed later, doesn't need them."""
    runtime.shared_checkpoints(spark)
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = set(folder.glob("table-*"))
    rows = [x for x in make(8, 40) if x[0] not in (3, None)]
    done = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS))
    left = [set(pq.read_schema(next(t.glob("*.parquet"))).names) for t in set(folder.glob("table-*")) - before]
    assert {"key", "check", "d", "line", "h"} in left and not any({"once", "twice", "lines"} <= names for names in left)
    assert Counter((x.doc_id, x.text) for x in done.collect()) == Counter((d, t) for (d, *_), t in zip(rows, slow_lines(rows)))


def test_pairs_of_a_large_group():
    """Entries of one group in chunks of pairs: the pairs of the filters, at most `take` for each later set, and who had more."""
    r = np.random.default_rng(3)
    m = 600
    n = r.integers(4, 9, m)
    columns = [np.full(m, 5, np.uint64), n, np.zeros(m, np.int64), np.zeros(m, np.uint64), np.zeros(m, np.uint64), r.integers(-(1 << 62), 1 << 62, m), np.arange(m), np.arange(m), np.zeros(m, np.int64)]
    fits = {(x, y) for y in range(m) for x in range(y) if 5 * min(n[x], n[y]) >= 4 * max(n[x], n[y])}
    of = {int(k): i for i, k in enumerate(columns[5])}
    for take in (3, m):
        found = line_dedup._pairs([line_dedup._packed(columns)], None, take).to_pylist()
        pairs = [(of[f["x"]], of[f["y"]]) for f in found if f["x"] is not None]
        each = Counter(y for _, y in pairs)
        want = Counter(y for _, y in fits)
        assert set(pairs) <= fits and len(set(pairs)) == len(pairs) and each == {y: min(k, take) for y, k in want.items()}
        assert {of[k] for f in found if f["more"] for k in f["more"]} == {y for y, k in want.items() if k > take}


# ---- 9


def slow_url(rules, url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = re.match(r"[^?#]*", url.split("://", 1)[1], re.S)[0]
    host, slash, path = rest.partition("/")
    host, path = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in host), slash + path
    fits = [(h.count(".") + 1 if h else 0, len(p), v == "block", v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[4], best[3] if best else "allow"


def test_urls_against_brute_force(spark):
    r = random.Random(6)
    rules = list(queries.RULES) + [("allow", "example.net", "/en/x"), ("block", "a.b.org", ""), ("allow", "b.org", "/e"), ("block", "b.org", "/e"), ("block", "b.org", "/en/long/")]
    urls = [f"http{r.choice(['', 's'])}://{r.choice(['', 'www.', 'a.', 'x.Y.'])}{r.choice(['example.net', 'EXAMPLE.com', 'b.org', 'notnet', 'net', 'org', 'é.net'])}{r.choice(['', '/', '/en', '/en/', '/en/x', '/en/long/1', '/de/1', '/fr/a', '/e', '//en/'])}{r.choice(['', '?q=/en/', '#/x', '?'])}" for _ in range(400)]
    urls += [None, "", "no scheme/net/", "http://", "://net/", "a://b://net/", "http://net/\n/en/", "http://NET/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.judge_urls(df, rules).collect()}
    assert got == {k: slow_url(rules, u) for k, u in enumerate(urls)}
    kept = url_filter.filter_urls(df, rules)
    assert kept.columns == df.columns and {x.page_id for x in kept.collect()} == {k for k, u in enumerate(urls) if slow_url(rules, u)[3] == "allow"}
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        url_filter.UrlTrie([("maybe", "x", "/")])


def test_urls_odd_cases(spark):
    rules = [("block", "", ""), ("allow", "ÉX.org", "/"), ("allow", "Net", "/")]
    df = spark.createDataFrame([(1, None, "h"), (2, "", "h"), (3, "http://éx.org/", "h"), (4, "http://Éx.ORG/" + "a/" * 200_000, "h"), (5, "http://x.net/", "h")], "page_id long, url string, host string")
    got = {x.page_id: (x.rule, x.verdict, x.host_) for x in url_filter.judge_urls(df, rules, keep=["page_id", "host"]).collect()}
    assert got == {1: ("", "block", "h"), 2: ("", "block", "h"), 3: ("", "block", "h"), 4: ("ÉX.org/", "allow", "h"), 5: ("Net/", "allow", "h")}


# ---- 10


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([50, 100, 150])
    assert mixing.targets([1000, 10, 10]) == pytest.approx([960, 30, 30])
    assert mixing.targets([0, 5]) == [0, 5] and mixing.targets([]) == [] and mixing.targets([0]) == [0]
    r = random.Random(8)
    for _ in range(50):
        sizes = [r.choice([0, 1, 7, 100, 5000]) for _ in range(9)]
        t = mixing.targets(sizes)
        assert sum(t) == pytest.approx(sum(sizes)) and all(a <= 3 * s + 1e-9 for a, s in zip(t, sizes))
        free = {round(a / (k % 3 + 1), 6) for k, (a, s) in enumerate(zip(t, sizes)) if s and a < 3 * s - 1e-6}
        assert len(free) <= 1


def slow_permuted(i, n, key):
    """Four Feistel rounds in plain numbers, walked until the place is below n."""
    top = (1 << 64) - 1

    def spread(h):
        h ^= h >> 33
        h = h * 0xFF51AFD7ED558CCD & top
        h ^= h >> 33
        h = h * 0xC4CEB9FE1A85EC53 & top
        return h ^ h >> 33

    half = 1
    while 1 << 2 * half < n:
        half += 1
    while True:
        a, b = divmod(i, 1 << half)
        for r in range(1, 5):
            a, b = b, a ^ spread(b + (4 * key + r) * 0x9E3779B97F4A7C15 & top) % (1 << half)
        i = a << half | b
        if i < n:
            return i


@pytest.mark.parametrize("n", [1, 2, 3, 100, 4097])
def test_permutation(n):
    p = mixing.permuted(np.arange(n), n, 5)
    assert p.tolist() == [slow_permuted(i, n, 5) for i in range(n)]
    assert sorted(p) == list(range(n)) and (n < 100 or (p != mixing.permuted(np.arange(n), n, 6)).any())


@pytest.mark.parametrize("good,bad,drawn", [(7, 5, 4), (1, 30, 12), (400, 600, 300), (50, 0, 20), (0, 9, 3), (3, 4, 7), (30, 2, 31)])
def test_draws_have_the_hypergeometric_law(good, bad, drawn):
    from math import comb

    n, rng = 20_000, np.random.default_rng(1)
    draws = Counter(mixing.hypergeometric(rng, good, bad, drawn) for _ in range(n))
    law = {x: comb(good, x) * comb(bad, drawn - x) / comb(good + bad, drawn) for x in range(max(0, drawn - bad), min(good, drawn) + 1)}
    assert draws.keys() <= law.keys() and all(abs(draws[x] - n * p) < 5 * (n * p * (1 - p)) ** 0.5 + 1 for x, p in law.items())


@pytest.mark.parametrize("scale", [10**3, 10**8, 10**9, 10**11, 10**14])
def test_draws_of_large_numbers(scale):
    """One law at every size, far beyond 10^9 slots, too."""
    good, bad, drawn = 3 * scale, 7 * scale, 4 * scale
    rng = np.random.default_rng(2)
    sd = (drawn * 0.3 * 0.7 * 0.6) ** 0.5
    z = np.sort([(mixing.hypergeometric(rng, good, bad, drawn) - drawn * 0.3) / sd for _ in range(4_000)])
    cdf = np.array([0.5 * (1 + __import__("math").erf(v / 2**0.5)) for v in z])
    assert np.abs(cdf - (np.arange(4_000) + 0.5) / 4_000).max() < 0.03 + 0.5 / sd
    totals = np.array([scale, 5 * scale, 17, 0, 3 * scale])
    n = -(-int(totals.sum()) // 16)
    for shard in (0, n // 7, n - 2):
        first, counts = mixing.shard_counts(shard, totals, 16, 3)
        after, last = mixing.shard_counts(shard + 1, totals, 16, 3)
        assert counts.sum() == 16 and (first + counts == after).all() and (counts >= 0).all() and (after + last <= totals).all()


def test_shards_add_up():
    totals = np.array([1000, 3, 0, 517])
    parts = [mixing.shard_counts(k, totals, 100, 1) for k in range(16)]
    assert (sum(c for _, c in parts) == totals).all() and all(c.sum() == 100 for _, c in parts[:-1])
    assert (np.cumsum([c for _, c in parts], axis=0)[:-1] == np.array([f for f, _ in parts[1:]])).all()


def test_mix(spark, docs, rows, none):
    got = mixing.plan_mix(docs, block_words=8, shard_slots=64).taken().collect()
    again = mixing.plan_mix(docs.repartition(5), block_words=8, shard_slots=64).taken().collect()
    assert Counter(got) == Counter(again) and len(got) == len(rows)
    sizes, source, taken, target = Counter(), {d: s for d, _, _, s in rows}, Counter(), {}
    for _, t, _, s in rows:
        sizes[s] += len(words_of(t))
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    expected = dict(zip(names, mixing.targets([sizes[s] for s in names])))
    by_size = {v: k for k, v in sizes.items()}
    for x in got:
        s = by_size[x.source_size]
        taken[s] += x.taken
        target[s] = x.target
        assert x.taken <= 3 * x["size"]
    assert target == pytest.approx(expected) and source and all(abs(taken[s] - target[s]) <= 16 for s in names)
    assert mixing.plan_mix(none).taken().count() == 0


def test_mixed_documents(spark, docs, rows, none):
    odd = docs.withColumns({"n_chars": F.length("text"), "runs": F.lit("mine"), "offset": F.lit(1)})
    got = mixing.mixed_documents(odd, block_words=8, shard_slots=64)
    texts = defaultdict(set)
    for d, t, *_ in rows:
        texts[d].add(t)
    total = Counter()
    out = got.collect()
    for x in out:
        assert any(t is not None and x.text in t for t in texts[x.doc_id]) and x.n_chars == len(x.text) and x.runs == "mine"
        total[x.source] += len(words_of(x.text))
    counted = Counter()
    plan = mixing.plan_mix(odd, block_words=8, shard_slots=64)
    for x in plan.pieces().join(plan.layout.select("source_no", "offset", "source", "size"), ["source_no", "offset"]).where("size > 0").collect():
        counted[x.source] += x.n_words
    assert total == counted and got.columns == odd.columns and mixing.mixed_documents(none).count() == 0


def test_pieces_of_words_in_use_are_not_forgotten(monkeypatch):
    monkeypatch.setattr(piece_encode, "KNOWN", 4)
    path = public_tokenizers.path("piece_bpe_32k.model")
    m, library = piece_encode.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    made = Counter()
    part = m.part
    monkeypatch.setattr(m, "part", lambda text: made.update([text]) or part(text))
    text = " ".join(f"often new{k}漢{k}" for k in range(200))
    ids = np.frombuffer(m.encode(text), np.int32)
    assert ids.tolist() == library.encode(text) and m.decode(ids) == library.decode(ids.tolist())
    assert made[piece_encode.SPACE + "often"] == 1
