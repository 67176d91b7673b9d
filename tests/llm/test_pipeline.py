"""The registered queries without SQL, and the pipeline, against plain Python on small tables."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_operators import connected, slow_components, slow_fingerprint, slow_lines, slow_rules, slow_similar, words_of

import corpus_pipeline
from keyfold.llm import mixing, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=5, n=90):
    import random

    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgé") for _ in range(r.randrange(2, 8))) for _ in range(600)]
    line = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    common, rows = [line(9) for _ in range(4)], []
    for i in range(n):
        kind = r.random()
        text = "\n".join(r.choice(common) if r.random() < 0.3 else line(r.randrange(4, 40)) for _ in range(r.randrange(1, 6)))
        if kind < 0.1:
            text = " ".join([r.choice(vocab)] * 40)
        elif kind < 0.2:
            text = " ".join(w + "%%%" for w in words_of(text))
        elif kind < 0.35 and rows:
            text = r.choice(rows)[1]
        elif kind < 0.5 and rows:
            w = r.choice(rows)[1].split(" ")
            w[len(w) // 2] = r.choice(vocab)
            text = " ".join(w)
        rows.append((i, text, r.choice(["en", "de"]), r.choice(["a", "a", "a", "b", "c"]), len(text)))
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, int("%" not in t and len(set(words_of(t))) > 1), 0) for d, t, *_ in rows[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def mixed(rows, block):
    """doc_id, lang, source, text of the mix's rows; ids are unique and few."""
    by_source = defaultdict(list)
    for d, t, lang, source, *_ in sorted(rows):
        by_source[source].append((d, t, lang))
    names = sorted(by_source)
    sizes = [sum(len(words_of(t)) for _, t, _ in by_source[s]) for s in names]
    out = []
    for k, (s, size, target) in enumerate(zip(names, sizes, mixing.targets(sizes))):
        n = -(-size // block)
        slots = min(round(target / size * n), 3 * n)
        taken = defaultdict(set)
        for turn in range(-(-slots // n)):
            here = min(n, slots - turn * n)
            taken[turn] = set(mixing.permuted(np.arange(n), n, k * 64 + turn + mixing.SEED * 1_000_003)[:here].tolist())
        at = 0
        for d, t, lang in by_source[s]:
            spans = [(m.start(), m.end()) for m in __import__("re").finditer(r"[^\x20\x09-\x0D]+", t)]
            for turn in taken:
                run = []
                for i in range(len(spans) + 1):
                    if i < len(spans) and (at + i) // block in taken[turn]:
                        run.append(i)
                    elif run:
                        out.append((d, lang, s, t if len(run) == len(spans) else t[spans[run[0]][0] : spans[run[-1]][1]]))
                        run = []
            at += len(spans)
    return out


def test_pipeline_against_plain_python(spark, folder):
    path, rows = folder
    rows = [x for x, (_, _, kept) in zip(rows, slow_rules(rows_of(rows))) if kept]
    rows = [(d, t, lang, s) for (d, _, lang, s, _), t in zip(rows, slow_lines([x[:4] for x in rows])) if words_of(t)]
    rows = sorted(rows)
    label = connected(len(rows), slow_similar([t for _, t, *_ in rows]))
    rows = [x for k, x in enumerate(rows) if label[k] == k]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = Counter((d, lang, s, len(t), tuple(library.encode(t))) for d, lang, s, t in mixed(rows, corpus_pipeline.MIX_BLOCK_WORDS))
    got = corpus_pipeline.run(spark, path)
    assert Counter((x.doc_id, x.lang, x.source, x.n_chars, tuple(x.ids)) for x in got.collect()) == expected
    assert len(corpus_pipeline.STAGES) == 5 and expected


def rows_of(rows):
    return [x[:4] for x in rows]


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, folder[0])
            assert (out.columns == docs.columns) == (k < 4)
            assert df is docs or out.count() == 0


def run(spark, folder, name):
    return [x.asDict() for x in queries.QUERIES[name](spark, folder[0]).collect()]


def test_token_queries(spark, folder):
    encode = queries.byte_bpe()
    assert {x["doc_id"]: x["n_tokens"] for x in run(spark, folder, "op4_token_counts")} == {d: len(encode(t)) for d, t, *_ in folder[1]}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    coded = {d: library.encode(t) for d, t, *_ in folder[1]}
    assert {x["doc_id"]: (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in run(spark, folder, "op6_piece_encode")} == {d: (len(i), sha(",".join(map(str, i))), sha(library.decode(i))) for d, i in coded.items()}


def test_duplicate_queries(spark, folder):
    rows = folder[1]
    codes = sorted({slow_fingerprint(t) for _, t, *_ in rows})
    label = dict(zip(codes, slow_components(codes, 2)))
    least = defaultdict(lambda: math.inf)
    for d, t, *_ in rows:
        least[label[slow_fingerprint(t)]] = min(d, least[label[slow_fingerprint(t)]])
    assert {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in run(spark, folder, "op7_simhash")} == {d: (f"{slow_fingerprint(t):016x}", least[label[slow_fingerprint(t)]]) for d, t, *_ in rows}
    assert {x["doc_id"]: x["text"] for x in run(spark, folder, "op8_line_dedup")} == {d: t for (d, *_), t in zip(rows, slow_lines(rows_of(rows)))}


def test_short_lines_are_judged(spark, tmp_path):
    rows = [(1, "Home\nHome\n\nContact us\n中文没有空格的一行", "en", "a", 0), (2, "Home\nus Contact\n中文没有空格的一行\nAbout", "en", "a", 0), (3, "home\n \nHome us\nus us", "en", "b", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    expected = {d: t for (d, *_), t in zip(rows, slow_lines(rows_of(rows), min_words=1))}
    assert expected[1] == "Home\n\nContact us\n中文没有空格的一行" and expected[2] == "About"
    assert {x["doc_id"]: x["text"] for x in run(spark, [str(tmp_path)], "op8_line_dedup")} == expected
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {x.doc_id: x.text for x in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()} == expected


def test_mixing_query(spark, folder):
    taken = Counter()
    for d, _, _, t in mixed(rows_of(folder[1]), mixing.BLOCK_WORDS):
        taken[d] += len(words_of(t))
    got = run(spark, folder, "op10_mixing")
    assert {x["doc_id"]: x["taken"] for x in got} == {d: taken[d] for d, *_ in folder[1]} and {x["doc_id"]: x["size"] for x in got} == {d: len(words_of(t)) for d, t, *_ in folder[1]}


def test_classifier_query(spark, folder):
    got = {x["doc_id"]: x["kept"] for x in run(spark, folder, "op1_quality_classifier")}
    bad = [d for d, t, *_ in folder[1] if "%" in t or len(set(words_of(t))) == 1]
    assert len(got) == len(folder[1]) and sum(got[d] for d in got if d not in bad) >= 0.95 * (len(got) - len(bad)) and bad
