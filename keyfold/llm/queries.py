"""The corpus queries: one for each operator, over whole tables, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import base64
from collections.abc import Callable

import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm import chat_format, line_dedup, mixing, piece_encode, quality_classifier, quality_rules, simhash, token_scan, topk, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
WORD = r"[^\x20\x09-\x0D]+"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The conversation that op2 adds: its texts hold the template's own marks.
EXTRA = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def varied(records: DataFrame) -> DataFrame:
    """Records of the messages layout in the layouts that sources use: by conv_id, where one of them can hold the conversation."""
    m, k = F.col("record.messages"), F.pmod(F.xxhash64("conv_id"), F.lit(4))
    roles = F.transform(m, lambda x: x["role"])
    said = lambda i: F.get(m, F.lit(i))["content"]
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    triple = (roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))) & (said(0) != "")
    asked = (roles == F.array(F.lit("user"), F.lit("user"), F.lit("assistant"))) & (said(1) != "")
    layout = F.when(pair & (k < 3), F.element_at(F.array(*map(F.lit, ("prompt", "response", "instruction"))), (k + 1).cast("int")))
    layout = layout.when(triple & (k < 2), "instruction_system").when(asked & (k < 2), "instruction_input")
    layout = layout.when((k == 2) & ~F.exists(roles, lambda r: r.isin("human", "gpt")), "conversations").when(k == 3, "nested_chat").otherwise("messages")
    named = records.withColumn("l", layout)
    is_ = lambda *names: F.col("l").isin(*names)
    renamed = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    last = F.element_at(m, -1)["content"]
    fields = {
        "messages": F.when(is_("messages"), m),
        "conversations": F.when(is_("conversations"), F.transform(m, lambda x: F.struct(renamed(x["role"]).alias("from"), x["content"].alias("value")))),
        "prompt": F.when(is_("prompt", "response"), said(0)),
        "completion": F.when(is_("prompt"), last),
        "response": F.when(is_("response"), last),
        "system": F.when(is_("instruction_system"), said(0)),
        "instruction": F.when(is_("instruction", "instruction_input"), said(0)).when(is_("instruction_system"), said(1)),
        "input": F.when(is_("instruction_input"), said(1)),
        "output": F.when(is_("instruction", "instruction_input", "instruction_system"), last),
        "chat": F.when(is_("nested_chat"), F.struct(F.transform(m, lambda x: F.struct(x["role"].alias("speaker"), x["content"].alias("utterance"))).alias("turns"))),
    }
    return named.select("conv_id", F.struct(*(c.alias(n) for n, c in fields.items())).alias("record"))


@query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string"))
    done = chat_format.format_chats(varied(chat_format.as_records(rows))).select("conv_id", "layout", "formatted", "loss_spans")
    back = done.withColumn("turns", chat_format.read_back(F.col("formatted")))
    masked = F.array_join(F.transform("loss_spans", lambda s: chat_format.unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE["op2_chat_format"] = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, replace(replace(role, '\', '\\'), '</turn>', '<\/turn>') AS r1,
         replace(replace(text, '\', '\\'), '</turn>', '<\/turn>') AS t1
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       sum(length('<turn>' || replace(r1, chr(10), '\n') || chr(10) || t1 || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query
def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLE["op3_exact_topk"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


#: Of byte_bpe_50k: the id that no text encodes to.
END_OF_DOCUMENT = 50256


def byte_bpe():
    """A function from a text to its ids in byte_bpe_50k; control strings in a text are ordinary text."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_scan.count_tokens(docs, byte_bpe, END_OF_DOCUMENT).select("doc_id", "n_tokens")


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(table(spark, sf_dir, "documents"))


def _bin(v: str) -> str:
    return f"CASE WHEN {v} < 16 THEN {v} ELSE 16 * (length(bin({v})) - 5) + ({v} >> (length(bin({v})) - 5)::INTEGER) END"


def _top(b: str) -> str:
    return f"CASE WHEN {b} < 16 THEN {b} ELSE ((({b} - 16 * ({b} // 16 - 1)) + 1) << ({b} // 16 - 1)::INTEGER) - 1 END"


ORACLE["op5_quality_rules"] = f"""
WITH words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM words) WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id
), f AS (
  SELECT d.doc_id, d.lang, d.source, len(d.w)::BIGINT AS n_words,
         length(array_to_string(d.w, ''))::BIGINT AS word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(range(2, len(d.w) + 1), lambda i: d.w[i] = d.w[i - 1]))::BIGINT AS n_echo_words
  FROM words d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN repeats r ON r.doc_id = d.doc_id
), p AS (
  SELECT *, 1000000 * n_symbols // nullif(word_chars, 0) AS symbol_ppm, 1000000 * n_repeat_words // nullif(n_words, 0) AS repeat_ppm,
         1000000 * n_dup_lines // nullif(n_words, 0) AS dup_line_ppm, 1000000 * n_echo_words // nullif(n_words, 0) AS echo_ppm, 1000000 * word_chars // nullif(n_words, 0) AS long_word_ppm
  FROM f
), v AS (
  SELECT lang, source, ratio, {_bin('x')} AS b FROM (
    {" UNION ALL ".join(f"SELECT lang, source, '{n}' AS ratio, {n} AS x FROM p" for n in quality_rules.GUARD)}
  ) WHERE x IS NOT NULL
), own AS (SELECT lang, source, ratio, quantile_disc(b, 0.5) AS b5, quantile_disc(b, 0.9) AS b9, count(*) AS n FROM v GROUP BY lang, source, ratio),
by_lang AS (SELECT lang, ratio, quantile_disc(b, 0.5) AS b5, quantile_disc(b, 0.9) AS b9, count(*) AS n FROM v GROUP BY lang, ratio),
overall AS (SELECT ratio, quantile_disc(b, 0.5) AS b5, quantile_disc(b, 0.9) AS b9 FROM v GROUP BY ratio),
chosen AS (
  SELECT o.lang, o.source, o.ratio, s.guard,
         CASE WHEN o.n >= {quality_rules.LEAST} THEN o.b5 WHEN l.n >= {quality_rules.LEAST} THEN l.b5 ELSE a.b5 END AS b5,
         CASE WHEN o.n >= {quality_rules.LEAST} THEN o.b9 WHEN l.n >= {quality_rules.LEAST} THEN l.b9 ELSE a.b9 END AS b9
  FROM own o JOIN by_lang l ON l.lang IS NOT DISTINCT FROM o.lang AND l.ratio = o.ratio JOIN overall a ON a.ratio = o.ratio
  JOIN (VALUES {", ".join(f"('{n}', {guard})" for n, guard in quality_rules.GUARD.items())}) s(ratio, guard) ON s.ratio = o.ratio
), cuts AS (
  SELECT lang, source, ratio, {_top('b9')} + {quality_rules.REACH} * ({_top('b9')} - {_top('b5')}) + guard AS cut FROM chosen
), wide AS (
  SELECT lang, source, {", ".join(f"max(CASE WHEN ratio = '{n}' THEN cut END) AS cut_{n}" for n in quality_rules.GUARD)} FROM cuts GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_echo_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND NOT ({" OR ".join(f"coalesce({n} > cut_{n}, false)" for n in quality_rules.GUARD)}) AS kept
FROM p LEFT JOIN wide w ON w.lang IS NOT DISTINCT FROM p.lang AND w.source IS NOT DISTINCT FROM p.source
"""


@query
def op6_piece_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = piece_encode.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), decode=True)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


ORACLE["op9_url_filter"] = r"""
WITH rules(rule, rhost, rpath, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '(?s)^[^?#]*', 0) ELSE '' END AS rest
  FROM pages
), hp AS (
  SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
  FROM parts
), fits AS (
  SELECT hp.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY hp.page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS k
  FROM hp JOIN rules r ON (hp.host = r.rhost OR ends_with(hp.host, '.' || r.rhost)) AND starts_with(hp.path, r.rpath)
)
SELECT hp.page_id, hp.host, hp.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM hp LEFT JOIN fits f ON f.page_id = hp.page_id AND f.k = 1
"""
