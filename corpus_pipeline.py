"""From raw documents to token ids: quality rules, line dedup, near-duplicates, mixing and encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Stages are written as Parquet and read again, so that a lost executor costs no earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm import line_dedup, mixing, piece_encode, quality_rules, simhash
from keyfold.llm.runtime import written

#: Words of a block of the mix; runs of neighbouring blocks of a document stay together.
MIX_BLOCK_WORDS = 512


def fewer_files(df: DataFrame) -> DataFrame:
    """df in a quarter of the shuffle's partitions, 12 at least: a stage leaves texts of a few hundred bytes to a few KB, and its files should not be small."""
    return df.coalesce(max(12, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the cutoffs of their language and source reject go."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later similar lines go, and with them documents that have no word left; n_chars is counted anew."""
    done = line_dedup.dedup_lines(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return fewer_files(done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that a chain of pairs connects whose 5-word shingles have a Jaccard similarity of 0.8 or more, as simhash.similar_groups finds them."""
    return fewer_files(simhash.drop_similar(docs, shingle=5))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document's taken parts, once for each pass that takes them."""
    return fewer_files(mixing.mixed_documents(docs, block_words=MIX_BLOCK_WORDS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, ids and n_tokens of every text."""
    done = piece_encode.encode_documents(docs.select("doc_id", "lang", "source", "n_chars", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality rules", rules), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("mixing sources to target weights", mixed), ("SentencePiece encoding", encoded)]

#: None: no SQL expresses fingerprints, permutations or merges; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
