"""Documents to token ids in five stages, each written as Parquet and reread as the next one's input:
language ID, line dedup, near-duplicate removal, benchmark decontamination, byte-level BPE.

Every stage works on all rows its predecessor kept. Cases: as the operators state them. Null or empty
texts go in the first stage, as they have no letter. Of repeated rows (one doc_id, or none, and one text)
one stays from the third stage on; rows that share a doc_id but not the text count as one document there,
and go or stay together. Rows without doc_id are linked with nothing. An empty table gives an empty
table, very long texts are one row throughout, and columns beyond those of documents are cut, whatever
their names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcegrain.llm import bpe_transducer, decontaminate, language_id, line_dedup, minhash_dedup
from sourcegrain.llm.common import SPACE_CLASS, Scratch, table

#: Of the last stage: its workers share executors with what the earlier stages left in memory.
MEMO = 80_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and ambiguous ones; `lang` becomes the prediction."""
    docs = _documents(docs)
    model = language_id.fit_on(docs)
    judged = language_id.predict(docs, model, keep=("source", "n_chars", "text"))
    return judged.where(~F.col("ambiguous") & (F.col("lang_pred") != language_id.UNKNOWN)).select(
        "doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later similar lines go; a document of which no word is left goes too."""
    kept = line_dedup.dedup_lines(_documents(docs), ("lang", "source"), short_copies=True)
    return kept.where(F.rlike("text", F.lit(f"[^{SPACE_CLASS}]"))).select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least doc_id."""
    docs = _documents(docs)
    gone = minhash_dedup.link_documents(docs).where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    often = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again"))
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    once = left.join(often, same, "left_anti")
    return once.union(left.join(often, same, "left_semi").dropDuplicates(["doc_id", "text"])).select(*COLUMNS)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    marked = decontaminate.with_leaks(_documents(docs), table(spark, sf_dir, "benchmark"), "leaks_found")
    return marked.where(F.size("leaks_found") == 0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text that decoding them gives."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe_transducer.encode_documents(docs, path, pattern, memo=MEMO, keep=False)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_lines),
    ("minhash_dedup", remove_near_copies),
    ("decontaminate", remove_leaks),
    ("byte_bpe", encode),
]

#: SQL can't express the output codes, the sampled candidates or the transducer; tests/llm compares
#: the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
