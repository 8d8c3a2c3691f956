"""A corpus from raw documents to packed sequences: each stage works on all that the one before kept.

Every stage but the last returns the columns of documents. In all of them a null or empty text, a null doc_id, repeated rows, a table without rows
and further columns are no error; each docstring says what becomes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engramspark.llm import decontam, langid, minhash, packing, pii
from engramspark.llm.scratch import Scratch, temporary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of docs and drops the rows whose language it rejects: those without a letter (null and empty
    texts too), and those whose score is below that of nearly all rightly labelled ones. Each row is judged by its own text, so repeated rows share
    their fate and a null doc_id is nothing special. Without labelled rows nothing is learned and all rows go."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (five-word shingles, similarity of 0.75 or more) the row with the smallest doc_id. Texts
    without words are like no other and stay. Rows without a doc_id stay; of rows that repeat a doc_id one stays."""
    return minhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a passage of a benchmark item, also an edited one. Null and empty texts, and rows without a doc_id, stay; of rows
    that repeat a doc_id all go if one must."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates, the same for the same entity in all rows, and sets n_chars to the new text's length. All rows stay;
    null stays null."""
    return pii.pseudonymise(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts with their token ids and their place in sequences of at most 2048. A null or empty text is one end
    token; each of repeated rows gets its own place."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pseudonymisation", pseudonymisation),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models, tokenizers and components are beyond SQL; tests/llm holds the stages and run() against plain Python on fixtures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read again by the next. The tables that a stage works
    with, and its input, go when its rows are written."""
    scratch = Scratch(spark)
    rows, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with temporary():
            rows = scratch.cut(stage(spark, rows, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return rows
