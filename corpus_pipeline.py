"""Corpus pipeline: stages over all that the one before kept, written and read again between them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from geoquill.llm import boosting, decontaminate, jaccard_join, sentencepieces, suffix_dedup
from geoquill.llm.common import delete, scratch, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality forest accepts; it is fitted on labelled documents of this stage's input.

    Rows are judged one by one: repeated rows stay or go together, null texts are judged as empty ones, null ids are kept
    if their text is accepted, and ties of the score with the threshold are accepted.
    """
    forest = boosting.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return boosting.score_quality(docs, forest).where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more; the least id stays, rows without words too."""
    return jaccard_join.one_of_each(docs)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that start earlier; rows whose text is all repeated stay, empty."""
    return suffix_dedup.dedup_texts(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; each row is judged by its own text, null texts stay."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids; null and empty texts have none."""
    return sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_text", repeated_text),
    ("benchmark_leaks", benchmark_leaks),
    ("pieces", pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. A stage's scratch tables go once its output is written, and that once the next one's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
