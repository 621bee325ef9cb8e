"""The corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, secret redaction, mixing.

Every stage is written as Parquet to the folder of ``spark.checkpoint.dir`` and read back as the next one's documents, so a
stage is computed once and outlives executors. The folders of a run stay until the shared folder is cleared, because the
result is read from the last of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from promptsieve.llm import decontaminate, mixing, ngram_join, quality, secrets
from promptsieve.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line frequencies reject go, and the common lines of the others."""
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; the documents stay."""
    return secrets.redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    return mixing.mix(docs)


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard", near_duplicates), ("decontamination", decontamination),
          ("secret_scans", secret_redaction), ("source_mixing", source_mixing)]

ORACLE_SQL = None   # near duplicates and decontamination are beyond SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
