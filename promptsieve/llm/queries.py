"""One registered query per operator, over whole tables with production parameters, and the SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from promptsieve.llm import (decontaminate, licenses, mixing, ngram_join, packing, phrases, pseudonyms, quality, secrets,
                             token_counts, toxicity, warc, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_ngram_jaccard(spark, sf_dir):
    return ngram_join.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query
def op2_token_counts(spark, sf_dir):
    return token_counts.counted(documents(spark, sf_dir))


@query
def op3_warc_derivatives(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.digest(warc.derived(warc.responses(pages)))


@query
def op4_toxicity(spark, sf_dir):
    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op5_quality_rules(spark, sf_dir):
    return quality.judged(documents(spark, sf_dir))


@query
def op6_secret_scans(spark, sf_dir):
    return secrets.digest(documents(spark, sf_dir))


@query
def op7_source_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir))


@query
def op8_pseudonyms(spark, sf_dir):
    return pseudonyms.digest(documents(spark, sf_dir))


@query
def op9_license_scans(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


@query
def op10_decontamination(spark, sf_dir):
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op11_best_fit_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


@query
def op12_embedding_whitening(spark, sf_dir):
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op13_phrase_collocations(spark, sf_dir):
    return phrases.collocations(documents(spark, sf_dir))


def oracle_sql() -> dict[str, str]:
    from promptsieve.llm import sql

    return sql.statements()
