"""Scans of prompt tables. Empty and missing text is '', the string ``NA`` stays text."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptsieve.functions.text import normalize
from promptsieve.labels import PROMPT_SCHEMA, SEED, binary_label
from promptsieve.operators.ranking import exact_sample


def pick_column(df: DataFrame, *candidates: str) -> Column:
    """First candidate the table has."""
    for name in candidates:
        if name in df.columns:
            return F.col(name)
    raise KeyError(f"none of {candidates} among columns {df.columns}")


def content_id(text: Column) -> Column:
    """Row key for sources that bring none: 60 bits of the text's md5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def read_csv(spark: SparkSession, path: str, schema: str = PROMPT_SCHEMA) -> DataFrame:
    df = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True,
                                       enforceSchema=False)
    return df.withColumn("text", F.coalesce("text", F.lit("")))


def exists(spark: SparkSession, path: str, fmt: str = "parquet") -> bool:
    """Whether ``path`` can be read; any other problem with it is raised."""
    try:
        spark.read.format(fmt).schema(PROMPT_SCHEMA).load(path).schema
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def read_split(spark: SparkSession, path: str, name: str, binary: bool = False, limit: int | None = None,
               seed: int = SEED) -> DataFrame:
    """One split of a table partitioned by ``split``; ``limit`` is an exact-size seeded sample."""
    df = spark.read.parquet(path).where(F.col("split") == name)
    df = df.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    if binary:
        df = df.withColumn("label", binary_label(F.col("label")))
    return exact_sample(df, "row_id", n=limit, seed=seed, salt=f"limit:{name}") if limit else df


def read_novel(spark: SparkSession, path: str, binary: bool = False, limit: int | None = None,
               seed: int = SEED) -> DataFrame | None:
    """The novel-phrasing set, or None when it has not been built."""
    if not exists(spark, path):
        return None
    df = spark.read.parquet(path)
    if binary:
        df = df.withColumn("label", binary_label(F.col("label")))
    return exact_sample(df, "row_id", n=limit, seed=seed, salt="limit:novel") if limit else df


def read_manual(spark: SparkSession, path: str) -> DataFrame | None:
    """Hand-written prompts with source ``manual``, or None when there is no file. The file holds text, label and
    optionally source."""
    if not exists(spark, path, "csv"):
        return None
    columns = spark.read.csv(path, header=True).columns
    schema = ", ".join({"label": "label INT"}.get(c, f"`{c}` STRING") for c in columns)
    df = read_csv(spark, path, schema)
    return (df.withColumn("text", normalize(F.col("text")))
            .select(content_id(F.col("text")).alias("row_id"), "text", "label", F.lit("manual").alias("source")))
