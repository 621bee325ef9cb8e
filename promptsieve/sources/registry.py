"""Prompt sources by name: how each table maps to (row_id, text, label, source), and how sources combine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptsieve.labels import SEED
from promptsieve.operators.ranking import exact_sample
from promptsieve.sources.readers import content_id, pick_column, read_csv


@dataclass(frozen=True)
class Source:
    """``load`` gives the mapped table; ``cap`` keeps an exact-size seeded sample of it (0 keeps everything)."""

    name: str
    load: Callable[[], DataFrame]
    cap: int = 0


def labelled(df: DataFrame, text: Column, label: Column | int, source: str, key: str | None = None) -> DataFrame:
    """The four source columns. Without a key column the key derives from the text."""
    label = label if isinstance(label, Column) else F.lit(label)
    rows = df.select(F.col(key).cast("bigint").alias("row_id") if key else F.lit(None).cast("bigint").alias("row_id"),
                     F.coalesce(text.cast("string"), F.lit("")).alias("text"),
                     label.cast("int").alias("label"), F.lit(source).alias("source"))
    return rows.withColumn("row_id", F.coalesce("row_id", content_id(F.col("text"))))


# ---- mappings of the five public corpora; each takes the table(s) as downloaded

def wild(jailbreaks: DataFrame, regular: DataFrame, key: str | None = None) -> DataFrame:
    parts = [labelled(df, pick_column(df, "prompt", "text"), label, name, key)
             for df, label, name in ((jailbreaks, 1, "wild_jailbreak"), (regular, 0, "wild_regular"))]
    return parts[0].unionByName(parts[1])


def safeguard(*files: DataFrame, key: str | None = None) -> DataFrame:
    """Label 1 means injection here, so it becomes 2."""
    rows = None
    for df in files:
        given = pick_column(df, "label").cast("int")
        part = labelled(df, pick_column(df, "text", "prompt"), F.when(given == 0, 0).when(given == 1, 2),
                        "safeguard", key)
        rows = part if rows is None else rows.unionByName(part)
    return rows


def hackaprompt(df: DataFrame, key: str | None = None) -> DataFrame:
    """Successful submissions only, where the table says which those are."""
    if "correct" in df.columns:
        df = df.where(F.col("correct").cast("boolean"))
    return labelled(df, pick_column(df, "user_input", "prompt", "text"), 2, "hackaprompt", key)


def alpaca(df: DataFrame, key: str | None = None) -> DataFrame:
    """Instruction, and the input below it when there is one."""
    text = F.col("instruction")
    if "input" in df.columns:
        extra = F.coalesce("input", F.lit(""))
        text = F.concat(text, F.when(extra != "", F.concat(F.lit("\n"), extra)).otherwise(""))
    return labelled(df, text, 0, "alpaca", key)


def no_robots(df: DataFrame, key: str | None = None) -> DataFrame:
    return labelled(df, pick_column(df, "prompt", "text"), 0, "no_robots", key)


# Default caps.
DEFAULT_CAPS = {"hackaprompt": 8_000, "alpaca": 8_000, "no_robots": 5_000}


def load_source(spark: SparkSession, source: Source, overrides: str | None = None, seed: int = SEED,
                log: Callable[[str], None] = print) -> DataFrame | None:
    """The source's rows: ``<overrides>/<name>.csv`` when it exists, else ``source.load()``.

    A source whose table or columns are missing is skipped with a message. I/O errors while the job runs are not.
    """
    try:
        df = _override(spark, source, overrides)
        if df is None:
            df = source.load()
        df.schema
    except (AnalysisException, KeyError) as e:
        log(f"[{source.name}] skipped: {type(e).__name__}: {str(e).splitlines()[0]}")
        return None
    if source.cap:
        df = exact_sample(df.withColumn("_key", F.concat_ws(":", "source", "row_id")), "_key", n=source.cap,
                          seed=seed, salt=f"cap:{source.name}").drop("_key")
    return df


def _override(spark: SparkSession, source: Source, overrides: str | None) -> DataFrame | None:
    if overrides is None:
        return None
    path = f"{overrides.rstrip('/')}/{source.name}.csv"
    try:
        df = read_csv(spark, path, "text STRING, label INT")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return labelled(df, F.col("text"), F.col("label"), source.name)


def load_all(spark: SparkSession, sources: list[Source], overrides: str | None = None, seed: int = SEED,
             log: Callable[[str], None] = print) -> DataFrame:
    """All sources under each other with ``source_rank``; (source_rank, row_id) is the order "first" refers to."""
    corpus = None
    for rank, source in enumerate(sources):
        df = load_source(spark, source, overrides, seed, log)
        if df is None:
            continue
        df = df.select(F.lit(rank).alias("source_rank"), "row_id", "text", "label", "source")
        corpus = df if corpus is None else corpus.unionByName(df)
    if corpus is None:
        raise ValueError("no source could be loaded")
    return corpus
