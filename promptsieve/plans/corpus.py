"""Corpus preparation: clean, deduplicate, split, augment. One lazy chain per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.functions.text import normalize
from promptsieve.labels import SEED
from promptsieve.operators import augment, dedup, split, stats
from promptsieve.sources import sinks

MIN_CHARS = 3


def cleaned(raw: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Normalised texts of at least ``min_chars`` code points."""
    return raw.withColumn("text", normalize(F.col("text"))).where(F.length("text") >= min_chars)


def consolidate(raw: DataFrame, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(corpus, statistics) of the united sources."""
    clean = cleaned(raw, min_chars)
    corpus = dedup.consolidated(dedup.text_groups(clean)).select(*raw.columns)
    return corpus, stats.cleaning_stats(raw, dedup.text_groups(clean, carry_text=False))


def build(raw: DataFrame, path: str, frac: float = augment.FRACTION, max_chars: int | None = None,
          seed: int = SEED) -> DataFrame:
    """Write the corpus, its base splits and its augmented splits below ``path``; returns the augmented table.

    Each stage reads the table the stage before has written: a lost executor costs one stage's tasks, not the chain.
    ``row_id`` becomes a key of 128 bits made of source, id and text, since sources number their rows alike; a copy's key
    differs from its original's, so that every row of the result can be joined by its key.
    """
    spark = raw.sparkSession
    corpus, statistics = consolidate(raw)
    key = F.md5(F.to_json(F.struct("source", "row_id", "text")))
    corpus.withColumn("row_id", key).write.mode("overwrite").parquet(f"{path}/consolidated")
    sinks.write_json(statistics, f"{path}/consolidated_stats")
    placed = split.assign_split(spark.read.parquet(f"{path}/consolidated"), seed=seed)
    sinks.write_splits(placed, f"{path}/base")
    base = spark.read.parquet(f"{path}/base")
    sinks.write_json(stats.split_stats(base), f"{path}/split_summary")
    augmented = augment.augment_splits(base, frac=frac, seed=seed, max_chars=max_chars)
    is_copy = F.col("label") == augment.OBFUSCATION_LABEL
    own_key = F.when(is_copy, F.md5(F.concat_ws("/", "row_id", "source"))).otherwise(F.col("row_id"))
    sinks.write_splits(augmented.withColumn("row_id", own_key), f"{path}/splits")
    return spark.read.parquet(f"{path}/splits")
