"""Conflict removal and exact deduplication, in one aggregate that combines map-side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.functions.text import exact_key


def text_groups(prompts: DataFrame, carry_text: bool = True) -> DataFrame:
    """One row per distinct lower-cased text: how many labels and rows it has, and its first row.

    The shuffle key is a 64-character hash, and copies collapse before the shuffle, however many there are. Counting
    jobs leave the text behind. It comes last in the first row's order, so both forms name the same first row.
    """
    carried = [c for c in prompts.columns if c not in ("source_rank", "row_id", "text")]
    first = F.min(F.struct("source_rank", "row_id", *carried, *(["text"] if carry_text else []))).alias("first")
    return (prompts.withColumn("text_key", exact_key(F.col("text")))
            .groupBy("text_key")
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("label"))).alias("label_set"),
                 F.count("*").alias("n_rows"), first)
            .withColumn("n_labels", F.bit_count("label_set"))
            .drop("label_set"))


def conflicts(groups: DataFrame) -> DataFrame:
    """Texts that carry more than one label; all their rows are dropped from the corpus."""
    return groups.where("n_labels > 1").select("text_key", "n_labels", "n_rows")


def consolidated(groups: DataFrame) -> DataFrame:
    """First row of every conflict-free text."""
    return groups.where("n_labels = 1").select("first.*")


def first_per_key(df: DataFrame, key, *order: str) -> DataFrame:
    """Keep the first row per key in ``order``. An aggregate, so a hot key never becomes one sort task."""
    rest = [c for c in df.columns if c not in order]
    return (df.groupBy(key.alias("_key")).agg(F.min(F.struct(*order, *rest)).alias("_row"))
            .select(*[F.col("_row")[c].alias(c) for c in df.columns]))


def unseen(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose text, ignoring case, is in no row of ``seen``."""
    keys = seen.select(exact_key(F.col("text")).alias("_key")).distinct()
    return df.withColumn("_key", exact_key(F.col("text"))).join(keys, "_key", "left_anti").drop("_key")
