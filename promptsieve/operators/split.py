"""Leakage-free stratified split: whole near-duplicate groups, balanced classes, a stable fold per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsieve.functions.draws import digest
from promptsieve.functions.text import group_key
from promptsieve.labels import LABELS, SEED
from promptsieve.operators.lookup import HOT_ROWS, skew_safe_lookup
from promptsieve.operators.neardup import with_family
from promptsieve.operators.ranking import bucketed_rank
from promptsieve.session import materialized

N_FOLDS = 20
HELDOUT_SHARE = 0.15


def with_group_key(prompts: DataFrame, mode: str = "text", **kw) -> DataFrame:
    """Add ``group_key``: the near-duplicate family of the whole text, or with ``mode="prefix"`` the key of its first letters
    and digits, which is the reference's rule and takes the options of ``group_key``."""
    if mode == "prefix":
        return prompts.withColumn("group_key", group_key(F.col("text"), **kw))
    if mode != "text":
        raise ValueError(f"unknown group mode {mode!r}")
    return with_family(prompts, "group_key", **kw)


def group_classes(keyed: DataFrame, labels=tuple(LABELS)) -> DataFrame:
    """One row per group: rows per class (``c0``, ``c1``, ...) and in total. Combines map-side."""
    per_class = [F.count_if(F.col("label") == v).alias(f"c{v}") for v in labels]
    return keyed.groupBy("group_key").agg(F.count("*").alias("n_rows"), *per_class)


def stratum(labels=tuple(LABELS)) -> Column:
    """Binary digits of each class count, one rule for groups of every size: 1, 2 to 3, 4 to 7 and so on.

    Strata grow with the logarithm of the largest group only.
    """
    digits = [F.when(F.col(f"c{v}") > 0, F.length(F.bin(f"c{v}"))).otherwise(0) for v in labels]
    return F.concat_ws(",", *[d.cast("string") for d in digits])


def group_folds(groups: DataFrame, n_folds: int = N_FOLDS, seed: int = SEED, labels=tuple(LABELS)) -> DataFrame:
    """Deal the groups to folds in turn, largest size class first, one stratum after the other, drawn order inside.

    Consecutive dealing keeps the folds of each stratum within one group of each other.
    """
    drawn = (groups.withColumn("_size", -F.length(F.bin("n_rows")))
             .withColumn("_stratum", stratum(labels))
             .withColumn("_digest", digest(seed, "fold", F.col("group_key"))))
    ranked = bucketed_rank(drawn, ["_size", "_stratum"], "_digest", "group_key", rank="_rank")
    return (ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(n_folds)).cast("int"))
            .drop("_size", "_stratum", "_digest", "_rank"))


def split_of(fold: Column, n_folds: int = N_FOLDS) -> Column:
    """Last folds test, those before them validation, the rest train."""
    held = round(HELDOUT_SHARE * n_folds)
    return (F.when(fold >= n_folds - held, "test").when(fold >= n_folds - 2 * held, "val").otherwise("train"))


def assign_split(prompts: DataFrame, n_folds: int = N_FOLDS, seed: int = SEED, labels=tuple(LABELS),
                 hot_rows: int = HOT_ROWS, **key_options) -> DataFrame:
    """Add ``group_key``, ``fold`` and ``split``. ``key_options`` go to ``with_group_key``."""
    keyed = with_group_key(prompts, **key_options)
    folds = group_folds(group_classes(keyed, labels), n_folds, seed, labels).select("group_key", "n_rows", "fold")
    folds = materialized(folds, "folds")
    placed = skew_safe_lookup(keyed, folds, "group_key", "fold", "n_rows", F.col("row_id"), hot_rows, folds.count())
    return placed.withColumn("split", split_of(F.col("fold"), n_folds))


def split_leakage(rows: DataFrame) -> DataFrame:
    """One summary row: groups, groups that touch more than one split, rows, rows without a split."""
    one_bit = {"train": 1, "val": 2, "test": 4}
    bit = None
    for name, value in one_bit.items():
        bit = F.when(F.col("split") == name, value) if bit is None else bit.when(F.col("split") == name, value)
    per_group = rows.groupBy("group_key").agg(
        F.bit_or(bit).alias("splits"), F.count("*").alias("n"), F.count_if(bit.isNull()).alias("unplaced"))
    return per_group.agg(F.count("*").alias("n_groups"),
                         F.count_if(F.bit_count("splits") > 1).alias("n_leaking_groups"),
                         F.sum("n").alias("n_rows"), F.sum("unplaced").alias("n_unplaced_rows"))
