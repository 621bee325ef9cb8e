"""Row counts of a corpus and of its splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptsieve.labels import label_name


def cleaning_stats(raw: DataFrame, groups: DataFrame) -> DataFrame:
    """(metric, name, n): rows before and after, conflicting rows, rows per class and per source.

    One grouping-sets pass over the text groups; the rows before cleaning are counted without reading a text.
    """
    clear = F.col("n_labels") == 1
    gid, n = F.col("_gid"), F.col("n")
    entry = lambda metric, name, value: F.struct(F.lit(metric).alias("metric"), name.alias("name"), value.alias("n"))
    entries = (
        F.when(gid == 1, F.array(entry("per_class", label_name(F.col("label")), n)))
        .when(gid == 2, F.array(entry("per_source", F.col("source"), n)))
        .otherwise(F.array(entry("rows_after_cleaning", F.lit(""), n),
                           entry("conflicting_label_rows_dropped", F.lit(""), F.col("_dropped")))))
    counted = (groups.select(clear.alias("_clear"), "n_rows", F.when(clear, F.col("first.label")).alias("label"),
                             F.when(clear, F.col("first.source")).alias("source"))
               .groupingSets([["label"], ["source"], []], "label", "source")
               .agg(F.grouping_id().alias("_gid"), F.count_if(F.col("_clear")).alias("n"),
                    F.sum(F.when(F.col("_clear"), 0).otherwise(F.col("n_rows"))).alias("_dropped"))
               .where((n > 0) | (gid == 3))
               .select(F.inline(entries)))
    before = raw.agg(F.count("*").alias("n")).select(
        F.lit("rows_before_cleaning").alias("metric"), F.lit("").alias("name"), "n")
    return counted.unionByName(before)


def split_stats(rows: DataFrame) -> DataFrame:
    """(split, label_name, n, split_rows, fraction): class counts per split and the split's share of all rows."""
    counts = rows.groupBy("split", "label").agg(F.count("*").alias("n"))  # at most splits x labels rows
    per_split = F.sum("n").over(Window.partitionBy("split"))
    return counts.select("split", label_name(F.col("label")).alias("label_name"), "n",
                         per_split.alias("split_rows"),
                         F.round(per_split / F.sum("n").over(Window.partitionBy()), 4).alias("fraction"))
