"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. The whole part of target / size is taken of each of its documents for certain;
the fraction is a fixed-size sample in which documents rank by random odds divided by inclusion odds. The sample's words,
not its documents, are fixed: documents are taken in rank order until the next one would end further past the target than
the target lies past its start.

Ranks are cut by two histograms of at most BINS rows per source and one window over the single cell that holds the cut, so
a source with a third of all rows is summed map-side and never ordered in one task.

Edge cases: null texts and texts without a word have size 0 and take 0; a null source is a source of its own, ordered last;
rows that repeat an id share its draw and are told apart by size; an empty table gives an empty table; with no words at all
every target is 0. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsieve.llm.common import SPACE, cut, small

WEIGHTS = (1, 2, 3)     # of the sources in order, repeating
CAP = 3                 # copies of a document at most
BINS = 1024
SEED = "mix"


def uniform(key: Column, seed: str = SEED) -> Column:
    """A keyed draw strictly between 0 and 1, with 52 random bits."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"))), 1, 13), 16, 10)
    return (bits.cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, place): ``place`` in (0, 1) orders by random odds over inclusion odds; long documents have
    the higher odds, by the root of their size."""
    size = F.coalesce(F.regexp_count("text", F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")
    odds = F.col("_u") / (1 - F.col("_u")) / F.sqrt(F.greatest("size", F.lit(1)))
    return (docs.select("doc_id", "source", size.alias("size"), uniform(F.col("doc_id"), seed).alias("_u"))
            .select("doc_id", "source", "size", (odds / (1 + odds)).alias("place")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): sizes shared out by weight, none above ``cap`` times its source's size.

    A capped source's excess goes to the others by weight. Each pass asks for two sums of the source table; a pass caps at
    least one more source, and the passes end when none is above. The one-task step orders one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, len(weights)) + 1).cast("int"))
    per = cut(ranked.select("source", "source_size", weight.alias("weight")))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, None
    while True:
        is_capped = F.lit(False) if level is None else F.col("source_size") * cap < F.col("weight") * level
        n, full, open_weight = per.agg(F.count_if(is_capped), F.sum(F.when(is_capped, F.col("source_size"))),
                                       F.sum(F.when(~is_capped, F.col("weight")))).first()
        if n == capped or not open_weight:
            break
        level, capped = (total - cap * (full or 0)) / open_weight, n
    target = F.least(F.col("weight") * F.lit(float(level or 0)), (F.col("source_size") * cap).cast("double"))
    return cut(per.select("source", "source_size", target.alias("target")))


def _crossing(rows: DataFrame, column: str, start: str) -> DataFrame:
    """(source, column, start): of each source the bin in which its sum reaches ``_need``; ``start`` is the sum before."""
    w = Window.partitionBy("source").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    bins = rows.groupBy("source", column).agg(F.sum("size").alias("_n"), F.first("_need").alias("_need"),
                                              F.first("_from").alias("_from"))
    return (bins.withColumn("_to", F.sum("_n").over(w) + F.col("_from"))
            .where((F.col("_to") >= F.col("_need")) & (F.col("_to") - F.col("_n") < F.col("_need")))
            .select("source", column, (F.col("_to") - F.col("_n")).alias(start)))


def _by_source(rows: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    facts = facts.withColumnRenamed("source", "_source")
    return rows.join(facts, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words the mix takes of every row of ``docs``, copies counted."""
    rows = cut(sized(docs, seed))
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = (targets(rows, weights, cap).withColumn("_whole", ratio.cast("bigint"))
             .withColumn("_need", F.col("target") - F.col("_whole") * F.col("source_size")))
    goals = small(goals)
    b1 = F.floor(F.col("place") * BINS)
    rows = (_by_source(rows, goals).withColumn("_b1", b1)
            .withColumn("_b2", F.floor((F.col("place") * BINS - F.col("_b1")) * BINS)))
    first = small(cut(_crossing(rows.withColumn("_from", F.lit(0)), "_b1", "_from1").withColumnRenamed("_b1", "_c1")))
    rows = _by_source(rows, first, "left")
    inside = rows.where("_b1 = _c1").withColumn("_from", F.col("_from1"))
    second = small(cut(_crossing(inside, "_b2", "_from2").withColumnRenamed("_b2", "_c2")))
    rows = _by_source(rows, second, "left")
    at_cut = F.coalesce((F.col("_b1") == F.col("_c1")) & (F.col("_b2") == F.col("_c2")), F.lit(False))
    w = Window.partitionBy("source").orderBy("place", "size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("_from2") + F.sum("size").over(w) - F.col("size") / 2
    taken = lambda extra: (F.col("size") * (F.col("_whole") + extra.cast("int"))).alias("taken")
    columns = ["doc_id", "size", "source_size", "target"]
    before = F.when(F.col("_b1") == F.col("_c1"), F.coalesce(F.col("_b2") < F.col("_c2"), F.lit(False))).otherwise(
        F.coalesce(F.col("_b1") < F.col("_c1"), F.lit(False)))
    return (rows.where(~at_cut).select(*columns, taken(before))
            .unionByName(rows.where(at_cut).withColumn("_in", middle <= F.col("_need"))
                         .select(*columns, taken(F.col("_in")))))
