"""Ranks, exact samples and top-k without a global sort task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptsieve.functions.draws import digest

SAMPLE_DIGITS = 4  # 65 536 digest ranges; only the one at the boundary is ranked
RANK_DIGITS = 3    # 4 096 digest ranges per stratum


def exact_sample(df: DataFrame, key: str, *, n: int | None = None, frac: float | None = None, seed: int = 42,
                 salt: str = "sample", by: str | None = None, strata: tuple = ()) -> DataFrame:
    """Exactly ``n`` (or ``floor(frac * size)``) rows, those with the smallest keyed digest.

    Digest ranges are counted first. Ranges wholly below the cut need no ranking or shuffle; one range per stratum
    crosses the cut and is ranked. ``by`` samples each listed stratum on its own; rows of other strata are not
    sampled. The count table has at most ``16**SAMPLE_DIGITS * len(strata)`` rows.
    """
    if (n is None) == (frac is None):
        raise ValueError("give either n or frac")
    if by is not None and not 0 < len(strata) <= 15:
        raise ValueError("list the (at most 15) strata to sample")
    rows = df.where(F.col(by).isin(*strata)) if by else df
    stratum = F.col(by) if by else F.lit("all")
    ranked = (rows.withColumn("_stratum", stratum)
              .withColumn("_digest", digest(seed, salt, F.col(key)))
              .withColumn("_range", F.substring("_digest", 1, SAMPLE_DIGITS)))
    whole = Window.partitionBy("_stratum")
    below = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    take = F.lit(n).cast("bigint") if n is not None else F.floor(F.sum("_n").over(whole) * F.lit(frac))
    plan = (ranked.groupBy("_stratum", "_range").agg(F.count("*").alias("_n"))
            .select("_stratum", "_range", F.sum("_n").over(below).alias("_end"), "_n", take.alias("_take"))
            .where(F.col("_end") - F.col("_n") < F.col("_take"))
            .withColumn("_left", F.col("_take") - F.col("_end") + F.col("_n")))
    kept = ranked.join(F.broadcast(plan), ["_stratum", "_range"])
    inside = kept.where(F.col("_n") <= F.col("_left"))
    crossing = (kept.where(F.col("_n") > F.col("_left"))
                .withColumn("_rank", F.row_number().over(
                    Window.partitionBy("_stratum", "_range").orderBy("_digest", key)))
                .where(F.col("_rank") <= F.col("_left")))
    return inside.select(*df.columns).unionByName(crossing.select(*df.columns))


def bucketed_rank(df: DataFrame, strata: list[str], order: str, key: str, rank: str = "rank",
                  digits: int = RANK_DIGITS) -> DataFrame:
    """``row_number() over (order by strata, order, key)`` for a hex digest column ``order``.

    Rows are ranked inside (strata, digest range), which spreads one dominating stratum over many tasks, and shifted
    by the count of all earlier ranges. The only single-task step sums that small count table.
    """
    cells = [*strata, "_range"]
    ranged = df.withColumn("_range", F.substring(order, 1, digits))
    running = Window.orderBy(*cells).rowsBetween(Window.unboundedPreceding, 0)
    shift = (ranged.groupBy(*cells).agg(F.count("*").alias("_n"))
             .withColumn("_shift", F.sum("_n").over(running) - F.col("_n"))
             .select(*cells, "_shift"))
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy(*cells).orderBy(order, key)))
    return (local.join(shift, cells)
            .withColumn(rank, F.col("_local") + F.col("_shift"))
            .drop("_range", "_local", "_shift"))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds ``shuffle``, a digest to sort by for a random order that is the same on every run. Nothing is sorted here:
    ``sort`` or ``sortWithinPartitions`` by it is the reader's choice."""
    return df.withColumn("shuffle", digest(seed, "shuffle", F.col(key)))


def top_by_count(counts: DataFrame, n: str, k: int, *ties: str) -> DataFrame:
    """The ``k`` rows with the largest ``n``, ties by ``ties``.

    A histogram over powers of 2**(1/8) finds the lowest class that can still reach the top ``k``, so the final sort
    sees little more than ``k`` rows instead of ``k`` per partition.
    """
    size_class = F.floor(F.log2(F.col(n)) * 8)
    falling = Window.orderBy(F.desc("_class")).rowsBetween(Window.unboundedPreceding, 0)
    floor_class = (counts.groupBy(size_class.alias("_class")).agg(F.count("*").alias("_n"))
                   .withColumn("_before", F.sum("_n").over(falling) - F.col("_n"))
                   .where(F.col("_before") < k)
                   .agg(F.min("_class")).scalar())
    return counts.where(size_class >= floor_class).orderBy(F.desc(n), *ties).limit(k)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)
