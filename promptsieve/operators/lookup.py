"""Joins whose behaviour does not depend on how often a key repeats, or on how large the small side grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000  # the largest declared row bound that is still broadcast
HOT_ROWS = 1_000_000        # a key with at least this many rows takes the broadcast route
HOT_KEYS = 10_000           # broadcast at most so many hot keys; a key beyond them holds under 1/10000 of the rows


def bounded(dim: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only when the row bound that the caller proves is small; otherwise AQE decides by size."""
    return F.broadcast(dim) if max_rows <= BROADCAST_ROWS else dim


def skew_safe_lookup(rows: DataFrame, dim: DataFrame, key: str, value: str, n_rows: str, spread: Column,
                     hot_rows: int = HOT_ROWS, n_keys: int | None = None) -> DataFrame:
    """Left lookup ``rows.key -> dim.value`` for a ``dim`` with one row per key and its row count ``n_rows``.

    A ``dim`` whose row count ``n_keys`` is known and small is broadcast as a whole, and no row moves. Otherwise hot keys are
    answered by broadcast. Their rows then leave the shuffle join under a scattered key (``spread``) that matches nothing, so no
    task receives more than one ordinary key's rows.
    """
    if n_keys is not None and n_keys <= BROADCAST_ROWS:
        return rows.join(F.broadcast(dim.select(key, value)), key, "left")
    hot = (dim.where(F.col(n_rows) >= hot_rows).orderBy(F.desc(n_rows), key).limit(HOT_KEYS)
           .select(F.col(key), F.col(value).alias("_hot")))
    routed = (rows.join(F.broadcast(hot), key, "left")
              .withColumn("_route", F.when(F.col("_hot").isNull(), F.col(key))
                          .otherwise(F.concat(F.lit("hot:"), spread.cast("string")))))
    cold = dim.select(F.col(key).alias("_route"), F.col(value).alias("_cold"))
    return (routed.join(cold, "_route", "left")
            .withColumn(value, F.coalesce("_hot", "_cold"))
            .drop("_route", "_hot", "_cold"))
