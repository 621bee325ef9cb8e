"""Keyed pseudo-random draws.

A draw depends only on (seed, salt, key), so it is the same on every run, partitioning and engine, and a retried task
repeats it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 32
GOLDEN_STEP = 2654435769


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def digest(seed, salt: str, *keys: Column) -> Column:
    parts = [_col(seed).cast("string"), F.lit(salt), *[k.cast("string") for k in keys]]
    return F.md5(F.concat_ws(":", *parts))


def row_seed(seed, salt: str, *keys: Column) -> Column:
    """First 32 bits of the digest as BIGINT."""
    return F.conv(F.substring(digest(seed, salt, *keys), 1, 8), 16, 10).cast("bigint")


def draw(seed, salt: str, *keys: Column) -> Column:
    """Uniform in [0, 1)."""
    return row_seed(seed, salt, *keys) / F.lit(float(SPAN))


def choice(n: int, seed, salt: str, *keys: Column) -> Column:
    """Uniform integer in [0, n)."""
    return F.floor(draw(seed, salt, *keys) * n).cast("int")


def step_draw(base: Column, i: Column) -> Column:
    """i-th draw of a row: one md5 per row, an arithmetic step per element."""
    return F.pmod(base + i.cast("bigint") * GOLDEN_STEP, F.lit(SPAN)) / F.lit(float(SPAN))


def pick(bank: list[str], seed, salt: str, *keys: Column) -> Column:
    """One entry of a phrase bank."""
    return F.element_at(F.array(*[F.lit(x) for x in bank]), choice(len(bank), seed, salt, *keys) + 1)
