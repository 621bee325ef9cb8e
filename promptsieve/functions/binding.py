"""Evaluate once, use many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, even where ``body`` uses it inside a lambda.

    The optimizer may inline a projected expression into a lambda, which would then compute it per array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
