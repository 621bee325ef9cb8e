"""Short runs of code points as two numbers, without loss: 21 bits per code point, three in each number.

Every code point counts one more than it is, so that 0 stands for none and the pairs order like the strings do. Counting them
needs no string per run, and there are no clashes to check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

PER_NUMBER, BITS = 3, 21
MAX_CHARS = 2 * PER_NUMBER
HELD = 1 << 20  # numbers that leave a task at once, 8 MB; more only for a single text that has more
FIELDS = 3      # numbers per entry: k1, k2 and the count


def _numbers(points: np.ndarray, starts: np.ndarray, size: int) -> list[np.ndarray]:
    """The two numbers of the runs of ``size`` at ``starts``."""
    out = []
    for first in (0, PER_NUMBER):
        number = np.zeros(len(starts), dtype=np.int64)
        for k in range(first, first + PER_NUMBER):
            number <<= BITS
            if k < size:
                number |= points[starts + k] + 1
        out.append(number)
    return out


def numbers(letters: np.ndarray, parts: list[np.ndarray]) -> list[np.ndarray]:
    """The two numbers of runs whose k-th code points are ``letters[parts[k]]``."""
    runs = np.stack([letters[p] for p in parts], axis=1).ravel()
    return _numbers(runs, np.arange(0, len(runs), len(parts)), len(parts))


def _row_counts(text: str, sizes: tuple[int, ...]) -> np.ndarray:
    """k1, k2, count of every distinct run, one after the other."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    letters, ranks = np.unique(points, return_inverse=True)
    entries = []
    for size in sizes:
        n = len(points) - size + 1
        if n <= 0:
            continue
        if len(letters) ** size < 1 << 62:      # runs as numbers in the base of the text's own alphabet
            codes = ranks[:n].astype(np.int64)
            for k in range(1, size):
                codes = codes * len(letters) + ranks[k:n + k]
            _, starts, counts = np.unique(codes, return_index=True, return_counts=True)
        else:
            first, second = _numbers(points, np.arange(n), size)
            order = np.lexsort((second, first))
            changes = np.flatnonzero((np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)) + 1
            bounds = np.concatenate(([0], changes, [n]))
            starts, counts = order[bounds[:-1]], np.diff(bounds)
        entries.append(np.stack([*_numbers(points, starts, size), counts], axis=1).ravel())
    return np.concatenate(entries) if entries else np.zeros(0, dtype=np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(r) for r in rows])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(rows), pa.int64())).cast(
        pa.list_(pa.int64()))


def counted_runs(text: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct runs of the given sizes with their counts, ``ARRAY<STRUCT<k1, k2, tf>>``; NULL text has none."""
    if max(sizes) > MAX_CHARS:
        raise ValueError(f"runs of more than {MAX_CHARS} characters don't fit")

    def flat(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows, held = [], 0
            for text in texts:
                rows.append(_row_counts(text.as_py() or "", sizes))
                held += len(rows[-1])
                if held >= HELD:
                    yield _lists(rows)
                    rows, held = [], 0
            if rows:
                yield _lists(rows)

    numbers = F.arrow_udf(flat, ArrayType(LongType()))(text)
    return F.transform(F.array(numbers), lambda a: F.when(F.size(a) > 0, F.transform(
        F.sequence(F.lit(0), F.size(a) - FIELDS, F.lit(FIELDS)),
        lambda i: F.struct(F.get(a, i).alias("k1"), F.get(a, i + 1).alias("k2"), F.get(a, i + 2).alias("tf"))))
        .otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<k1: BIGINT, k2: BIGINT, tf: BIGINT>>)")))[0]


def packed(term: Column) -> tuple[Column, Column]:
    """The two numbers of a string of at most six code points."""
    def number(first: int) -> Column:
        total = F.lit(0).cast("bigint")
        for k in range(first, first + PER_NUMBER):
            char = F.substring(term, k + 1, 1)
            total = F.shiftleft(total, BITS) + F.when(char == "", 0).otherwise(F.ascii(char) + 1).cast("bigint")
        return total
    return number(0), number(PER_NUMBER)


def unpacked(k1: Column, k2: Column) -> Column:
    """The string of two numbers."""
    def char(number: Column, place: int) -> Column:
        point = F.shiftright(number, BITS * place).bitwiseAND(F.lit((1 << BITS) - 1))
        text = F.decode(F.unhex(F.lpad(F.hex(point - 1), 8, "0")), "UTF-32")
        return F.when(point == 0, "").otherwise(text)
    return F.concat(*[char(n, p) for n in (k1, k2) for p in range(PER_NUMBER - 1, -1, -1)])
