"""Runs of symbols of many rows at once, as numbers in the base of the symbols in use: counting runs is sorting numbers.

Symbols are the distinct words or code points of a chunk of rows. A chunk holds so few rows and symbols that a run and its row
fit one number; runs of many symbols are replaced by their rank among those in use before they would outgrow it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from promptsieve.functions.text import WHITESPACE, WORD_CHARS

CHUNK_SYMBOLS = 1 << 19     # symbols that are counted at once, in some 50 MB; more only for a single row that has more
CHUNK_ROWS = 1 << 12
MAX_CODE = 1 << 62
CODE_POINTS = 0x110000
OTHER, WORD, SPACE = 0, 1, 2

_kinds: list[tuple[np.ndarray, np.ndarray]] = []


class Coder:
    """How runs of one size are numbers. ``ranks`` has, for each symbol after the first, the sorted numbers whose ranks stand
    for the symbols before it, or None if they stand for themselves."""

    def __init__(self, base: int, ranks: tuple[np.ndarray | None, ...]):
        self.base, self.ranks = base, ranks

    def symbols(self, codes: np.ndarray) -> list[np.ndarray]:
        columns = []
        for ranked in reversed(self.ranks):
            columns.append(codes % self.base)
            codes = codes // self.base
            if ranked is not None:
                codes = ranked[codes]
        return [codes, *reversed(columns)]

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """One code per row of ``symbols``; -1 for runs with a symbol below 0, or with a part that is not in use."""
        found = (symbols >= 0).all(axis=1)
        codes = symbols[:, 0]
        for k, ranked in enumerate(self.ranks, start=1):
            if ranked is not None:
                at = np.minimum(np.searchsorted(ranked, codes), len(ranked) - 1)
                found &= ranked[at] == codes
                codes = at
            codes = codes * self.base + symbols[:, k]
        return np.where(found, codes, -1)


def runs(symbols: np.ndarray, bounds: np.ndarray, base: int,
         sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray, Coder]]:
    """(size, code, row, coder) of all runs inside rows; row k has the symbols ``bounds[k]`` to ``bounds[k + 1]``."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    left = bounds[row + 1] - np.arange(len(symbols))
    limit = MAX_CODE // max(1, len(bounds) - 1)
    codes, used, ranks = symbols, base, []
    for size in range(1, max(sizes) + 1):
        if size > 1:
            n = max(0, len(symbols) - size + 1)
            codes, ranked = codes[:n], None
            if n and used * base > limit:
                ranked, codes = np.unique(codes, return_inverse=True)
                used = len(ranked)
            ranks.append(ranked)
            codes = codes * base + symbols[size - 1:]
            used *= base
        if size in sizes:
            inside = left[:len(codes)] >= size
            yield size, codes[inside], row[:len(codes)][inside], Coder(base, tuple(ranks))


def distinct(codes: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, ...]:
    """(code, start, row, tf): the distinct runs, where each one's entries start, and these: a row and its count. ``start`` has
    the number of entries at its end."""
    keys = np.sort(codes * n_rows + row)
    first = _starts(keys)
    tf = np.diff(first, append=len(keys))
    keys = keys[first]
    code, rows = keys // n_rows, keys % n_rows
    start = _starts(code)
    return code[start], np.append(start, len(code)), rows, tf


def _starts(ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(0, dtype=np.int64)
    return np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))


def chunks(lengths: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """(first row, end row) with at most ``CHUNK_ROWS`` rows and ``most`` symbols, or one row."""
    most = CHUNK_SYMBOLS if most is None else most
    ends, first = np.cumsum(lengths), 0
    while first < len(lengths):
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        end = min(end, first + CHUNK_ROWS, len(lengths))
        yield first, end
        first = end


def sizes_of(column: pa.Array) -> np.ndarray:
    """Words of each list, or bytes of each string, which has no more code points than that; 0 for null."""
    measure = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
    return pc.fill_null(measure(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def word_symbols(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(symbols, bounds, words): the words of each list as places in ``words``."""
    bounds = np.concatenate(([0], np.cumsum(sizes_of(lists))))
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds, coded.dictionary


def kinds(spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
    """(first, kind): from which code points on characters are word characters, white space or others, as Spark's patterns
    have it, so that tokens are the same whoever cuts them. Asked once per process."""
    if not _kinds:
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        kind = F.when(char.rlike(f"[{WORD_CHARS}]"), WORD).when(char.rlike(f"[{WHITESPACE}]"), SPACE).otherwise(OTHER)
        points = spark.range(CODE_POINTS).where("id NOT BETWEEN 55296 AND 57343").select("id", kind.alias("kind"))
        table = np.zeros(CODE_POINTS, dtype=np.int8)
        for r in points.where(F.col("kind") != OTHER).groupBy("kind").agg(F.collect_list("id").alias("ids")).collect():
            table[r.ids] = r.kind
        first = np.concatenate(([0], np.flatnonzero(np.diff(table)) + 1))
        _kinds.append((first, table[first]))
    return _kinds[0]


def kind_table(first: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The kind of every code point."""
    return np.repeat(kind, np.diff(first, append=CODE_POINTS))


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, bounds) of the texts, one after the other."""
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    whole = "".join(t for t in texts.to_pylist() if t)
    return np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32), np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)


def token_symbols(texts: pa.Array, table: np.ndarray, long_words: bool = False,
                  stop_words: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(symbols, bounds, words): runs of word characters and every other visible character on its own, as ``word_tokens`` has
    them; with ``long_words`` only runs of two or more word characters. Stop words are left out."""
    points, ends = _points(texts)
    kind = table[points]
    starts = kind != SPACE
    alone = starts[ends[:-1][ends[:-1] < len(points)]]
    starts[1:] &= (kind[1:] != WORD) | (kind[:-1] != WORD)
    starts[ends[:-1][ends[:-1] < len(points)]] = alone    # a text's first character continues nothing
    at, visible = np.flatnonzero(starts), kind != SPACE
    held = points[visible]
    n_bytes = 1 + (held >= 0x80).astype(np.int64) + (held >= 0x800) + (held >= 0x10000)
    first = np.append(np.cumsum(visible)[at] - 1, len(held))
    offsets = np.concatenate(([0], np.cumsum(n_bytes)))[first].astype(np.int32)
    data = held.tobytes().decode("utf-32-le").encode()
    coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
    symbols, bounds = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(at, ends)
    if long_words or stop_words is not None:
        kept = (kind[at] == WORD) & (np.diff(first) >= 2) if long_words else np.ones(len(at), dtype=bool)
        if stop_words is not None and len(kept):
            kept &= ~pc.is_in(coded.dictionary, value_set=stop_words).to_numpy(zero_copy_only=False)[symbols]
        symbols, bounds = symbols[kept], np.concatenate(([0], np.cumsum(kept)))[bounds]
    return symbols, bounds, coded.dictionary


def char_symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, bounds, letters): the code points of each text as places in ``letters``."""
    points, bounds = _points(texts)
    in_use = np.zeros(CODE_POINTS, dtype=bool)
    in_use[points] = True
    letters = np.flatnonzero(in_use)
    place = np.zeros(CODE_POINTS, dtype=np.int64)
    place[letters] = np.arange(len(letters))
    return place[points], bounds, letters
