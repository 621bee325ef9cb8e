"""What the operators share: lineage cuts, size-checked joins, and word hashes over Arrow text buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsieve.session import materialized, shared_dir

SPACE = r"\x20\x09-\x0D"        # what separates words
BROADCAST_ROWS = 100_000        # rows of a few numbers each up to which a join side is broadcast
CHUNK_BYTES = 4 << 20           # text that is hashed at once; a longer text goes alone

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_KEEP = [np.uint64((1 << (8 * k)) - 1) for k in range(8)] + [np.uint64(0xFFFFFFFFFFFFFFFF)]
_MASKS = np.array(_KEEP, dtype=np.uint64)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def cut(df: DataFrame) -> DataFrame:
    """Compute once and store in the folder of ``spark.checkpoint.dir``, which outlives executors."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as Parquet. Rounds that join their own results need this: a checkpoint keeps its plan's estimated size,
    estimates multiply at every join, and after some rounds the numbers take longer than the work."""
    return materialized(df, "stored")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, stored by ``cut``, to be broadcast if it has at most ``rows`` rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_side(docs: DataFrame, side: DataFrame, how: str, *on: Column) -> DataFrame:
    """``docs`` joined with ``side`` (doc_id, text_hash, ...), which names rows by their ids and texts, as rows may share an
    id. The frames are aliased ``docs`` and ``side``, so columns of any name may be in ``docs``."""
    same = F.col("docs.doc_id").eqNullSafe(F.col("side.doc_id")) & (F.xxhash64(F.col("docs.text")) == F.col("side.text_hash"))
    for more in on:
        same &= more
    return docs.alias("docs").join(side.alias("side"), same, how)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * _C2
    h = (h ^ (h >> np.uint64(32))) * _C2
    return h ^ (h >> np.uint64(32))


def chunks(text: pa.Array, size: int = CHUNK_BYTES):
    """(first row, end row, bytes, offsets) over pieces of a string array; a piece exceeds ``size`` only as one row."""
    wide = pa.types.is_large_string(text.type)
    n = len(text)
    ends = np.frombuffer(text.buffers()[1], dtype=np.int64 if wide else np.int32)[text.offset:text.offset + n + 1]
    ends = ends.astype(np.int64)
    if text.buffers()[2] is None or not n:
        data = np.zeros(0, dtype=np.uint8)
        ends = np.zeros(n + 1, dtype=np.int64)
    else:
        data = np.frombuffer(text.buffers()[2], dtype=np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(ends, ends[first] + size, side="right")) - 1)
        yield first, end, data[ends[first]:ends[end]], ends[first:end + 1] - ends[first]
        first = end


def word_spans(data: np.ndarray, ends: np.ndarray, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, ...]:
    """(starts, stops, bounds): byte spans of the words; text k has words bounds[k] to bounds[k + 1]."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    np.take(is_word, data, out=inside[:-1])
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside[:-1]
    before[ends[:-1]] = False   # a text's first byte follows nothing
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside[1:]
    at = ends[1:] - 1
    after[at[at >= 0]] = False
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.searchsorted(starts, ends)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return np.take(_LOWER, data)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of every span, read eight bytes at a time; A-Z count as lower case."""
    lower = np.zeros(len(data) + 8, dtype=np.uint8)
    np.take(_LOWER, data, out=lower[:-8])
    windows = np.ndarray(len(data) + 1, dtype=np.uint64, buffer=lower, strides=(1,))
    length = stops - starts
    h = mixed(length.astype(np.uint64) * _C1 ^ (windows[starts] & _MASKS[np.minimum(length, 8)]))
    rest, done = np.flatnonzero(length > 8), 8
    while len(rest):
        left = np.minimum(length[rest] - done, 8)
        h[rest] = mixed(h[rest] * _C1 ^ (windows[starts[rest] + done] & _MASKS[left]))
        done += 8
        rest = rest[length[rest] > done]
    return h
