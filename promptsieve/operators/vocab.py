"""Vocabulary by frequency, and fixed-length encoding with it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptsieve.functions import runs as rr
from promptsieve.functions.text import tokens
from promptsieve.operators.lookup import BROADCAST_ROWS
from promptsieve.operators.ranking import top_by_count
from promptsieve.session import materialized

# Reserved tokens, sizes and frequency floors.
PAD, UNK = "<pad>", "<unk>"
PAD_ID, UNK_ID = 0, 1
MAX_SIZE = {"word": 20_000, "char": 5_000}
MIN_FREQ = {"word": 2, "char": 1}
MAX_LEN = 200
PREFIX = 8      # characters per kept token that are cut first; the whole text only if they hold too few tokens


def _cutter(level: str, spark: SparkSession) -> Callable[[], Callable[[pa.Array], tuple[np.ndarray, np.ndarray, pa.Array]]]:
    """Makes, inside a task, the function that cuts texts into (symbols, bounds, tokens)."""
    if level not in MAX_SIZE:
        raise ValueError(f"unknown token level {level!r}")
    kinds = rr.kinds(spark) if level == "word" else None

    def make():
        table = rr.kind_table(*kinds) if kinds else None

        def cut(texts):
            if table is not None:
                return rr.token_symbols(texts, table)
            symbols, bounds, letters = rr.char_symbols(texts)
            return symbols, bounds, pa.array([chr(c) for c in letters], pa.string())

        return cut

    return make


def _sent(text: Column, lowercase: bool) -> Column:
    return (F.lower(text) if lowercase else text).cast("string")


def token_counts(texts: DataFrame, level: str = "word", lowercase: bool = False) -> DataFrame:
    """(token, n, first): frequency and first position in (row, position) order.

    Tokens are counted chunk by chunk, so that one is a row per chunk before Spark adds up the chunks. The position is one
    decimal, not a struct, so that stays a hash aggregate with map-side combine.
    """
    cutter, unplaced = _cutter(level, texts.sparkSession), np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter()
        for batch in batches:
            for start, end in rr.chunks(rr.sizes_of(batch.column(1))):
                ids, column = batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start)
                symbols, bounds, tokens = cut(column)
                if not len(symbols):
                    continue
                known, rank = np.unique(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), return_inverse=True)
                row = np.repeat(np.arange(len(column)), np.diff(bounds))
                places = len(symbols) + 1
                at = rank[row] * places + np.arange(len(symbols)) - bounds[row]
                if ids.null_count:
                    at[ids.is_null().to_numpy(zero_copy_only=False)[row]] = unplaced
                first = np.full(len(tokens), unplaced)
                np.minimum.at(first, symbols, at)
                n = np.bincount(symbols, minlength=len(tokens))
                nowhere = first == unplaced
                first[nowhere] = 0
                yield pa.RecordBatch.from_arrays(
                    [tokens.filter(pa.array(n > 0)), pa.array(n[n > 0]), pa.array(known[first // places][n > 0], mask=nowhere[n > 0]),
                     pa.array((first % places)[n > 0].astype(np.int32))], names=["token", "n", "_id", "_pos"])

    counts = texts.select(F.col("row_id").cast("bigint"), _sent(F.col("text"), lowercase).alias("_s")).mapInArrow(
        run, "token string, n bigint, _id bigint, _pos int")
    start = F.col("_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)")
    return counts.groupBy("token").agg(F.sum("n").alias("n"), F.min(start + F.col("_pos")).alias("first"))


def build_vocab(texts: DataFrame, level: str = "word", max_size: int | None = None, min_freq: int | None = None,
                lowercase: bool = False) -> DataFrame:
    """(token, id, n): reserved tokens, then the most frequent ones, ties by first occurrence."""
    max_size = MAX_SIZE[level] if max_size is None else max_size
    min_freq = MIN_FREQ[level] if min_freq is None else min_freq
    # stored: two jobs read it, the floor of the counts and the tokens above it
    frequent = materialized(token_counts(texts, level, lowercase).where(F.col("n") >= min_freq), "tokens")
    top = top_by_count(frequent, "n", max_size - 2, "first")
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "first"))  # over at most max_size rows
    reserved = texts.sparkSession.sql(
        f"SELECT * FROM VALUES ('{PAD}', {PAD_ID}, 0L), ('{UNK}', {UNK_ID}, 0L) AS t(token, id, n)")
    return reserved.unionByName(top.select("token", (rank + 1).cast("int").alias("id"), "n"))


def encode(texts: DataFrame, vocab: DataFrame, max_len: int = MAX_LEN, level: str = "word", lowercase: bool = False,
           max_size: int | None = None) -> DataFrame:
    """(row_id, ids): token ids cut to ``max_len`` and padded on the right; unknown tokens become ``<unk>``. One row per text.

    The vocabulary goes to the tasks and no row is moved, unless its declared size is beyond ``BROADCAST_ROWS``; then it is
    joined. Of a long text only as much is cut as has more than ``max_len`` tokens.
    """
    if (max_size or MAX_SIZE[level]) > BROADCAST_ROWS:
        return _joined_encode(texts, vocab, max_len, level, lowercase)
    table = vocab.select("token", "id").toArrow()
    words, numbers = table["token"].combine_chunks(), table["id"].combine_chunks()
    cutter, whole = _cutter(level, texts.sparkSession), numbers.type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = cutter(), np.append(numbers.to_numpy(zero_copy_only=False), UNK_ID)

        def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            """One row of ids per text, and the number of its tokens."""
            symbols, bounds, tokens = cut(column)
            sizes = np.diff(bounds)
            place = pc.fill_null(pc.index_in(tokens, value_set=words), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(column)), sizes)
            at = np.arange(len(symbols)) - bounds[row]
            held = at < max_len
            ids = np.full((len(column), max_len), PAD_ID, dtype=known.dtype)
            ids[row[held], at[held]] = known[place[symbols[held]]]
            return ids, sizes

        for batch in batches:
            for first, end in rr.chunks(rr.sizes_of(batch.column(1))):
                column = batch.column(1).slice(first, end - first)
                head = pc.utf8_slice_codeunits(column, 0, PREFIX * max_len)
                ids, sizes = ids_of(head)
                # the last token of a head may go on behind it, so a head needs one more than are kept
                short = np.flatnonzero((sizes <= max_len) & (rr.sizes_of(column) > rr.sizes_of(head)))
                if len(short):
                    ids[short] = ids_of(column.take(pa.array(short)))[0]
                bounds = pa.array(np.arange(end - first + 1) * max_len, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.ListArray.from_arrays(bounds, pa.array(ids.ravel(), whole))],
                    names=["row_id", "ids"])

    schema = T.StructType([texts.schema["row_id"], T.StructField("ids", T.ArrayType(vocab.schema["id"].dataType))])
    return texts.select("row_id", _sent(F.col("text"), lowercase).alias("_s")).mapInArrow(run, schema)


def _joined_encode(texts: DataFrame, vocab: DataFrame, max_len: int, level: str, lowercase: bool) -> DataFrame:
    """``encode`` with a vocabulary of any size. Rows are placed by ``row_id`` once, while they are still one row per text; the
    regrouping reuses that placement."""
    known = vocab.select("token", "id")
    cut = (texts.select("row_id", F.slice(tokens(F.col("text"), level, lowercase), 1, max_len).alias("_tokens"))
           .repartition("row_id"))
    looked_up = (cut.select("row_id", F.posexplode_outer("_tokens").alias("_pos", "token"))
                 .join(known, "token", "left")
                 .select("row_id", "_pos", F.when(F.col("_pos").isNotNull(), F.coalesce("id", F.lit(UNK_ID)))
                         .alias("_id")))
    in_order = F.sort_array(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", "_id"))))
    return (looked_up.groupBy("row_id").agg(in_order.alias("_pairs"))
            .select("row_id", F.transform("_pairs", lambda p: p["_id"]).alias("_ids"))
            .select("row_id", F.concat("_ids", F.array_repeat(F.lit(PAD_ID), F.lit(max_len) - F.size("_ids")))
                    .alias("ids")))
