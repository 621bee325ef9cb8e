"""TF-IDF over word and character n-grams in long form.

Terms of a chunk of rows are counted at once, as numbers (``functions/runs``). The fit shuffles one row per term and chunk,
combined map-side, and its result is bounded by ``max_features``. The transform takes the fitted table to the texts: a text
becomes its arrays of indices and weights where it is, without a shuffle. A fit beyond ``BROADCAST_ROWS`` terms is joined
instead: texts are placed by ``row_id`` before they are cut into terms, and norms and vectors reuse that placement.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptsieve.functions import charcodes
from promptsieve.functions import runs as rr
from promptsieve.functions.ngrams import char_ngrams, counted, word_ngrams
from promptsieve.functions.text import WORD_CHARS, char_tokens, truncated, word_tokens
from promptsieve.operators.lookup import BROADCAST_ROWS, bounded
from promptsieve.operators.ranking import top_by_count
from promptsieve.session import materialized


@dataclass(frozen=True)
class TermSpec:
    """What counts as a term of a block, and which terms the fit keeps."""

    name: str
    unit: str  # "token", "char", or "long_word": runs of two or more word characters
    sizes: tuple[int, ...]
    min_df: int = 1
    max_features: int = 20_000
    sublinear: bool = True
    lowercase: bool = False
    max_chars: int | None = None
    stop_words: tuple[str, ...] = field(default=(), repr=False)

    @property
    def is_packed(self) -> bool:
        """Whether the terms are short enough to be counted as two numbers instead of strings."""
        return self.unit == "char" and max(self.sizes) <= charcodes.MAX_CHARS

    def prepared(self, text: Column) -> Column:
        text = truncated(text, self.max_chars)
        return F.lower(text) if self.lowercase else text

    def terms(self, text: Column) -> Column:
        text = self.prepared(text)
        if self.unit == "char":
            return char_ngrams(text, self.sizes)
        return word_ngrams(self.words(text), self.sizes)

    def words(self, prepared: Column) -> Column:
        if self.unit == "token":
            words = word_tokens(prepared)
        else:
            words = F.regexp_extract_all(prepared, F.lit(f"[{WORD_CHARS}]{{2,}}"), F.lit(0))
        return F.filter(words, lambda w: ~w.isin(*self.stop_words)) if self.stop_words else words


# The two feature blocks of the baseline classifier.
WORD_BLOCK = TermSpec("word", "token", (1, 2), min_df=2, max_features=20_000)
CHAR_BLOCK = TermSpec("char", "char", (3, 4, 5), min_df=3, max_features=30_000)
MAX_CHARS = 3_000  # the classifier's optional length limit
HELD = 1 << 20     # entries that are put in the order of terms at once
ENTRIES = 1 << 18  # entries of vectors that are made at once; more only for a single row that has more


def placed(texts: DataFrame) -> DataFrame:
    return texts.select("row_id", "text").repartition("row_id")


def term_counts(texts: DataFrame, *specs: TermSpec) -> DataFrame:
    """(row_id, block, term, k1, k2, tf), counted inside each row; a text without terms keeps one row with NULL tf.

    Packed terms are the numbers k1 and k2 and have no ``term``; other terms have their hash as k1.
    """

    def tagged(block: int, spec: TermSpec) -> Column:
        tag = F.lit(block).alias("block")
        return F.transform(counted(spec.terms(F.col("text"))),
                           lambda t: F.struct(tag, t["term"].alias("term"), F.xxhash64(t["term"]).alias("k1"),
                                              F.lit(0).cast("bigint").alias("k2"), t["tf"].alias("tf")))

    def packed(block: int, spec: TermSpec) -> Column:
        counts = charcodes.counted_runs(spec.prepared(F.col("text")), spec.sizes)
        return F.transform(counts, lambda t: F.struct(F.lit(block).alias("block"), F.lit(None).cast("string").alias("term"),
                                                      t["k1"].alias("k1"), t["k2"].alias("k2"), t["tf"].alias("tf")))

    counts = F.concat(*[(packed if s.is_packed else tagged)(b, s) for b, s in enumerate(specs)])
    return texts.select("row_id", F.explode_outer(counts).alias("_t")).select("row_id", "_t.*")


Symbols = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray | pa.Array]]


def _sent(spec: TermSpec, text: Column) -> Column:
    """What the tasks get of a text to count its terms: long runs of characters go as lists of these."""
    text = spec.prepared(text)
    return char_tokens(text) if spec.unit == "char" and not spec.is_packed else text


def _cutter(spec: TermSpec, spark: SparkSession) -> Callable[[], Symbols]:
    """Makes, inside a task, the function that cuts what was sent into symbols."""
    if spec.unit == "char":
        return lambda: rr.char_symbols if spec.is_packed else rr.word_symbols
    kinds = rr.kinds(spark)
    stop_words = pa.array(spec.stop_words, pa.string()) if spec.stop_words else None

    def make() -> Symbols:
        table = rr.kind_table(*kinds)
        return lambda texts: rr.token_symbols(texts, table, spec.unit == "long_word", stop_words)

    return make


def _joined(spec: TermSpec, parts: list[np.ndarray], names: pa.Array) -> pa.Array:
    joiner = "" if spec.unit == "char" else " "
    return pc.binary_join_element_wise(*[names.take(pa.array(p)) for p in parts], joiner) if len(parts) > 1 else names.take(
        pa.array(parts[0]))


def corpus_counts(texts: DataFrame, spec: TermSpec) -> DataFrame:
    """(term, or k1 and k2 for packed terms; df, ctf): rows that hold the term, and its occurrences. Counted chunk by chunk, so
    that a term is one row per chunk before Spark adds up the chunks."""
    keys = ["k1", "k2"] if spec.is_packed else ["term"]
    cutter = _cutter(spec, texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter()
        for batch in batches:
            column = batch.column(0)
            for first, end in rr.chunks(rr.sizes_of(column)):
                symbols, bounds, names = cut(column.slice(first, end - first))
                for _, codes, row, coder in rr.runs(symbols, bounds, max(1, len(names)), spec.sizes):
                    code, start, _, tf = rr.distinct(codes, row, end - first)
                    if not len(code):
                        continue
                    parts = coder.symbols(code)
                    terms = charcodes.numbers(names, parts) if spec.is_packed else [_joined(spec, parts, names)]
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(t) for t in terms], pa.array(np.diff(start)), pa.array(np.add.reduceat(tf, start[:-1]))],
                        names=[*keys, "df", "ctf"])

    types = "k1 bigint, k2 bigint" if spec.is_packed else "term string"
    return (texts.select(_sent(spec, F.col("text")).alias("_s")).mapInArrow(run, f"{types}, df bigint, ctf bigint")
            .groupBy(*keys).agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf")))


def fit_block(texts: DataFrame, spec: TermSpec) -> DataFrame:
    """(term, idx, df, idf): the most frequent terms, ties by term, indexed in term order.

    Packed terms are counted and ranked as numbers, which order like the terms; only those kept become strings.
    """
    n_docs = texts.agg(F.count("*")).scalar()
    keys = ["k1", "k2"] if spec.is_packed else ["term"]
    # stored: two jobs read it, the floor of the counts and the terms above it
    corpus = materialized(corpus_counts(texts, spec).where(F.col("df") >= spec.min_df), "counts")
    top = top_by_count(corpus, "ctf", spec.max_features, *keys)
    if spec.is_packed:
        top = top.withColumn("term", charcodes.unpacked(F.col("k1"), F.col("k2")))
    return top.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"), "df",
                      (F.log((n_docs + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def fit(texts: DataFrame, *specs: TermSpec) -> DataFrame:
    """Blocks side by side: (block, term, idx, df, idf), each block's indices after those of the one before."""
    table, offset = None, 0
    for block, spec in enumerate(specs):
        part = (fit_block(texts, spec).withColumn("block", F.lit(block))
                .withColumn("idx", (F.col("idx") + offset).cast("int")))
        table = part if table is None else table.unionByName(part)
        offset += spec.max_features
    return table


def dimension(*specs: TermSpec) -> int:
    return sum(s.max_features for s in specs)


def joined_weights(texts: DataFrame, fitted: DataFrame, *specs: TermSpec, is_placed: bool = False,
                   keep_unknown: bool = False) -> DataFrame:
    """``weights`` for fits that are too large for the tasks: terms are joined with a table of any size."""
    packed = [b for b, s in enumerate(specs) if s.is_packed]
    k1, k2 = F.xxhash64("term"), F.lit(0).cast("bigint")
    if packed:
        (p1, p2), is_packed = charcodes.packed(F.col("term")), F.col("block").isin(*packed)
        k1, k2 = F.when(is_packed, p1).otherwise(k1), F.when(is_packed, p2).otherwise(k2)
    known = bounded(fitted.select("block", F.col("term").alias("_known"), "idx", "df", "idf", k1.alias("k1"),
                                  k2.alias("k2")), dimension(*specs)).alias("known")
    tf = F.col("tf").cast("double")
    damped = F.log(tf) + 1
    sublinear = [s.sublinear for s in specs]
    if not all(sublinear):
        damped = F.when(F.col("block").isin(*[b for b, on in enumerate(sublinear) if on]), damped).otherwise(tf)
    counts = term_counts(texts if is_placed else placed(texts), *specs).alias("counts")
    same = ((F.col("counts.block") == F.col("known.block")) & (F.col("counts.k1") == F.col("known.k1"))
            & (F.col("counts.k2") == F.col("known.k2"))
            & (F.col("counts.term").isNull() | (F.col("counts.term") == F.col("_known"))))
    raw = (counts.join(known, same, "left" if keep_unknown else "inner")
           .select("row_id", "counts.block", F.coalesce("_known", "counts.term").alias("term"), "idx", "df", "idf", "tf")
           .withColumn("_raw", damped * F.col("idf")))
    # one long sort key for all blocks, which Spark sorts by radix
    length = F.coalesce(*[F.when(F.col("block") == b, F.sqrt(F.sum(
        F.when(F.col("block") == b, F.col("_raw") * F.col("_raw"))).over(Window.partitionBy("row_id"))))
        for b in range(len(specs))])
    return raw.select("row_id", "block", "term", "idx", "df", (F.col("_raw") / length).alias("weight"))


def is_bounded(*specs: TermSpec) -> bool:
    """Whether the fitted table may go to every task, by the specs' caps."""
    return dimension(*specs) <= BROADCAST_ROWS


def _known(fitted: pa.Table, specs: tuple[TermSpec, ...]) -> list[tuple]:
    """Per block its distinct symbols, and per run size the terms as places among them and their indices."""
    blocks = []
    for b, spec in enumerate(specs):
        part = fitted.filter(pc.equal(fitted["block"], b))
        terms, idx = part["term"].to_pylist(), part["idx"].to_numpy().astype(np.int64)
        split = [[ord(c) for c in t] if spec.is_packed else list(t) if spec.unit == "char" else t.split(" ") for t in terms]
        names = sorted({s for parts in split for s in parts})
        place = {s: i for i, s in enumerate(names)}
        sizes = {}
        for size in spec.sizes:
            at = [i for i, parts in enumerate(split) if len(parts) == size]
            if at:
                sizes[size] = np.array([[place[s] for s in split[i]] for i in at], dtype=np.int64), idx[at]
        blocks.append((np.array(names, dtype=np.int64) if spec.is_packed else pa.array(names, pa.string()), sizes))
    return blocks


def _entries(column: pa.Array, spec: TermSpec, known: tuple, cut: Symbols) -> tuple[np.ndarray, ...]:
    """(row, idx, tf) of the known terms in a chunk."""
    wanted, by_size = known
    symbols, bounds, names = cut(column)
    if spec.is_packed:
        at = np.searchsorted(names, wanted)
        local = np.where(np.append(names, -1)[at] == wanted, at, -1)
    else:
        local = pc.fill_null(pc.index_in(wanted, value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    found = [[np.zeros(0, dtype=np.int64)] * 3]
    for size, codes, row, coder in rr.runs(symbols, bounds, max(1, len(names)), spec.sizes):
        if size not in by_size or not len(codes):
            continue
        terms, idx = by_size[size]
        term_codes = coder.codes(local[terms])
        order = np.argsort(term_codes)
        order = order[term_codes[order] >= 0]
        code, start, rows, tf = rr.distinct(codes, row, len(column))
        at = np.searchsorted(code, term_codes[order])
        held = np.append(code, -1)[at] == term_codes[order]
        at, idx = at[held], idx[order][held]
        n = start[at + 1] - start[at]
        entry = np.repeat(start[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else at
        found.append([rows[entry], np.repeat(idx, n), tf[entry]])
    return tuple(np.concatenate(columns) for columns in zip(*found))


def _scaled(row: np.ndarray, idx: np.ndarray, tf: np.ndarray, n_rows: int, idf: np.ndarray, block: np.ndarray,
            sublinear: np.ndarray) -> np.ndarray:
    """Weights of entries, each block of a row scaled to length 1."""
    raw = np.where(sublinear[block[idx]], np.log(tf) + 1, tf) * idf[idx]
    cell = row * len(sublinear) + block[idx]
    return raw / np.sqrt(np.bincount(cell, raw * raw, n_rows * len(sublinear)))[cell] if len(row) else raw


def _by_index(fitted: pa.Table, specs: tuple[TermSpec, ...]) -> tuple[np.ndarray, ...]:
    """idf and block by index, and which blocks are sublinear."""
    idf, block = np.zeros(dimension(*specs)), np.zeros(dimension(*specs), dtype=np.int64)
    at = fitted["idx"].to_numpy()
    idf[at], block[at] = fitted["idf"].to_numpy(), fitted["block"].to_numpy()
    return idf, block, np.array([s.sublinear for s in specs])


def _lists(bounds: np.ndarray, values: np.ndarray | pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values) if isinstance(values, np.ndarray) else values)


def _chunk_entries(texts: DataFrame, table: pa.Table, specs: tuple[TermSpec, ...]) -> tuple[list[Column], Callable]:
    """The columns to send, and what makes (batch, first row, rows, row, idx, tf) of each chunk of the batches that hold them."""
    known, cutters = _known(table, specs), [_cutter(s, texts.sparkSession) for s in specs]
    ways = [(s.unit == "char" and not s.is_packed, s.max_chars, s.lowercase) for s in specs]
    same = [ways.index(way) for way in ways]    # blocks that cut the same text are sent it once

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        cuts = [make() for make in cutters]
        for batch in batches:
            columns = [batch.column(f"_s{b}") for b in same]
            for first, end in rr.chunks(np.max([rr.sizes_of(c) for c in columns], axis=0)):
                parts = [_entries(c.slice(first, end - first), *how) for c, *how in zip(columns, specs, known, cuts)]
                yield batch, first, end - first, *(np.concatenate(p) for p in zip(*parts))

    return [_sent(specs[b], F.col("text")).alias(f"_s{b}") for b in sorted(set(same))], entries


def sparse(texts: DataFrame, fitted: DataFrame, *specs: TermSpec, carry: tuple[str, ...] = (), lookup: tuple[str, ...] = (),
           counted: bool = False, digits: int | None = None, as_vectors: bool = False) -> DataFrame:
    """(row_id, carried columns, indices, values): one row per text, indices ascending; a text without known terms has empty
    arrays. Nothing is shuffled. The fitted table, which ``is_bounded``, goes to the tasks.

    ``lookup`` names columns of ``fitted`` that come as arrays beside the indices. With ``counted`` there are counts instead
    of values, for ``scaled_vectors``; they are much smaller when stored. ``digits`` rounds the values, halves up. With
    ``as_vectors`` there are ML vectors, ``features``, instead of indices and values.
    """
    table = fitted.select("block", "term", "idx", "idf", *[c for c in lookup if c != "term"]).toArrow().sort_by("idx")
    by_index, (sent, entries) = _by_index(table, specs), _chunk_entries(texts, table, specs)
    place = np.zeros(dimension(*specs), dtype=np.int64)
    place[table["idx"].to_numpy()] = np.arange(len(table))
    looked_up = [table[c].combine_chunks() for c in lookup]
    kept = ["row_id", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, n, row, idx, tf in entries(batches):
            order = np.argsort(row * dimension(*specs) + idx)
            row, idx, tf = row[order], idx[order], tf[order]
            bounds = np.searchsorted(row, np.arange(n + 1))
            numbers = tf.astype(np.int32) if counted else _scaled(row, idx, tf, n, *by_index)
            if digits is not None:
                numbers = np.floor(numbers * 10.0 ** digits + 0.5) / 10.0 ** digits
            if as_vectors:
                made = _vector_array(dimension(*specs), _lists(bounds, idx.astype(np.int32)), _lists(bounds, numbers))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(first, n) for c in kept], made],
                                                 names=[*kept, "features"])
                continue
            beside = [c.take(pa.array(place[idx])) for c in looked_up]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).slice(first, n) for c in kept], _lists(bounds, idx.astype(np.int32)),
                 _lists(bounds, numbers), *[_lists(bounds, b) for b in beside]],
                names=[*kept, "indices", "counts" if counted else "values", *lookup])

    prepared = texts.select(*kept, *sent)
    if as_vectors:
        return prepared.mapInArrow(run, T.StructType([*[texts.schema[c] for c in kept], T.StructField("features", VectorUDT())]))
    types = fitted.schema
    schema = T.StructType([texts.schema[c] for c in kept] + [T.StructField("indices", T.ArrayType(T.IntegerType()))]
                          + [T.StructField("counts", T.ArrayType(T.IntegerType())) if counted
                             else T.StructField("values", T.ArrayType(T.DoubleType()))]
                          + [T.StructField(c, T.ArrayType(types[c].dataType)) for c in lookup])
    return prepared.mapInArrow(run, schema)


def postings(texts: DataFrame, fitted: DataFrame, *specs: TermSpec) -> DataFrame:
    """(idx, row_ids, values): the rows that hold a term and its weights in them, about ``HELD`` entries at a time. Rows made of
    them repeat a term instead of a row's terms, which takes a lookup per posting and little space where they are stored."""
    table = fitted.select("block", "term", "idx", "idf").toArrow()
    by_index, (sent, entries) = _by_index(table, specs), _chunk_entries(texts, table, specs)

    def batch_of(held: list) -> pa.RecordBatch:
        ids, idx, values = pa.concat_arrays([h[0] for h in held]), *(np.concatenate(c) for c in list(zip(*held))[1:])
        order = np.argsort(idx, kind="stable")
        idx = idx[order]
        start = np.concatenate(([0], np.flatnonzero(np.diff(idx)) + 1))
        bounds = np.append(start, len(idx))
        return pa.RecordBatch.from_arrays([pa.array(idx[start].astype(np.int32)), _lists(bounds, ids.take(pa.array(order))),
                                           _lists(bounds, values[order])], names=["idx", "row_ids", "values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, first, n, row, idx, tf in entries(batches):
            if not len(row):
                continue
            order = np.argsort(idx * n + row)
            row, idx, tf = row[order], idx[order], tf[order]
            held.append((batch.column("row_id").take(pa.array(row + first)), idx, _scaled(row, idx, tf, n, *by_index)))
            size += len(row)
            if size >= HELD:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    return texts.select("row_id", *sent).mapInArrow(run, T.StructType([
        T.StructField("idx", T.IntegerType()), T.StructField("row_ids", T.ArrayType(texts.schema["row_id"].dataType)),
        T.StructField("values", T.ArrayType(T.DoubleType()))]))


def weights(texts: DataFrame, fitted: DataFrame, *specs: TermSpec, is_placed: bool = False,
            keep_unknown: bool = False) -> DataFrame:
    """(row_id, block, term, idx, df, weight), each block of a row scaled to length 1.

    Terms outside the fit are dropped; with ``keep_unknown`` a text without known terms keeps a row with NULL ``idx``, so
    that no row can vanish.
    """
    if not is_bounded(*specs):
        return joined_weights(texts, fitted, *specs, is_placed=is_placed, keep_unknown=keep_unknown)
    table = fitted.select("block", "term", "idx", "df", "idf").toArrow()
    fitted = texts.sparkSession.createDataFrame(table)     # read once, used twice
    named = F.broadcast(fitted.select("idx", "block", "term", "df"))    # bounded by the specs
    if keep_unknown:
        entries = (sparse(texts, fitted, *specs)
                   .select("row_id", F.inline_outer(F.arrays_zip("indices", "values")).alias("idx", "weight"))
                   .join(named, "idx", "left"))
    else:
        entries = postings(texts, fitted, *specs).join(named, "idx").select(
            "idx", "block", "term", "df", F.inline(F.arrays_zip("row_ids", "values")).alias("row_id", "weight"))
    return entries.select("row_id", "block", "term", "idx", "df", "weight")


def sparse_rows(weighted: DataFrame) -> DataFrame:
    """(row_id, indices, values), one row per text, indices ascending. Give it weights with ``keep_unknown``: a text
    without known terms then has empty arrays instead of no row."""
    pairs = F.sort_array(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("idx", "weight"))))
    return (weighted.groupBy("row_id").agg(pairs.alias("_p"))
            .select("row_id", F.transform("_p", lambda p: p["idx"]).alias("indices"),
                    F.transform("_p", lambda p: p["weight"]).alias("values")))


def _vector_array(size: int, indices: pa.Array, values: pa.Array) -> pa.Array:
    n = len(indices)
    return pa.StructArray.from_arrays(
        [pa.repeat(pa.scalar(0, pa.int8()), n), pa.repeat(pa.scalar(size, pa.int32()), n),
         indices.cast(pa.list_(pa.int32())), values], names=["type", "size", "indices", "values"])


def _with_vectors(rows: DataFrame, make: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """The arrays of ``rows`` replaced by ML vectors, ``ENTRIES`` at a time."""
    kept = [f for f in rows.schema if f.name not in ("indices", "values", "counts")]
    names = [f.name for f in kept]

    def relabel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in rr.chunks(rr.sizes_of(batch.column("indices")), ENTRIES):
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], make(part)], names=[*names, "features"])

    return rows.mapInArrow(relabel, T.StructType([*kept, T.StructField("features", VectorUDT())]))


def vectors(weighted: DataFrame, size: int) -> DataFrame:
    """(row_id, other columns, features) of ``sparse``, or (row_id, features) of ``weights``."""
    rows = weighted if "indices" in weighted.columns else sparse_rows(weighted)
    return _with_vectors(rows, lambda batch: _vector_array(size, batch.column("indices"), batch.column("values")))


def scaled_vectors(counts: DataFrame, fitted: DataFrame, *specs: TermSpec) -> DataFrame:
    """(row_id, other columns, features) of ``sparse`` with ``counted``."""
    size, by_index = dimension(*specs), _by_index(fitted.select("block", "idx", "idf").toArrow(), specs)

    def make(batch: pa.RecordBatch) -> pa.Array:
        indices, tf = batch.column("indices"), batch.column("counts").flatten().to_numpy(zero_copy_only=False)
        bounds = np.concatenate(([0], np.cumsum(rr.sizes_of(indices))))
        row = np.repeat(np.arange(len(indices)), np.diff(bounds))
        idx = indices.flatten().to_numpy(zero_copy_only=False)
        return _vector_array(size, indices, _lists(bounds, _scaled(row, idx, tf, len(indices), *by_index)))

    return _with_vectors(counts, make)
