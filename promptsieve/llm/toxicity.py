"""Toxicity by class-conditional Kneser-Ney models.

Two models of words as byte sequences, one of toxic and one of ordinary documents, give each word a log-likelihood ratio. A
model predicts a byte from the seven before it in the word. Its counts are discounted and backed off to counts that both
classes share: first the pooled counts of the same context, with PRIOR pseudo-counts, and from there by Kneser-Ney
continuation counts of shorter contexts. A word that one class never saw thus scores by the pooled model unless its
beginning tells the classes apart.

A word's ratio counts beyond DEAD_ZONE only: that keeps the chance differences of thousands of ordinary words out of a long
text's sum. A document's sum, and its sum per word (the length-normalised ratio), go through a logistic curve.

Counts cover every labelled training row and so grow with the input. Contexts are eight bytes, one BIGINT with the next
byte, so counting, backing off and comparing are integer aggregations and joins. Ratios are made from all counts. The tasks
hold those of the MAX_ENTRIES most frequent contexts at most; words that need others are collected, each distinct one is
scored once by joins with the other ratios, and its value is added to the sums of the documents that hold it. A fifth of the
training rows, and of many rows about CALIBRATION_ROWS, is kept from the counts and fits the curve's three weights.

Edge cases: null and empty texts have no words and score the curve's intercept; a null id is never held out; a document with
several labels counts as toxic if one says so; null labels are no labels; without both classes in the training rows
every score is the toxic share (0 without any label); an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsieve.llm.common import SPACE, chunks, cut, small, word_hashes, word_spans

CONTEXTS = (7, 3, 1, 0)     # bytes of context from the longest to none
DISCOUNT = 0.75
PRIOR = 50.0
DEAD_ZONE = 2.0
MAX_ENTRIES = 4_000_000
CALIBRATION_ROWS = 20_000
CUT_SCORE = 0.7
WORD_ROWS = 2_000_000       # words beyond the table up to which their values are broadcast: a hash and a number each
LABEL_ROWS = 2_000_000      # training labels up to which they are broadcast: an id and two bits each
PIECE_BYTES = 1 << 19       # of words or text whose keys a task holds at once
_BYTES = np.uint64(8)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0))


def byte_keys(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, word): for every byte of the spans and the end of each, the seven bytes before it in its span and itself in
    one number, earliest highest; zeros stand before a span's start."""
    size = stops - starts + 1
    word = np.repeat(np.arange(len(starts), dtype=np.int32), size)
    ends = np.cumsum(size)
    at = np.arange(len(word)) - np.repeat(ends - size, size)
    lowered = np.full(len(data) + 1, 32, dtype=np.uint8)
    lowered[:-1] = np.where((data >= 65) & (data <= 90), data + 32, data)
    place = np.repeat(starts, size) + at
    keys = lowered[place].astype(np.uint64)
    keys[ends - 1] = 32
    for back in range(1, 8):
        inside = np.flatnonzero(at >= back)
        keys[inside] |= lowered[place[inside] - back].astype(np.uint64) << np.uint64(8 * back)
    return keys, word


def word_counts(train: DataFrame) -> DataFrame:
    """(word, toxic, ordinary) counts over the rows of ``train``."""
    words = F.explode(F.array_remove(F.split("text", f"[{SPACE}]+"), ""))
    return train.select(words.alias("word"), "toxic").groupBy("word").agg(
        F.sum("toxic").cast("bigint").alias("toxic"), F.sum(1 - F.col("toxic")).cast("bigint").alias("ordinary"))


def gram_counts(counts: DataFrame) -> DataFrame:
    """(key, t, o): counts of each context with its next byte in either class."""
    def run(batches):
        for batch in batches:
            t, o = batch.column("toxic").to_numpy(), batch.column("ordinary").to_numpy()
            for first, _, data, ends in chunks(batch.column("word"), PIECE_BYTES):
                filled = np.flatnonzero(np.diff(ends))
                keys, word = byte_keys(data, ends[:-1][filled], ends[1:][filled])
                word = filled[word] + first
                unique, inverse = np.unique(keys, return_inverse=True)
                sums = [np.bincount(inverse, weights=x[word], minlength=len(unique)).astype(np.int64) for x in (t, o)]
                for a in range(0, len(unique), 100_000):
                    b = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(unique[b].view(np.int64)), *[pa.array(s[b]) for s in sums]],
                                                     names=["key", "t", "o"])
    return counts.mapInArrow(run, "key bigint, t bigint, o bigint").groupBy("key").agg(
        F.sum("t").alias("t"), F.sum("o").alias("o"))


def divided(table: DataFrame, limit: int = MAX_ENTRIES) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent rows of ``ratios``, ``limit`` at most, and the others: cut at the least power of two of pooled
    counts that does it. Without others, None."""
    step = F.floor(F.log2("n"))
    sizes = {r[0]: r[1] for r in table.groupBy(step.alias("step")).count().collect()}   # at most 64 rows
    least = max(sizes, default=0) + 1
    total = 0
    for s in sorted(sizes, reverse=True):
        total += sizes[s]
        if total > limit:
            break
        least = s
    return table.where(step >= least), table.where(step < least) if len(sizes) and least > min(sizes) else None


def ratios(grams: DataFrame) -> DataFrame:
    """(key, ratio, rest, n): log of toxic over ordinary likelihood of the key's byte after its context, and of any byte
    that never followed that context; ``n`` is the pooled count."""
    masks = {m: (1 << (8 * (m + 1))) - 1 for m in CONTEXTS[1:]}
    levels = [grams.withColumn("n", F.col("t") + F.col("o"))]
    for m in CONTEXTS[1:]:      # continuation counts: distinct longer contexts
        longer = levels[-1].select(F.col("key").bitwiseAND(F.lit(masks[m])).alias("key"))
        levels.append(longer.groupBy("key").agg(F.count("*").alias("n")))
    lower = None
    for level, m in zip(levels[::-1], CONTEXTS[::-1]):
        w = Window.partitionBy("_h")
        level = level.withColumn("_h", F.shiftrightunsigned("key", 8))
        level = level.withColumns({"_total": F.sum("n").over(w), "_types": F.count("*").over(w)})
        if lower is None:
            back = F.lit(1.0 / 257)
        else:
            level = level.withColumn("_low", F.col("key").bitwiseAND(F.lit(masks[lower[1]]))).join(
                lower[0].select(F.col("key").alias("_low"), F.col("p").alias("_p")), "_low")
            back = F.col("_p")
        p = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("_types") * back) / F.col("_total")
        lower = level.withColumn("p", p), m
    w = Window.partitionBy("_h")
    top = lower[0]
    for c in "to":
        top = top.withColumns({f"_{c}n": F.sum(c).over(w), f"_{c}k": F.sum(F.col(c).cast("boolean").cast("int")).over(w)})
    mass = {c: PRIOR + DISCOUNT * F.col(f"_{c}k") for c in "to"}
    likely = {c: (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + mass[c] * F.col("p")) / (F.col(f"_{c}n") + PRIOR)
              for c in "to"}
    rest = F.log(mass["t"] / (F.col("_tn") + PRIOR)) - F.log(mass["o"] / (F.col("_on") + PRIOR))
    return top.select("key", (F.log(likely["t"]) - F.log(likely["o"])).cast("float").alias("ratio"),
                      rest.cast("float").alias("rest"), (F.col("t") + F.col("o")).alias("n"))


class Model:
    """The ratio table as sorted arrays: by key, and by context."""

    def __init__(self, keys: np.ndarray, ratio: np.ndarray, contexts: np.ndarray, rest: np.ndarray):
        self.keys, self.ratio, self.contexts, self.rest = keys, ratio, contexts, rest

    @staticmethod
    def arrays(table: pa.Table) -> tuple[np.ndarray, ...]:
        """Of the rows of ``ratios``."""
        keys = table.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        contexts, first = np.unique(keys >> _BYTES, return_index=True)
        return keys, table.column("ratio").to_numpy()[order], contexts, table.column("rest").to_numpy()[order][first]

    @staticmethod
    def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(table, wanted)
        at[at == len(table)] = 0
        return at, table[at] == wanted if len(table) else np.zeros(len(wanted), dtype=bool)

    def key_values(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
        """(keys, word, value, seen): of every byte of the spans; ``value`` of a key that isn't ``seen`` in the table is that
        of its context, NaN if that isn't in the table either."""
        keys, word = byte_keys(data, starts, stops)
        value = np.full(len(keys), np.nan, dtype=np.float32)
        if not len(self.keys):
            return keys, word, value, np.zeros(len(keys), dtype=bool)
        at, seen = self._find(self.keys, keys)
        value[seen] = self.ratio[at[seen]]
        new = np.flatnonzero(~seen)
        at, known = self._find(self.contexts, keys[new] >> _BYTES)
        value[new[known]] = self.rest[at[known]]
        return keys, word, value, seen

    def word_ratios(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per span, the sum over its bytes beyond the dead zone, and whether all of them are in the table."""
        if not len(starts):
            return np.zeros(0), np.zeros(0, dtype=bool)
        _, word, value, seen = self.key_values(data, starts, stops)
        total = np.bincount(word, weights=np.nan_to_num(value), minlength=len(starts))
        whole = np.bincount(word[~seen], minlength=len(starts)) == 0
        return np.sign(total) * np.maximum(np.abs(total) - DEAD_ZONE, 0), whole

    def sums(self, data: np.ndarray, ends: np.ndarray, is_whole: bool = True) -> tuple[np.ndarray, ...]:
        """(words, ratio sum, open, n_open) per text; a word that repeats in the piece is looked up once. Unless the table
        ``is_whole``, words with a byte beyond it don't count: ``open`` lists their hashes, text after text."""
        starts, stops, bounds = word_spans(data, ends)
        n = np.diff(bounds)
        none = np.zeros(0, dtype=np.uint64)
        if not len(starts):
            return n, np.zeros(len(n)), none, np.zeros(len(n), dtype=np.int64)
        h, first, inverse = np.unique(word_hashes(data, starts, stops), return_index=True, return_inverse=True)
        each, whole = self.word_ratios(data, starts[first], stops[first])
        opened = none if is_whole else np.flatnonzero(~whole[inverse])
        each = (each if is_whole else np.where(whole, each, 0.0))[inverse]
        total = np.concatenate([[0.0], np.cumsum(np.rint(each * 4096))])    # whole numbers: sums don't depend on pieces
        n_open = np.diff(np.searchsorted(opened, bounds))
        return n, (total[bounds[1:]] - total[bounds[:-1]]) / 4096, none if is_whole else h[inverse[opened]], n_open


def summed(docs: DataFrame, shared, *carried: str) -> DataFrame:
    """``docs``' carried columns with (n_words, total)."""
    def run(batches):
        model = Model(*shared.value)
        for batch in batches:
            for first, end, data, ends in chunks(batch.column("text"), 2 * PIECE_BYTES):
                n, total, _, _ = model.sums(data, ends)
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[first:end] for c in carried], pa.array(n),
                                                  pa.array(total)], names=[*carried, "n_words", "total"])
    kinds = ", ".join(f"{c} bigint" for c in carried)
    return docs.select(*[F.col(c).cast("bigint") for c in carried], "text").mapInArrow(
        run, f"{kinds}, n_words bigint, total double")


def _open_words(docs: DataFrame, shared) -> DataFrame:
    """(h, key, value): of each distinct word with a byte beyond the table, its keys beyond it with their context's value,
    null if that is beyond it too, and with a null key the sum of the others."""
    def words(batches):
        model = Model(*shared.value)
        for batch in batches:
            for _, _, data, ends in chunks(batch.column("text"), 2 * PIECE_BYTES):
                starts, stops, _ = word_spans(data, ends)
                h, first = np.unique(word_hashes(data, starts, stops), return_index=True)
                whole = model.word_ratios(data, starts[first], stops[first])[1]
                h, first = h[~whole], first[~whole]
                texts = [data[a:b].tobytes() for a, b in zip(starts[first].tolist(), stops[first].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(texts, pa.binary())], names=["h", "word"])

    def keys(batches):
        model = Model(*shared.value)
        for batch in batches:
            h = batch.column("h").to_numpy()
            for first, _, data, ends in chunks(batch.column("word").view(pa.string()), PIECE_BYTES):
                key, word, value, seen = model.key_values(data, ends[:-1], ends[1:])
                known = np.bincount(word[seen], weights=value[seen], minlength=len(ends) - 1)
                late = np.flatnonzero(~seen)
                mine, value = h[first:first + len(known)], value[late].astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([mine, mine[word[late]]])),
                     pa.array(np.concatenate([np.zeros(len(known), np.int64), key[late].view(np.int64)]),
                              mask=np.arange(len(known) + len(late)) < len(known)),
                     pa.array(np.concatenate([known, value]), from_pandas=True)], names=["h", "key", "value"])
    distinct = docs.select("text").mapInArrow(words, "h bigint, word binary").groupBy("h").agg(
        F.min("word").alias("word"))
    return distinct.mapInArrow(keys, "h bigint, key bigint, value double")


def summed_beyond(docs: DataFrame, shared, others: DataFrame, *carried: str) -> DataFrame:
    """``summed`` where the ratios that aren't ``shared`` are the rows of ``others``."""
    def run(batches):
        model = Model(*shared.value)
        for batch in batches:
            for first, end, data, ends in chunks(batch.column("text"), 2 * PIECE_BYTES):
                n, total, h, n_open = model.sums(data, ends, is_whole=False)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_open)]).astype(np.int32)),
                                                 pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[first:end] for c in carried], pa.array(n),
                                                  pa.array(total), lists], names=[*carried, "n_words", "total", "_open"])
    kinds = ", ".join(f"{c} bigint" for c in carried)
    rows = cut(docs.select(*[F.col(c).cast("bigint") for c in carried], "text").mapInArrow(
        run, f"{kinds}, n_words bigint, total double, _open array<bigint>")).withColumn(
        "_row", F.monotonically_increasing_id())
    keys = cut(_open_words(docs, shared))
    contexts = others.groupBy(F.shiftrightunsigned("key", 8).alias("_c")).agg(F.first("rest").alias("_rest"))
    late = (keys.where("key IS NOT NULL").join(others.select("key", "ratio"), "key", "left")
            .withColumn("value", F.coalesce(F.col("ratio").cast("double"), "value")))
    missing = late.where("value IS NULL").withColumn("_c", F.shiftrightunsigned("key", 8)).join(contexts, "_c")
    values = (keys.where("key IS NULL").select("h", "value").unionByName(late.where("value IS NOT NULL").select("h", "value"))
              .unionByName(missing.select("h", F.col("_rest").cast("double").alias("value"))))
    total = F.sum("value")
    words = values.groupBy("h").agg((F.signum(total) * F.greatest(F.abs(total) - DEAD_ZONE, F.lit(0.0))).alias("_value"))
    words = small(cut(words.select(F.col("h").alias("_h"), F.rint(F.col("_value") * 4096).alias("_value"))
                      .where("_value != 0")), WORD_ROWS)
    extra = (rows.select("_row", F.explode("_open").alias("h")).join(words, F.col("h") == F.col("_h"))
             .groupBy("_row").agg((F.sum("_value") / 4096).alias("_extra")))
    return rows.join(extra, "_row", "left").select(
        *carried, "n_words", (F.col("total") + F.coalesce("_extra", F.lit(0.0))).alias("total"))


def _features() -> list[Column]:
    gain = F.greatest(F.col("total"), F.lit(0.0))
    return [F.log1p(gain), F.log1p(100 * gain / F.greatest("n_words", F.lit(1)))]


def curve(rows: list) -> tuple[float, ...]:
    """Intercept and weights of a logistic curve by damped Newton steps; ``rows`` hold the features and the label."""
    x = np.array([[1.0, *r[:-1]] for r in rows]).reshape(len(rows), 3)
    y = np.array([float(r[-1]) for r in rows])
    w = np.zeros(3)
    if not len(rows) or y.min() == y.max():
        share = y.mean() if len(rows) else 0.0
        return (float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), 0.0, 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        w -= np.clip(np.linalg.solve(hessian, x.T @ (p - y) + 0.1 * w), -2, 2)
    return tuple(float(v) for v in w)


def scored(docs: DataFrame, labels: DataFrame, limit: int = MAX_ENTRIES) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; only labels of rows that aren't held out are read. The tasks
    hold ``limit`` ratios; scores don't depend on it."""
    spark = docs.sparkSession
    known = cut(labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) % 3 != 1)).groupBy("doc_id")
                .agg(F.max("toxic").cast("int").alias("toxic")))
    parts = max(5, known.count() // CALIBRATION_ROWS)
    known = known.select(F.col("doc_id").alias("_id"), "toxic",
                         (F.floor(fold(F.col("doc_id")) / 3) % parts == 0).alias("_aside"))
    train = docs.select("doc_id", "text").join(small(known, LABEL_ROWS), F.col("doc_id") == F.col("_id"))
    grams = cut(gram_counts(word_counts(train.where("NOT _aside"))))
    most, others = divided(cut(ratios(grams)), limit)
    table = most.drop("n").toArrow()     # at most ``limit`` rows of 16 bytes
    shared = spark.sparkContext.broadcast(Model.arrays(table))
    del table

    def sums(df: DataFrame, *carried: str) -> DataFrame:
        return summed(df, shared, *carried) if others is None else summed_beyond(df, shared, others, *carried)
    aside = sums(train.where("_aside"), "doc_id", "toxic")
    sample = (aside.orderBy(F.xxhash64("doc_id"), "total").limit(CALIBRATION_ROWS)
              .select(*[f.alias(f"f{i}") for i, f in enumerate(_features())], "toxic").collect())
    b, *weights = curve(sample)
    z = F.lit(b)
    for w, f in zip(weights, _features()):
        z = z + w * f
    score = 1 / (1 + F.exp(-z))
    return (sums(docs, "doc_id").withColumn("score", score)
            .select("doc_id", (fold(F.col("doc_id")) % 3 == 1).alias("held_out"), "score",
                    (F.col("score") >= CUT_SCORE).cast("int").alias("predicted")))
