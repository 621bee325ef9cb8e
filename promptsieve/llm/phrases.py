"""Phrase collocation mining by stripes.

A stripe belongs to a prefix (the first words of a phrase) and counts the words that follow it. Map tasks keep stripes of the
text they have read; stripes of one prefix meet in a task and are added elementwise. The words of a language are the stripe
of the empty prefix, and every longer phrase is an entry of its prefix's stripe, so stripes give all there is to know: how
often an extension occurs, how often its prefix and its remainder do, and by the largest entries which phrase is part of a
longer one that is as frequent.

Lengths are mined in turn. A phrase can't be more frequent than a part of it, so a position is counted only if its prefix and
its suffix reached the least count one length before. Tasks hold these as a bitmap of at most 2^MAX_BITS bits whatever the
number of phrases; its false hits cost a row each and change nothing. The stripes of a prefix that holds a thousandth of all
words (there are at most a thousand) are cut into SEGMENTS, so no stripe grows with its prefix's share.

Words and phrases are named by 64-bit hashes within their language while they are counted; scores are computed on their
strings, and in decimals of 38 digits.

Edge cases: null and empty texts have no word; a null language is `und`; rows that repeat an id or a text count each; an empty
table gives an empty table; texts of any length are read whole, in pieces of text that a task holds; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsieve.llm.common import chunks, cut, mixed, small, word_hashes, word_spans

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
NO_LANG = "und"
HOT_PARTS = 1000            # a prefix with more than one in so many words is cut into segments
SEGMENTS = 64
BITS_PER_PHRASE, MIN_BITS, MAX_BITS, BLOCK_BITS = 16, 16, 28, 16
HELD_WORDS = 200_000        # distinct words of a map task before it sends them
HELD_ENTRIES = 2_000_000    # entries of a map task's stripes before they are added up, and sent if half of them remain
_C = np.uint64(0x9E3779B97F4A7C15)

_IS_CUT = np.zeros(256, dtype=bool)
_IS_CUT[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_IS_WORD = ~_IS_CUT
_IS_WORD[[32, 9]] = False


def _lang_key(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), dtype=np.uint64)[0]


def words_of(batch: pa.RecordBatch):
    """Per piece of text: (keys, follows, data, starts, stops, row of each word). ``follows`` says that the next word stands
    in the same piece; keys are hashes of words in lower case and their language."""
    langs = batch.column("lang").dictionary_encode()
    seeds = np.array([_lang_key(x) for x in langs.dictionary.to_pylist()], dtype=np.uint64)
    code = langs.indices.to_numpy(zero_copy_only=False)
    for first, _, data, ends in chunks(batch.column("text")):
        starts, stops, bounds = word_spans(data, ends, _IS_WORD)
        if not len(starts):
            continue
        row = first + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        keys = mixed(word_hashes(data, starts, stops) ^ seeds[code[row]])
        cuts = np.cumsum(np.take(_IS_CUT, data))[starts]
        follows = np.zeros(len(starts), dtype=bool)
        follows[:-1] = (cuts[1:] == cuts[:-1]) & (row[1:] == row[:-1])
        yield keys, follows, data, starts, stops, row


def grams(keys: np.ndarray, follows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, whole) of the phrases of ``n`` words at every word; only where ``whole`` they stay in a piece."""
    names, whole = keys, np.ones(len(keys), dtype=bool)
    for k in range(1, n):
        if len(keys) <= k:
            return keys[:0], whole[:0]
        whole = whole[:-1] & follows[k - 1:len(keys) - 1]
        names = extended(names[:-1], keys[k:])
    return names, whole


def extended(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(prefix * _C + word)


def added(prefix: np.ndarray, word: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Elementwise sums of stripes: (prefix, word, count), sorted."""
    order = np.lexsort((word, prefix))
    prefix, word = prefix[order], word[order]
    new = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (word[1:] != word[:-1])]))
    return prefix[new], word[new], np.add.reduceat(count[order], new)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, name, a): every word and its occurrences. Map tasks add up theirs first."""
    def run(batches):
        held: dict[int, list] = {}

        def sent():
            columns = zip(*[(lang, word, key, n) for key, (lang, word, n) in held.items()])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["lang", "phrase", "name", "a"])
        for batch in batches:
            langs = batch.column("lang")
            for keys, _, data, starts, stops, row in words_of(batch):
                found, at, n = np.unique(keys, return_index=True, return_counts=True)
                for key, i, k in zip(found.view(np.int64).tolist(), at.tolist(), n.tolist()):
                    if key in held:
                        held[key][2] += k
                    else:
                        held[key] = [langs[int(row[i])].as_py(), data[starts[i]:stops[i]].tobytes().lower().decode(), k]
                if len(held) >= HELD_WORDS:
                    yield sent()
                    held.clear()
        if held:
            yield sent()
    parts = _texts(docs).mapInArrow(run, "lang string, phrase string, name bigint, a bigint")
    return parts.groupBy("lang", "phrase").agg(F.first("name").alias("name"), F.sum("a").alias("a"))


def bitmap(names: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bitmap) of the column ``name``: bit ``name >> 64 - bits`` is set. Built block by block in tasks."""
    n = names.count()
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(BITS_PER_PHRASE * max(n, 1)))))
    block = F.shiftrightunsigned("name", 64 - bits + BLOCK_BITS) if bits > BLOCK_BITS else F.lit(0).cast("bigint")

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            place = batch.column("name").to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            of = (place >> np.uint64(BLOCK_BITS)).astype(np.int64)
            for b in np.unique(of).tolist():
                held.setdefault(b, np.zeros(1 << BLOCK_BITS, dtype=bool))[
                    place[of == b] & np.uint64((1 << BLOCK_BITS) - 1)] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(
                [np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], names=["block", "bits"])
    blocks = names.select("name").repartition(block).sortWithinPartitions("name").mapInArrow(run, "block bigint, bits binary")
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    width = 1 << (BLOCK_BITS - 3)
    for b, part in blocks.collect():        # 2^MAX_BITS bits at most, 32 MB
        out[b * width:(b + 1) * width] |= np.frombuffer(part, dtype=np.uint8)
    return bits, out


def _in(known: tuple[int, np.ndarray], names: np.ndarray) -> np.ndarray:
    bits, table = known
    place = names >> np.uint64(64 - bits)
    return (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _stripes(prefix: np.ndarray, segment: np.ndarray, word: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """A row per stripe of entries that are sorted by prefix and segment."""
    at = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (segment[1:] != segment[:-1])]))
    offsets = pa.array(np.append(at, len(prefix)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.view(np.int64))) for x in (word, count)]
    return pa.RecordBatch.from_arrays([pa.array(prefix[at].view(np.int64)), pa.array(segment[at].astype(np.int32)), *lists],
                                      names=["prefix", "segment", "words", "counts"])


def stripes(docs: DataFrame, n: int, known: tuple[int, np.ndarray], hot: list[int]) -> DataFrame:
    """(prefix, segment, words, counts): map tasks' stripes of prefixes of ``n`` - 1 words."""
    shared = docs.sparkSession.sparkContext.broadcast((known, np.array(sorted(hot), dtype=np.int64).view(np.uint64)))

    def run(batches):
        known, hot = shared.value
        held: list[tuple] = []

        def sent(prefix, word, count):
            segment = np.where(np.isin(prefix, hot), (word % np.uint64(SEGMENTS)).astype(np.int64), 0)
            order = np.lexsort((segment, prefix))
            prefix, segment, word, count = prefix[order], segment[order], word[order], count[order]
            for a in range(0, len(prefix), 250_000):
                part = slice(a, a + 250_000)
                yield _stripes(prefix[part], segment[part], word[part], count[part])

        for batch in batches:
            for keys, follows, *_ in words_of(batch):
                names, whole = grams(keys, follows, n - 1)
                if len(names) < 2:
                    continue
                frequent = whole & _in(known, names)
                at = np.flatnonzero(frequent[:-1] & frequent[1:] & follows[n - 2:n - 2 + len(names) - 1])
                if not len(at):
                    continue
                held.append(added(names[at], keys[at + n - 1], np.ones(len(at), dtype=np.int64)))
                if sum(len(x[0]) for x in held) >= HELD_ENTRIES:
                    held = [added(*map(np.concatenate, zip(*held)))]
                    if len(held[0][0]) >= HELD_ENTRIES // 2:
                        yield from sent(*held.pop())
        if held:
            yield from sent(*added(*map(np.concatenate, zip(*held))))
    return _texts(docs).mapInArrow(run, "prefix bigint, segment int, words array<bigint>, counts array<bigint>")


def merged(parts: DataFrame, min_count: int) -> DataFrame:
    """(prefix, word, name, a): the entries of the added stripes that reach ``min_count``. A task reads its stripes in order
    and holds a batch and one stripe."""
    def run(batches):
        held = [np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64)]

        def frequent(prefix, word, count):
            keep = count >= min_count
            prefix, word = prefix[keep], word[keep]
            return pa.RecordBatch.from_arrays(
                [pa.array(x.view(np.int64)) for x in (prefix, word, extended(prefix, word), count[keep])],
                names=["prefix", "word", "name", "a"])
        for batch in batches:
            sizes = batch.column("words").value_lengths().to_numpy(zero_copy_only=False)
            if not len(sizes):
                continue
            prefix = np.repeat(batch.column("prefix").to_numpy().view(np.uint64), sizes)
            word = batch.column("words").flatten().to_numpy().view(np.uint64)
            count = batch.column("counts").flatten().to_numpy()
            last = prefix[-1]
            prefix, word, count = added(*map(np.concatenate, zip(held, (prefix, word, count))))
            open_ = prefix == last
            held = [x[open_] for x in (prefix, word, count)]
            yield frequent(*[x[~open_] for x in (prefix, word, count)])
        if len(held[0]):
            yield frequent(*held)
    dealt = parts.repartition("prefix", "segment").sortWithinPartitions("prefix", "segment")
    return dealt.mapInArrow(run, "prefix bigint, word bigint, name bigint, a bigint")


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, n_words, a) of every phrase that occurs ``min_count`` times, (lang, n) words in all)."""
    counted = cut(word_counts(docs))
    totals = cut(counted.groupBy("lang").agg(F.sum("a").alias("n")))
    n_all = totals.agg(F.sum("n")).first()[0] or 0
    words = cut(counted.where(F.col("a") >= min_count))
    shorter, found = words, [words.withColumn("n_words", F.lit(1))]
    for n in range(2, max_words + 1):
        if shorter.limit(1).count() == 0:
            break
        hot = [r[0] for r in shorter.where(F.col("a") * HOT_PARTS > n_all).select("name").collect()]    # HOT_PARTS at most
        entries = merged(stripes(docs, n, bitmap(shorter), hot), min_count)
        prefixes = shorter.select("lang", F.col("phrase").alias("_first"), F.col("name").alias("prefix"))
        nexts = words.select(F.col("phrase").alias("_last"), F.col("name").alias("word"))
        shorter = cut(entries.join(prefixes, "prefix").join(nexts, "word").select(
            "lang", F.concat_ws(" ", "_first", "_last").alias("phrase"), "name", "a"))
        found.append(shorter.withColumn("n_words", F.lit(n)))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select("lang", "phrase", "n_words", "a"), totals


def _part(first: Column | int, n: Column) -> Column:
    return F.array_join(F.slice("_words", first, n), " ")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, n_words, a, l, r, n, score, longer): phrases of two words or more with their weakest cut; ``longer`` is
    the largest count of a phrase that has one word more."""
    of = lambda name, value: phrases.select(F.col("lang"), F.col("phrase").alias(name), F.col("a").alias(value))
    several = phrases.where("n_words > 1").withColumn("_words", F.split("phrase", " "))
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1))).select(
        "lang", "phrase", "n_words", "a", "k", _part(1, F.col("k")).alias("_left"),
        _part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("_right"))
    both = cuts.join(of("_left", "l"), ["lang", "_left"]).join(of("_right", "r"), ["lang", "_right"]).join(small(totals), "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    both = both.withColumns({"_num": F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), "_den": wide("l") * wide("r")})
    weakest = both.withColumn("score", F.expr("_num div _den")).groupBy("lang", "phrase", "n_words", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("_w"))
    # one word more, before or behind: a longer phrase that is as frequent has such a part between
    ends = several.where("n_words > 2").select("lang", "a", F.explode(F.array(
        _part(1, F.col("n_words") - 1), _part(2, F.col("n_words") - 1))).alias("phrase"))
    longer = ends.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return weakest.join(longer, ["lang", "phrase"], "left").select(
        "lang", "phrase", "n_words", "a", "_w.l", "_w.r", "n", "_w.score", F.coalesce("longer", F.lit(0)).alias("longer"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases that no longer phrase stands for."""
    phrases, totals = frequent_phrases(docs, min_count, max_words)
    left = scored(cut(phrases), totals).where(F.col("longer") < F.col("a"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
