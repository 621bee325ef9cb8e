"""Best-fit packing with certified bin counts.

Documents become token ids with an end mark. Pieces of the full length are sequences of their own; the others are packed:

1. They are dealt to partitions of a bounded size, by length in turn, so that all have about the same lengths. Each
   partition runs best-fit decreasing by itself.
2. A lower bound certifies the partition's bins: dual feasible functions turn lengths into weights that no bin can hold more
   than 1 of, so the sum of weights, in the best of several thousand functions, is a number of bins that nothing beats.
3. A partition keeps as many bins, fullest first, as the whole part of its bound. What is left over, a remainder or a real
   gap, is exchanged: the documents of all partitions' other bins are dealt anew and packed again. A partition with more bins
   than its rounded bound gives away every bin that isn't full. Rounds go on while they save bins; one that saves none is
   undone.

Every round is stored, and partitions are sorted before they are packed, so a repeated task gives the same bins. A round's
documents shrink to a few bins per partition, and the last rounds fit one task because little is left, not because of a cap.

Edge cases: a null or empty text is the end mark alone; null ids are carried; rows that repeat an id or a text are packed
each; an empty table gives an empty table; texts of any length are cut at the capacity; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.llm.common import chunks, cut
from promptsieve.llm.token_counts import byte_characters

CAPACITY = 4096
END = 1                         # the id after a document
PARTITION_PIECES = 1 << 17      # pieces that a task packs
ROUNDS = 6
HELD_BYTES = 8 << 20            # text that is tokenised at once; a longer text goes alone
CACHE_WORDS = 700_000           # whose ids a Python worker keeps
STEPS = 12                      # functions that round a weight to a multiple of 1/k, for k up to this
_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PLACED = _PIECE + ", sequence_id bigint, offset bigint"


def default_tokenizer() -> str:
    """The public vocabulary's JSON file; pass another path for another tokenizer."""
    import public_tokenizers
    return public_tokenizers.path(WORD_TOKENIZER)


# How the vocabulary's tokenizer cuts a word of printable ASCII and Latin-1 letters, in lower case.
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_PRINTABLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_BYTES = {b: c for c, b in byte_characters().items()}
WORD_TOKENIZER = "word_bpe_49k.json"


class Encoder:
    """Ids of words. The last CACHE_WORDS distinct words and parts of words are kept; ids don't depend on it.

    ``plain`` says that the tokenizer lowers and cuts words like WORD_TOKENIZER's, so the parts of a word of printable ASCII
    and Latin-1 letters, which normalisation only lowers, go to its BPE model directly. All other words, and all words of
    other tokenizers, go through the whole tokenizer."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark's tasks use the cores
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(definition)
        self.model, self.special = self.tokenizer.model, [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        parts = json.loads(definition)
        normalizer, cutter = parts.get("normalizer") or {}, parts.get("pre_tokenizer") or {}
        kinds = [x["type"] for x in normalizer.get("normalizers", [])], [x["type"] for x in cutter.get("pretokenizers", [])]
        pattern = next((x["pattern"].get("Regex") for x in cutter.get("pretokenizers", []) if x["type"] == "Split"), None)
        self.plain = (kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and parts["model"]["type"] == "BPE"
                      and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.known: dict[str, list[int]] = {}       # a part has the ids of the word that it would be alone

    def _part(self, part: str) -> list[int]:
        ids = self.known.get(part)
        if ids is None:
            written = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTES)
            ids = self.known[part] = [t.id for t in self.model.tokenize(written)]
        return ids

    def _plain(self, word: str) -> list[int] | None:
        """Ids by the word's parts, if it is plain and without a special token."""
        if _LETTERS.fullmatch(word):
            return self._part(word.lower())
        if not _PRINTABLE.fullmatch(word) or any(s in word for s in self.special):
            return None
        return [k for x in _PARTS.findall(word.lower()) for k in self._part(x)]

    def each(self, words: list[str]) -> list[list[int]]:
        known, others = self.known, []
        if len(known) > CACHE_WORDS:
            known.clear()
        out = list(map(known.get, words))
        for i, ids in enumerate(out):
            if ids is None:
                word = words[i]
                ids = self._plain(word) if self.plain else None
                if ids is None:
                    others.append(i)
                else:
                    out[i] = known[word] = ids
        coded = self.tokenizer.encode_batch_fast([words[i] for i in others], add_special_tokens=False)
        for i, x in zip(others, coded):
            out[i] = known[words[i]] = x.ids
        return out


_LOADED: dict[str, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """The encoder of a tokenizer's definition, made once per Python worker."""
    if definition not in _LOADED:
        _LOADED.clear()
        _LOADED[definition] = Encoder(definition)
    return _LOADED[definition]


def encoded(words_to_ids: Encoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): the texts' token ids. The tokenizer drops white space and doesn't look across it, so every distinct
    word of the batch is encoded once."""
    words = pc.ascii_split_whitespace(texts.fill_null(""))
    coded = words.flatten().dictionary_encode()
    each = words_to_ids.each(coded.dictionary.to_pylist())
    size = np.fromiter(map(len, each), np.int64, len(each))
    first = np.cumsum(size) - size
    flat = np.fromiter(itertools.chain.from_iterable(each), np.uint32, int(size.sum()))
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = size[word]
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat((first[word] - ends[:-1]).astype(np.int32), n)   # a batch of text has fewer than 2^31 ids
    at += np.arange(ends[-1], dtype=np.int32)
    ids = flat[at]
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, ends[np.concatenate([[0], np.cumsum(counts)])]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row: its ids and END, cut at ``capacity``. ``tokenizer`` is
    a path that the driver reads; ``ids`` are little-endian unsigned 32-bit numbers."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        tok = encoder(shared.value)
        for batch in batches:
            text = batch.column("text")
            for first, end, _, _ in chunks(text, HELD_BYTES):
                ids, bounds = encoded(tok, text[first:end])
                rows = []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    raw = np.append(ids[a:b], np.uint32(END)).astype("<u4").tobytes()
                    for k, at in enumerate(range(0, b - a + 1, capacity)):
                        part = raw[4 * at:4 * (at + capacity)]
                        rows.append((first + i, k, at, len(part) // 4, zlib.crc32(part), part))
                at, k, start, length, crc, part = zip(*rows)
                columns = [batch.column("doc_id").take(pa.array(at)), pa.array(k, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array(part, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
    schema = _PIECE + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset, bins): every length goes to the fullest bin that holds it. ``lengths`` fall. Bins wait by the room that
    they have left; a bit per room finds the smallest that is enough."""
    rooms, waiting, n = 0, [[] for _ in range(capacity)], 0
    place, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for i, size in enumerate(lengths):
        enough = rooms >> size
        if enough:
            room = size + (enough & -enough).bit_length() - 1
            found = waiting[room].pop()
            if not waiting[room]:
                rooms ^= 1 << room
        else:
            room, found = capacity, n
            n += 1
        place[i], offset[i] = found, capacity - room
        left = room - size
        if left:
            waiting[left].append(found)
            rooms |= 1 << left
    return place, offset, n


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> Fraction:
    """No packing of ``counts[s]`` pieces of each length s has fewer bins. Two families of dual feasible functions, one after
    the other: lengths above capacity - t weigh 1 and those below t nothing, and weights are rounded down to multiples of 1/k
    where k + 1 of them don't fill the bin. The largest sum over all t and k counts; it is exact."""
    size = np.arange(capacity + 1, dtype=np.int64)
    above = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])     # pieces of this length or more
    t = np.arange(capacity // 2 + 1)
    best = Fraction(0)
    for k in range(steps + 1):
        whole = capacity * max(k, 1)
        weight = size if k == 0 else np.where((k + 1) * size % capacity == 0, k * size, (k + 1) * size // capacity * capacity)
        upto = np.concatenate([[0], np.cumsum(counts * weight)])
        middle = np.maximum(upto[capacity - t + 1] - upto[t], 0)
        best = max(best, Fraction(int((whole * above[capacity - t + 1] + middle).max()), whole))
    return best


def _histogram(lengths: np.ndarray, capacity: int) -> np.ndarray:
    return np.bincount(lengths, minlength=capacity + 1).astype(np.int64)


def _packed(rows: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    """``rows`` with a sequence, an offset and whether the partition keeps that sequence."""
    def run(batches):
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        lengths = table.column("length").to_numpy()
        place, offset, n = best_fit(lengths.tolist(), capacity)
        bound = lower_bound(_histogram(lengths, capacity), capacity)
        filled = np.bincount(place, weights=lengths, minlength=n).astype(np.int64)
        keep = np.zeros(n, dtype=bool)
        keep[np.argsort(-filled, kind="stable")[:int(bound)]] = True
        if n > -(-bound.numerator // bound.denominator):    # a gap beyond rounding: all but the full bins are exchanged
            keep &= filled == capacity
        named = place + ((turn << 58) + (TaskContext.get().partitionId() << 24))
        table = table.append_column("sequence_id", pa.array(named)).append_column("offset", pa.array(offset)).append_column(
            "kept", pa.array(keep[place]))
        yield from table.to_batches(max_chunksize=50_000)
    # every task deals its pieces by length in turn, so that partitions get about the same lengths
    turns = rows.sortWithinPartitions("length", "_row").withColumn("_turn", F.monotonically_increasing_id())
    part = F.pmod(F.col("_turn") % (1 << 33) + F.xxhash64(F.shiftright("_turn", 33), F.lit(turn)), F.lit(parts)).cast("int")
    dealt = turns.repartitionById(parts, part).drop("_turn").sortWithinPartitions(F.desc("length"), "_row")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.mapInArrow(run, schema + ", sequence_id bigint, offset bigint, kept boolean")


def packed(cuts: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """Pieces of ``pieces`` (without ids) with ``sequence_id`` and ``offset``; further columns are kept."""
    rows = cut(cuts).withColumn("_row", F.monotonically_increasing_id())
    full = rows.where(F.col("length") >= capacity).withColumns(
        {"sequence_id": -1 - F.col("_row"), "offset": F.lit(0).cast("bigint")})
    pool, before = rows.where(F.col("length") < capacity), None
    done = [full]
    for turn in range(ROUNDS):
        waiting = pool.count()
        if not waiting:
            break
        parts = -(-waiting // partition_pieces)
        again = cut(_packed(pool.select(*rows.columns), parts, turn, capacity))
        bins = again.groupBy("sequence_id").agg(F.first("kept").alias("kept"))
        kept, released = (bins.agg(F.count_if("kept"), F.count_if(~F.col("kept"))).first())
        if before is not None and kept + released >= before:
            break
        done.append(again.where("kept").drop("kept"))
        pool, before = again.where("NOT kept").drop("kept"), released
        if before <= 1:
            break
    if before:
        done.append(pool)       # bins that no exchange could save
    placed = done[0]
    for part in done[1:]:
        placed = placed.unionByName(part)
    return placed.drop("_row")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row."""
    return packed(pieces(docs, tokenizer, capacity), capacity).select(*[c.split()[0] for c in _PLACED.split(", ")])


def certificate(placed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences, lower bound of any packing of these pieces). At most ``capacity`` counts reach the driver."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in placed.groupBy("length").count().collect():
        counts[length] = n
    bound = lower_bound(counts, capacity)
    return placed.select("sequence_id").distinct().count(), -(-bound.numerator // bound.denominator)


def sequences(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids, documents): the packed ids and the (doc_id, piece, offset, length) that they come from."""
    cuts = cut(pieces(docs, tokenizer, capacity, with_ids=True)).withColumn("_key", F.monotonically_increasing_id())
    placed = packed(cuts.drop("ids"), capacity).select("_key", "sequence_id", "offset")
    part = F.struct("offset", "doc_id", "piece", "length", F.hex("ids").alias("hex"))
    rows = cuts.join(placed, "_key").groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    joined = F.unhex(F.array_join("parts.hex", ""))
    documents = F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"),
                                                        p["offset"].alias("offset"), p["length"].alias("length")))
    return rows.select("sequence_id", joined.alias("ids"), documents.alias("documents"))
