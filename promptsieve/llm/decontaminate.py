"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

The CGK random walk copies a word to the output at every step and advances by a random bit of that word, so that sequences
within a small edit distance stay in step and their outputs agree at many places: edit distance becomes Hamming distance.
Walks open at every word of every item and of every document. Bit sampling hashes the first output word with one later one;
WALKS walks with other bits, each sampled at every step that has moved on, are the repeats. With a fifth of the characters
edited two words in three differ and long walks lose step, so the sampled places are near, and agreements are counted over
the item-sized window instead, three times where the walk opens at a word longer than SHORT_WORD bytes, as short words agree
by chance. A window with enough of them for the item's length on about the same alignment is a candidate. Its parts that
share enough of the item's runs of GRAM characters are verified: the item must occur there within MAX_EDITS_PERCENT of its
characters, insertions, deletions and substitutions counted exactly. Matches are exact; the recall of the search before is
measured against the exact distance in the tests.

Items of fewer than MIN_ITEM_WORDS words hold too few places to count. They are searched exactly, as the same words in a row.

The index of at most BLOCK_ITEMS items is held by the tasks; a larger benchmark goes through in blocks of that size.
Documents are only mapped: no shuffle, and memory is bounded by PIECE_WORDS words and one block.

Words are runs of letters and digits in lower case (A-Z; anything beyond ASCII counts as a letter); item and window are
compared as words joined by single spaces.

Edge cases: items without a word match nothing, like null and empty texts; null ids are carried; rows that repeat an id or
a text each give their own matches; an empty benchmark or empty documents give no match; extra columns are ignored.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.llm.common import chunks, cut, lowered, mixed, small, with_side, word_hashes, word_spans

WALKS = 3               # each reads 16 bits of a word's hash
STEPS = 6               # of a walk
HITS_PERCENT = 14       # agreements asked of a window, of the item's words
LONG_HITS = 3           # what a long word's agreement counts
SHORT_WORD = 3
SHARED_PERCENT = 13     # runs of characters asked of a part, of the item's
MIN_ITEM_WORDS = 8      # shorter items are searched exactly
MAX_EDITS_PERCENT = 20
BLOCK_ITEMS = 20_000
PIECE_WORDS = 1 << 16   # words that are searched at once
GRAM = 7
GRAM_BITS = 13
NO_GRAM = 1 << GRAM_BITS
FRESH = 256
GAP = 32                # places between parts of a window
FLAT = 1 << 18          # runs of characters that are compared at once
_C = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.arange(STEPS, dtype=np.uint64) * _C

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def walk_keys(h: np.ndarray):
    """(opening words, keys) per walk and step: the first output word hashed with the one after the step, of the walks that
    moved in this step and are still inside ``h``."""
    n, second = len(h), mixed(h ^ _C)
    coins_of = np.append(h, np.uint64(0))       # a walk that leaves the words stays where it left
    for walk in range(WALKS):
        coins = (coins_of >> np.uint64(walk * 16)).astype(np.uint16)
        first = mixed(h + np.uint64(walk))
        at = np.arange(n, dtype=np.int32)
        for step in range(STEPS):
            moved = (coins[at] >> np.uint16(step)) & np.uint16(1)
            at += moved.astype(np.int32)
            opens = np.flatnonzero(moved)
            near = np.searchsorted(opens, n - STEPS)    # from here on walks may have left
            opens = np.append(opens[:near], opens[near:][at[opens[near:]] < n])
            yield opens, first[opens] + _STEP[step] ^ second[at[opens]]


def row_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on."""
    out = np.full(max(0, len(h) - n + 1), n, dtype=np.uint64)
    for k in range(n):
        out = mixed(out * _C ^ h[k:k + len(out)])
    return out


class Words:
    """Words of some texts: text k has words bounds[k] to bounds[k + 1]."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.data = data
        self.begins, self.ends, self.bounds = word_spans(data, ends, _IS_WORD)
        self.hashes = word_hashes(data, self.begins, self.ends)

    @cached_property
    def joined(self) -> tuple[str, np.ndarray, np.ndarray]:
        inside = _IS_WORD[self.data]
        kept = inside.copy()
        kept[1:] |= inside[:-1]     # one separator after a word
        place = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(kept & (self.data & 0xC0 != 0x80), out=place[1:])
        text = np.where(inside, lowered(self.data), np.uint8(32))[kept].tobytes().decode("utf-8", "replace")
        return text, place[self.begins], place[self.ends]

    def places(self, low, high) -> tuple:
        """Where words ``low`` to ``high`` begin and end among the code points of the words joined by single spaces."""
        return self.joined[1][low], self.joined[2][high - 1]

    def part(self, low: int, high: int) -> str:
        a, b = self.places(low, high)
        return self.joined[0][a:b]

    @cached_property
    def grams(self) -> np.ndarray:
        """Hashes of the runs; NO_GRAM where the run stood within the FRESH places before, as in a word said over and over."""
        g = gram_hashes(self.joined[0])
        order = np.argsort(g.astype(np.uint16), kind="stable")
        again = (g[order[1:]] == g[order[:-1]]) & (np.diff(order) <= FRESH)
        g[order[1:][again]] = NO_GRAM
        return g


def gram_hashes(text: str) -> np.ndarray:
    """GRAM_BITS of a hash of the GRAM code points from each place on."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    h = np.zeros(max(0, len(c) - GRAM + 1), dtype=np.uint32)
    for k in range(GRAM):
        h = (h ^ c[k:k + len(h)]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - GRAM_BITS)


class Index:
    """A block of items: keys of the walks at every word, sets of character runs, and short items by the hash of their words."""

    def __init__(self, ids: list, texts: list):
        self.ids, self.texts, n_words, keys, entries, sets = [], [], [], [], [], []
        short: dict[int, dict[int, list[int]]] = {}
        for first, _, data, ends in chunks(pa.array(texts, pa.string())):
            words = Words(data, ends)
            for i, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())):
                if a == b:
                    continue
                item, h = len(self.ids), words.hashes[a:b]
                self.ids.append(ids[first + i])
                self.texts.append(words.part(a, b))
                n_words.append(b - a)
                bits = np.zeros(NO_GRAM + 8, dtype=bool)
                if b - a < MIN_ITEM_WORDS:
                    short.setdefault(b - a, {}).setdefault(int(row_hashes(h, b - a)[0]), []).append(item)
                else:
                    bits[gram_hashes(self.texts[-1])] = True
                    for opens, k in walk_keys(h):
                        keys.append(k)
                        long = words.ends[a + opens] - words.begins[a + opens] > SHORT_WORD
                        entries.append(np.stack([np.full(len(k), item), opens, long], axis=1))
                sets.append(np.packbits(bits, bitorder="little"))
        self.short = {n: (np.array(sorted(by), dtype=np.uint64), [by[k] for k in sorted(by)]) for n, by in short.items()}
        self.n_words = np.array(n_words, dtype=np.int64)
        self.slack = self.n_words // 4 + 2      # words by which edits may shift the alignment
        self.needed = -(-self.n_words * HITS_PERCENT // 100)
        self.chars = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.most = self.chars * MAX_EDITS_PERCENT // 100
        self.sets = np.stack(sets) if sets else np.zeros((0, NO_GRAM // 8 + 1), dtype=np.uint8)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
        self.entries = np.concatenate(entries) if entries else np.zeros((0, 3), dtype=np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.entries = self.keys[order], self.entries[order]
        self.keys, self.first, self.n_entries = np.unique(self.keys, return_index=True, return_counts=True)
        self.shift = np.uint64(64 - min(26, max(16, len(self.keys).bit_length() + 3)))
        self.table = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.table[self.keys >> self.shift] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window's word, (item, the item's word, whether it is long)) of all equal keys."""
        found, entries = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for at, keys in walk_keys(h):
            maybe = np.flatnonzero(self.table[keys >> self.shift])
            at, keys = at[maybe], keys[maybe]
            key = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            same = np.flatnonzero(self.keys[key] == keys)
            at, key = at[same], key[same]
            low, n = self.first[key], self.n_entries[key]
            found.append(np.repeat(at, n))
            entries.append(np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()))
        return np.concatenate(found), self.entries[np.concatenate(entries)]

    def windows(self, words: Words, low: int, high: int) -> np.ndarray:
        """(item, first word, end word) of the windows within words ``low`` to ``high`` that have enough agreements."""
        at, entry = self.hits(words.hashes[low:high])
        if not len(at):
            return np.zeros((0, 3), dtype=np.int64)
        text = np.searchsorted(words.bounds, at + low, side="right") - 1
        first_text, most = int(text.min()), int(self.n_words.max())
        span, items = high - low + 2 * most, len(self.ids)
        # one number per hit: text, item, the word where the item would open, which may lie before the text, and long or not
        order = ((text - first_text) * items + entry[:, 0]) * span + at - entry[:, 1] + most
        order = np.sort(order * 2 + entry[:, 2])
        sums = np.zeros(len(order) + 1, dtype=np.int64)
        np.cumsum(1 + (LONG_HITS - 1) * (order & 1), out=sums[1:])
        order >>= 1
        item = order // span % items
        near = sums[np.searchsorted(order, order + self.slack[item], side="right")] - sums[:-1]
        order = order[near >= self.needed[item]]
        group, opens = order // span, order % span - most + low
        item, text = group % items, group // items + first_text
        slack = self.slack[item]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (opens[1:] - opens[:-1] > 2 * slack[1:])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(order))[:len(a)] - 1
        item, slack, text = item[a], slack[a], text[a]
        starts = np.maximum(opens[a] - slack, words.bounds[text])
        stops = np.minimum(opens[b] + 2 * slack + self.n_words[item], words.bounds[text + 1])
        return np.stack([item, starts, stops], axis=1)[stops > starts]

    def parts(self, words: Words, windows: np.ndarray):
        """(item, begin, end) of the windows' parts, by code point, where a stretch as long as the item may become shares
        enough runs of characters. Any such stretch lies in one part."""
        item = windows[:, 0]
        a, b = words.places(windows[:, 1], windows[:, 2])
        n = np.maximum(b - a - GRAM + 1, 0)
        cuts = np.flatnonzero(np.diff((np.cumsum(n) - n) // FLAT)) + 1
        for rows in np.split(np.arange(len(item)), cuts):
            rows = rows[n[rows] > 0]
            if not len(rows):
                continue
            size, mine = n[rows], item[rows]
            begins = np.cumsum(size) - size
            here = np.arange(size.sum())
            moved = a[rows] - begins
            g = words.grams[here + np.repeat(moved, size)]
            shared = np.zeros(len(here) + 1, dtype=np.int32)
            np.cumsum((self.sets[np.repeat(mine, size), g >> np.uint32(3)] >> (g & np.uint32(7))) & 1, out=shared[1:])
            width = (self.chars + self.most)[mine] - GRAM + 1
            need = -(-SHARED_PERCENT * (self.chars[mine] - GRAM + 1) // 100)
            stop = np.minimum(here + np.repeat(width, size), np.repeat(begins + size, size))
            good = np.flatnonzero(shared[stop] - shared[:-1] >= np.repeat(need, size))
            row = np.searchsorted(begins, good, side="right") - 1
            new = np.ones(len(good), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (good[1:] - good[:-1] > GAP)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(good))[:len(first)] - 1
            row = row[first]
            yield from zip(mine[row].tolist(), (good[first] + moved[row]).tolist(),
                           np.minimum(good[last] + moved[row] + width[row] + GRAM - 1, b[rows][row]).tolist())


def best_edits(item: str, text: str, most: int) -> int:
    """Least edits between ``item`` and any part of ``text``: a bit-parallel column of the edit matrix per character. It
    ends, with some number above ``most``, once the rest of the text is too short to come down to ``most``."""
    if item in text:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, score = full, 0, len(item)
    best = score
    for rest, c in zip(range(len(text) - 1, -1, -1), text):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(right & top) - bool(left & top)
        right, left = (right << 1) & full, (left << 1) & full
        up, down = left | (full & ~(diagonal | right)), right & diagonal
        if score < best:
            best = score
        elif score - rest > most < best:
            break
    return best


def _matches(index: Index, data: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """(text, item) -> (edits, first word of the window) of every verified window; per text and item the best."""
    words, found = Words(data, ends), {}
    bounds, n = words.bounds, len(words.hashes)
    for k, (keys, items) in index.short.items():
        at = np.flatnonzero(np.isin(hashes := row_hashes(words.hashes, k), keys))
        text, key = np.searchsorted(bounds, at, side="right") - 1, np.searchsorted(keys, hashes[at])
        whole = at + k <= bounds[text + 1]
        at, text, key = at[whole], text[whole], key[whole]
        for j in np.unique(text * len(keys) + key, return_index=True)[1].tolist():
            for item in items[key[j]]:
                if words.part(at[j], at[j] + k) == index.texts[item]:
                    found[int(text[j]), item] = (0, int(at[j] - bounds[text[j]]))
    margin = int((index.n_words + 2 * index.slack).max()) if len(index.keys) else 0
    for low in range(0, n if margin else 0, PIECE_WORDS):
        # a piece reaches so far beyond its end that every match lies in one piece
        windows = index.windows(words, low, min(n, low + PIECE_WORDS + margin))
        if not len(windows):
            continue
        for item, a, b in index.parts(words, windows):
            most = int(index.most[item])
            edits = best_edits(index.texts[item], words.joined[0][a:b], most)
            if edits <= most:
                word = int(np.searchsorted(words.joined[2], a, side="right"))
                text = int(np.searchsorted(bounds, word, side="right")) - 1
                new = edits, word - int(bounds[text])
                found[text, item] = min(found.get((text, item), new), new)
    return found


def _block(docs: DataFrame, ids: list, texts: list) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((ids, texts))

    def run(batches):
        index = Index(*shared.value)
        for batch in batches:
            named = batch.column("doc_id"), batch.column("text_hash")
            for first, _, data, ends in chunks(batch.column("text")):
                found = sorted(_matches(index, data, ends).items())
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(pa.array([first + d for (d, _), _ in found])) for c in named),
                         pa.array([index.ids[i] for (_, i), _ in found], pa.int64()),
                         pa.array([e for _, (e, _) in found], pa.int64()),
                         pa.array([w for _, (_, w) in found], pa.int64())],
                        names=["doc_id", "text_hash", "item_id", "edits", "from_word"])
    return docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id bigint, text_hash bigint, item_id bigint, edits bigint, from_word bigint")


def leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, edits, from_word): every item that a document contains, with the least edits and the first word
    of the window that has them."""
    return _leaks(docs, benchmark, block_items).drop("text_hash")


def _leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("bigint"), "text").where("text IS NOT NULL")
    n = items.count()
    blocks = max(1, -(-2 * n // block_items)) if n > block_items else 1
    found = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), blocks) == b) if blocks > 1 else items
        rows = block.orderBy("item_id", "text").collect()   # at most a block
        part = _block(docs, [r[0] for r in rows], [r[1] for r in rows])
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    hit = cut(_leaks(docs, benchmark).select("doc_id", "text_hash").distinct())
    return with_side(docs, small(hit), "left_anti").select(*[F.col(f"docs.`{c}`") for c in docs.columns])
