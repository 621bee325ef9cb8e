"""Token counts by a linear longest-match automaton.

A vocabulary is a trie over bytes, a word's end being one more symbol. Greedy longest-match pieces are counted in one pass:
every trie node has a failure link, the node reached after the longest match at its start is popped and the rest is read
again, and the number of pieces popped on the way. The automaton follows them where a byte has no edge, so no piece is built
and no byte is read twice.

Words are maximal runs without white space, in lower case (A-Z). Where the longest piece ends with the word but has no
word-end mark, the mark that is left costs nothing. A word whose greedy pieces break off is one unknown token. A task keeps the counts of the last CACHE_WORDS distinct words it met, as few words make up most of a text; the
counts don't depend on it.

The vocabulary is any file of byte-level pieces with word-end marks (tokenizers' JSON); its path is a parameter, it is read
by the driver and sent to the tasks. Its size is that of the file.

Edge cases: null and empty texts have no words and no tokens; a null id is carried; rows that repeat come back each; an
empty table gives an empty table; extra columns are ignored. A word of any length takes time and memory in proportion.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
WORD_END = "</w>"
END = 256           # the symbol of a word's end
CACHE_WORDS = 200_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def byte_characters() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the
    other bytes follow in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def pieces(path: str = VOCABULARY) -> list[tuple[int, ...]]:
    """The vocabulary's pieces as symbols, END last where a piece ends a word."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    table, found = byte_characters(), []
    for token in vocabulary:
        body = token.removesuffix(WORD_END)
        if all(c in table for c in body):
            symbols = tuple(table[c] for c in body) + ((END,) if body != token else ())
            if symbols:
                found.append(symbols)
    return found


class Automaton:
    """Trie nodes with failure links; ``link[v]`` is -1 where the symbols read so far have no pieces."""

    def __init__(self, vocabulary: list[tuple[int, ...]]):
        self.edges: list[dict[int, int]] = [{}]
        is_piece = [False]
        for symbols in (*vocabulary, (END,)):
            v = 0
            for s in symbols:
                if s not in self.edges[v]:
                    self.edges[v][s] = len(self.edges)
                    self.edges.append({})
                    is_piece.append(False)
                v = self.edges[v][s]
            is_piece[v] = True
        n = len(self.edges)
        self.link, self.pops = [-1] * n, [0] * n
        level = [0]
        while level:        # breadth first: a link leads to a shorter node
            below = []
            for u in level:
                for s, v in self.edges[u].items():
                    below.append(v)
                    if is_piece[v]:
                        self.link[v], self.pops[v] = 0, int((u, s) != (0, END))
                        continue
                    at, popped = self.link[u], self.pops[u]
                    while at >= 0 and s not in self.edges[at]:
                        popped += self.pops[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[v], self.pops[v] = self.edges[at][s], popped
            level = below

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 if it has none."""
        edges, link, pops = self.edges, self.link, self.pops
        at = total = 0
        for symbol in (*word, END):
            while symbol not in edges[at]:
                total += pops[at]
                at = link[at]
                if at < 0:
                    return 0
            at = edges[at][symbol]
        while at > 0:       # what is left must pop to the root
            total += pops[at]
            at = link[at]
        return total if at == 0 else 0


class _Counts(dict):
    """Tokens per word, computed when first asked for."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = self[word] = self.automaton.count(word)
        return n


def counted(docs: DataFrame, path: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_tokens, n_unknown) per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces(path))

    def run(batches):
        tokens_of = _Counts(Automaton(shared.value))
        for batch in batches:
            words, tokens, unknown = [], [], []
            for text in batch.column("text"):
                raw = text.as_buffer()
                found = bytes(raw).translate(_LOWER).split() if raw is not None else []
                counts = [tokens_of[w] for w in found]
                none = counts.count(0)
                words.append(len(counts))
                tokens.append(sum(counts) + none)
                unknown.append(none)
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(x, pa.int64())
                                                                   for x in (words, tokens, unknown)]],
                                             names=[key, "n_words", "n_tokens", "n_unknown"])
    return docs.select(F.col(key).cast("bigint"), "text").mapInArrow(
        run, f"{key} bigint, n_words bigint, n_tokens bigint, n_unknown bigint")
