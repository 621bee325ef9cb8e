"""N-grams of a token or character sequence, one array per text, linear in its length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptsieve.functions.binding import let


def word_ngrams(tokens: Column, sizes: tuple[int, ...]) -> Column:
    """Space-joined runs of tokens."""

    def runs(words: Column, n: int) -> Column:
        if n == 1:
            return words
        starts = F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda _, i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))

    return let(tokens, lambda words: F.concat(*[runs(words, n) for n in sizes]))


def char_ngrams(text: Column, sizes: tuple[int, ...]) -> Column:
    """Overlapping code-point runs. A look-ahead reads each run while the match advances by one code point, which
    avoids a ``substring`` that would rescan the text for every start."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)) for n in sizes])


def counted(terms: Column) -> Column:
    """Distinct terms with their counts, ``ARRAY<STRUCT<term, tf>>``: sort the row's terms, keep the run starts.

    Counting inside the row needs no grouping, so nothing is hashed, spilled or shuffled for it.
    """

    def runs(ordered: Column) -> Column:
        changes = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1),
                           lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return let(changes, lambda starts: F.transform(starts, lambda start, j: F.struct(
            F.get(ordered, start).alias("term"),
            (F.coalesce(F.get(starts, j + 1), F.size(ordered)) - start).cast("bigint").alias("tf"))))

    nothing = F.expr("CAST(array() AS ARRAY<STRUCT<term: STRING, tf: BIGINT>>)")
    return let(F.sort_array(terms), lambda ordered: F.when(F.size(ordered) > 0, runs(ordered)).otherwise(nothing))
