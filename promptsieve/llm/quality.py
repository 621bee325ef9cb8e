"""Quality rules with cross-document line frequency.

Per document, inside the row: counts of words, word characters, symbols, repeated lines and repeated five-word windows.
Across documents: normalised lines are hashed, the distinct documents that hold a line are counted per host, and lines
above the host's limit are removed. A document that keeps too few of its words is depleted and rejected.

A document stands for its copies: the set of its lines names it, so copies with the same lines count once however many they
are, and different documents count each.

Edge cases: a null or empty text has no words and fails the base rules; a null source is a host of its own; rows that
repeat an id are judged each by its own text; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsieve.llm.common import SPACE, cut, small, with_side

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MAX_DOCUMENTS = 20      # documents of a host that may share a line ...
MAX_SHARE_PERCENT = 2   # ... or this share of the host's documents, whichever is more,
MAX_LIMIT = 1000        # but never more than so many
MIN_LEFT_PERCENT = 10   # of its words that a document must keep


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in the array; every position counts once.

    Only arrays whose window hashes aren't distinct are sorted. Sorted (hash, position) pairs show repeats as neighbours, so
    the work stays n log n on texts of any length.
    """
    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window),
                           lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def flagged(s: Column) -> Column:
            return F.array_sort(F.transform(
                F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))
                         | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))
        at = _let(pairs, flagged)
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                           lambda acc, p: F.struct((acc["n"] + p + window - F.greatest(acc["end"], p)).alias("n"),
                                                   (p + window).alias("end")))["n"]

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
    return F.when(F.size(words) < 2 * 1 + window - 1, F.lit(0)).otherwise(_let(hashes(words), counted)).cast("bigint")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def line_hash(line: Column) -> Column:
    """60 bits of the line in lower case, with white space collapsed."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(line, f"[{SPACE}]+", " "), "^ | $", ""))
    return F.conv(F.substring(F.md5(plain), 1, 15), 16, 10).cast("bigint")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, host, counts, lines): ``lines`` holds (h, n_words) of every line with a word."""
    split = (docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("source").alias("host"), F.coalesce("text", F.lit("")).alias("_text"))
             .withColumns({"_words": F.array_remove(F.split("_text", f"[{SPACE}]+"), ""),
                           "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))}))
    n_words = F.size("_words").cast("bigint")
    return split.select(
        "doc_id", "text_hash", "host", n_words.alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.size(F.split("_text", f"[{SYMBOLS}]", -1)) - 1).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.transform("_lines", lambda x: F.struct(
            line_hash(x).alias("h"), F.regexp_count(x, F.lit(f"[^{SPACE}]+")).alias("n"))).alias("lines"))


def common_lines(rows: DataFrame, max_documents: int = MAX_DOCUMENTS,
                 max_share_percent: int = MAX_SHARE_PERCENT) -> DataFrame:
    """(host, h): lines that more documents of the host hold than its limit. Counts are summed map-side first."""
    held = rows.select("host", F.array_distinct(F.col("lines.h")).alias("_h"))
    held = held.select("host", F.xxhash64(F.array_sort("_h")).alias("_doc"), F.explode("_h").alias("h"))
    lines = held.groupBy("host", "h").agg(F.countDistinct("_doc").alias("n"))
    hosts = rows.groupBy("host").agg(F.count("*").alias("_n")).withColumnRenamed("host", "_host")
    share = F.least(F.lit(MAX_LIMIT), F.floor(F.col("_n") * max_share_percent / 100))
    limit = F.greatest(F.lit(max_documents), share)
    above = lines.where(F.col("n") > max_documents)
    return above.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).where(F.col("n") > limit).select("host", "h")


def judged(docs: DataFrame, **limits) -> DataFrame:
    """One row per row of ``docs``: the counts, ``base_failed``, ``n_left`` words after line removal, and ``kept``."""
    return _judged(docs, **limits).drop("text_hash", "host", "removed")


def _judged(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, max_share_percent: int = MAX_SHARE_PERCENT,
            min_left_percent: int = MIN_LEFT_PERCENT) -> DataFrame:
    rows = cut(measured(docs))
    common = small(cut(common_lines(rows, max_documents, max_share_percent))
                   .select(F.col("host").alias("_host"), F.col("h").alias("_h")))
    # rows may repeat an id: each is named by its partition and place
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    removed = (rows.select("_row", "host", F.explode("lines").alias("_line"))
               .join(common, F.col("host").eqNullSafe(F.col("_host")) & (F.col("_line.h") == F.col("_h")))
               .groupBy("_row").agg(F.sum("_line.n").alias("_removed"), F.collect_set("_h").alias("removed")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    n_left = F.col("n_words") - F.coalesce("_removed", F.lit(0))
    depleted = (n_left < MIN_WORDS) | (100 * n_left < min_left_percent * F.col("n_words"))
    return rows.drop("lines").join(removed, "_row", "left").select(
        "doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        n_left.cast("bigint").alias("n_left"), (~failed & ~depleted).alias("kept"), "host", "removed")


def without_lines(text: Column, removed: Column) -> Column:
    """``text`` without the lines whose hash is in ``removed``; the others stay as they are and in order."""
    gone = lambda x: x.rlike(f"[^{SPACE}]") & F.array_contains(removed, line_hash(x))
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~gone(x)), "\n")


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns; ``text`` is without the host's common lines, so its length
    may differ from what another column says."""
    marked = _judged(docs).where(~F.col("kept") | F.col("removed").isNotNull()).select(
        "doc_id", "text_hash", "host", "kept", F.array_sort("removed").alias("removed")).distinct()
    rows = with_side(docs, small(cut(marked)), "left", F.col("docs.source").eqNullSafe(F.col("side.host")))
    old, removed = F.col("docs.text"), F.col("side.removed")
    text = F.when(removed.isNotNull(), without_lines(old, removed)).otherwise(old)
    return rows.where(F.coalesce("side.kept", F.lit(True))).select(
        *[text.alias(c) if c == "text" else F.col(f"docs.`{c}`") for c in docs.columns])
