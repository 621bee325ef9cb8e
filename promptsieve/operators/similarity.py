"""TF-IDF cosine join: how close each candidate comes to any reference text.

Reference texts are the large side. They are deduplicated and placed by text hash in one shuffle and stay there while
they are cut into terms, weighted and compared. Candidate postings go to the references when a measured size allows, and
the scores of some references at a time leave only the best per candidate; beyond
that both sides meet on a (term, cell) grid, where frequent terms are cut into cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptsieve.functions import runs as rr
from promptsieve.functions.stopwords import ENGLISH
from promptsieve.operators import tfidf
from promptsieve.operators.lookup import bounded
from promptsieve.operators.tfidf import TermSpec
from promptsieve.session import materialized

MAX_SIM = 0.8
DIGITS = 6                           # scores are rounded before they meet a threshold
BROADCAST_CANDIDATE_CHARS = 4 << 20  # total candidate text up to which postings are broadcast
CHUNK_PAIRS = 1 << 22                # term matches, and scores, that a task holds at once; more only for a single reference
CELL_ROWS = 100_000                  # rows of one term on one side of a grid cell


def similarity_spec(stop_words: tuple[str, ...] | None = None, max_features: int = 200_000) -> TermSpec:
    """Lower-cased words of two or more characters without stop words, uni- and bigrams, raw term counts."""
    words = english_stop_words() if stop_words is None else tuple(stop_words)
    return TermSpec("similarity", "long_word", (1, 2), max_features=max_features, sublinear=False, lowercase=True,
                    stop_words=words)


def english_stop_words() -> tuple[str, ...]:
    return ENGLISH


def reference_texts(*tables: DataFrame) -> DataFrame:
    """Distinct texts of all tables as (row_id, text), placed by ``row_id``, the hash of the text.

    Copies collapse map-side, so a text that fills a third of the input arrives once per map task.
    """
    texts = None
    for t in tables:
        t = t.select("text")
        texts = t if texts is None else texts.unionByName(t)
    return texts.groupBy(F.unhex(F.sha2("text", 256)).alias("row_id")).agg(F.min("text").alias("text"))


def _postings(texts: DataFrame, fitted: DataFrame, spec: TermSpec, name: str, is_placed: bool = False) -> DataFrame:
    return (tfidf.weights(texts, fitted, spec, is_placed=is_placed)
            .select(F.col("row_id").alias(name), "idx", "df", "weight"))


def _prefix(postings: DataFrame, threshold: float) -> DataFrame:
    """Rarest terms of each candidate: what remains after setting aside its most frequent terms while their squared
    weight stays below the threshold squared. A reference beyond the threshold must share one of them."""
    by_frequency = (Window.partitionBy("cand").orderBy(F.desc("df"), "idx")
                    .rowsBetween(Window.unboundedPreceding, 0))
    covered = F.sum(F.col("weight") * F.col("weight")).over(by_frequency)
    return (postings.withColumn("_covered", covered)
            .where(F.col("_covered") > threshold * threshold - 1e-9).drop("_covered"))


def _meet(cands: DataFrame, refs: DataFrame, small: bool, max_terms: int) -> DataFrame:
    """Join postings on the term. A grid splits the references *and* the candidates of a frequent term."""
    right = cands.select("cand", "idx", F.col("weight").alias("cand_weight"))
    if small:
        return refs.join(F.broadcast(right), "idx")
    cuts = (cands.groupBy("idx").agg(F.count("*").alias("_n"), F.max("df").alias("_df"))
            .select("idx", F.ceil(F.col("_df") / CELL_ROWS).cast("int").alias("_r"),
                    F.ceil(F.col("_n") / CELL_ROWS).cast("int").alias("_c")))
    cuts = bounded(cuts, max_terms)  # one row per vocabulary term at most
    left = (refs.join(cuts, "idx")
            .withColumn("_row", F.pmod(F.hash("ref"), F.col("_r")))
            .withColumn("_col", F.explode(F.sequence(F.lit(0), F.col("_c") - 1))))
    right = (right.join(cuts, "idx")
             .withColumn("_col", F.pmod(F.hash("cand"), F.col("_c")))
             .withColumn("_row", F.explode(F.sequence(F.lit(0), F.col("_r") - 1))))
    return (left.drop("_r", "_c").join(right.drop("_r", "_c"), ["idx", "_row", "_col"])
            .drop("_row", "_col"))


def _dot(joined: DataFrame) -> DataFrame:
    return joined.groupBy("ref", "cand").agg(F.sum(F.col("weight") * F.col("cand_weight")).alias("sim"))


def is_small(candidates: DataFrame, limit: int = BROADCAST_CANDIDATE_CHARS) -> bool:
    """Measure the candidate text; its postings number less than its characters."""
    return (candidates.agg(F.sum(F.length("text"))).first()[0] or 0) <= limit


def _best_in_chunks(candidates: DataFrame, refs: DataFrame, fitted: DataFrame, spec: TermSpec) -> DataFrame:
    """(cand, sim): the largest cosine of each candidate that shares a term with a reference. The candidates' postings go to
    the references, whose scores are added up some texts at a time and leave a task as one row per candidate."""
    cands = tfidf.sparse(candidates, fitted, spec).toArrow()
    ids, n = cands["row_id"].combine_chunks(), len(cands)
    lists = cands["indices"].combine_chunks()
    idx = lists.flatten().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(n), rr.sizes_of(lists))
    order = np.argsort(idx, kind="stable")
    owner, weight = owner[order], cands["values"].combine_chunks().flatten().to_numpy()[order]
    start = np.searchsorted(idx[order], np.arange(tfidf.dimension(spec) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(n)
        for batch in batches:
            terms = batch.column("indices").flatten().to_numpy(zero_copy_only=False)
            values = batch.column("values").flatten().to_numpy(zero_copy_only=False)
            sizes = rr.sizes_of(batch.column("indices"))
            ref = np.repeat(np.arange(batch.num_rows), sizes)
            met = start[terms + 1] - start[terms]
            first = 0
            pairs = np.concatenate(([0], np.cumsum(np.bincount(ref, met, batch.num_rows)))).astype(np.int64)
            while first < batch.num_rows:
                end = int(np.searchsorted(pairs, pairs[first] + CHUNK_PAIRS, side="right")) - 1
                end = max(first + 1, min(end, first + max(1, CHUNK_PAIRS // n)))
                at = slice(*np.searchsorted(ref, (first, end)))
                many = met[at]
                posting = np.repeat(start[terms[at]] - np.cumsum(many) + many, many) + np.arange(many.sum())
                cell = np.repeat((ref[at] - first) * n, many) + owner[posting]
                sums = np.bincount(cell, np.repeat(values[at], many) * weight[posting], (end - first) * n)
                np.maximum(best, sums.reshape(end - first, n).max(axis=0), out=best)
                first = end
        found = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(found)), pa.array(best[found])], names=["cand", "sim"])

    schema = T.StructType([T.StructField("cand", candidates.schema["row_id"].dataType), T.StructField("sim", T.DoubleType())])
    if not n:
        return candidates.sparkSession.createDataFrame([], schema)
    return tfidf.sparse(refs, fitted, spec).select("indices", "values").mapInArrow(run, schema)


def max_similarity(candidates: DataFrame, refs: DataFrame, spec: TermSpec | None = None, mode: str = "exact_max",
                   threshold: float = MAX_SIM, small: bool | None = None) -> DataFrame:
    """(row_id, max_sim) for every candidate; ``refs`` comes from ``reference_texts``.

    ``exact_max`` scores every reference that shares a term. ``prune`` scores only references that share a term of
    the candidate's prefix: values beyond the threshold are exact, any other value is only known not to exceed it.
    """
    if mode not in ("exact_max", "prune"):
        raise ValueError(f"unknown mode {mode!r}")
    spec = spec or similarity_spec()
    small = is_small(candidates) if small is None else small
    in_chunks = mode == "exact_max" and small and tfidf.is_bounded(spec)
    if in_chunks:
        refs = materialized(refs, "references")     # read by the fit and by the scores
    fitted = materialized(tfidf.fit(refs, spec), "fitted")
    if not in_chunks:
        cand_postings = _postings(candidates, fitted, spec, "cand")
        ref_postings = _postings(refs, fitted, spec, "ref", is_placed=True).drop("df")
    if in_chunks:
        scores = _best_in_chunks(candidates, refs, fitted, spec)
    elif mode == "exact_max":
        scores = _dot(_meet(cand_postings, ref_postings, small, spec.max_features))
    else:
        # both joins read the references: keep what can meet a candidate, once
        cand_postings = materialized(cand_postings, "candidates")
        terms = bounded(cand_postings.select("idx").distinct(), spec.max_features)
        ref_postings = materialized(ref_postings.join(terms, "idx", "left_semi"), "references")
        pairs = _meet(_prefix(cand_postings, threshold), ref_postings, small,
                      spec.max_features).select("ref", "cand").distinct()
        full = cand_postings.select("cand", "idx", F.col("weight").alias("cand_weight"))
        scores = _dot(pairs.join(ref_postings, "ref")
                      .join(F.broadcast(full) if small else full, ["cand", "idx"]))
    best = scores.groupBy("cand").agg(F.max("sim").alias("_best"))
    return (candidates.select("row_id")
            .join(best.withColumnRenamed("cand", "row_id"), "row_id", "left")
            .select("row_id", F.round(F.coalesce("_best", F.lit(0.0)), DIGITS).alias("max_sim")))


def similarity_filter(candidates: DataFrame, refs: DataFrame, max_sim: float = MAX_SIM, mode: str = "exact_max",
                      spec: TermSpec | None = None, small: bool | None = None) -> DataFrame:
    """Candidates with ``max_sim`` and ``keep``; near-copies of a reference have ``keep = false``."""
    scored = max_similarity(candidates, refs, spec, mode, max_sim, small)
    return candidates.join(scored, "row_id").withColumn("keep", F.col("max_sim") <= max_sim)


def dropped_count(filtered: DataFrame) -> DataFrame:
    return filtered.agg(F.count_if(~F.col("keep")).alias("n_dropped"), F.count_if(F.col("keep")).alias("n_kept"))
