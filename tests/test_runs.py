"""Counting runs of many rows at once, and TF-IDF without a shuffle of terms."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promptsieve.functions import runs as rr
from promptsieve.functions.text import SPACES, word_tokens
from promptsieve.operators import importance, similarity, tfidf
from promptsieve.operators.tfidf import CHAR_BLOCK, WORD_BLOCK, TermSpec
from promptsieve.plans import experiment

ROWS = ["abcabc", "", "bcabca", "x", "aaaaa", "ünï😀ünï😀"]


@pytest.mark.parametrize("max_code", [1 << 62, 1 << 12])     # the small one makes runs give way to ranks
def test_runs_match_brute_force(monkeypatch, max_code):
    monkeypatch.setattr(rr, "MAX_CODE", max_code)
    points = np.array([ord(c) for c in "".join(ROWS)])
    letters, symbols = np.unique(points, return_inverse=True)
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in ROWS])))
    for size, codes, row, coder in rr.runs(symbols, bounds, len(letters), (1, 3, 4)):
        code, start, rows, tf = rr.distinct(codes, row, len(ROWS))
        parts = np.stack(coder.symbols(code), axis=1)
        assert (coder.codes(parts) == code).all()
        got = {(r, "".join(chr(p) for p in letters[parts[k]])): n for k in range(len(code))
               for r, n in zip(rows[start[k]:start[k + 1]], tf[start[k]:start[k + 1]])}
        assert got == Counter((i, t[k:k + size]) for i, t in enumerate(ROWS) for k in range(len(t) - size + 1))
    assert (coder.codes(np.array([[-1, 0, 0, 0]])) == -1).all()


def test_chunks_cover_all_rows(monkeypatch):
    monkeypatch.setattr(rr, "CHUNK_SYMBOLS", 10)
    monkeypatch.setattr(rr, "CHUNK_ROWS", 3)
    assert list(rr.chunks(np.array([50, 4, 6, 1, 0, 0, 0, 0, 11]))) == [(0, 1), (1, 3), (3, 6), (6, 8), (8, 9)]
    assert list(rr.chunks(np.zeros(0, dtype=np.int64))) == []


@pytest.mark.parametrize("spec", [WORD_BLOCK, CHAR_BLOCK, TermSpec("long", "char", (2, 7)),
                                  TermSpec("raw", "long_word", (1, 3), sublinear=False, lowercase=True, stop_words=("the",))])
def test_joined_and_sparse_weights_agree(spark, spec):
    """The route for fits of any size gives the same rows."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["the red fox, The red hen", "a red fox runs " * 3, None, "", "ünï 😀😀😀😀 ünï", "the hen sleeps! red fox"])],
        "row_id bigint, text string")
    fitted = tfidf.fit(rows, spec)
    as_dict = lambda df: {(r.row_id, r.block, r.term, r.idx, r.df): round(r.weight, 9) for r in df.collect()}
    assert as_dict(tfidf.weights(rows, fitted, spec)) == as_dict(tfidf.joined_weights(rows, fitted, spec))


def test_weights_neither_sort_nor_shuffle_terms(spark):
    rows = spark.createDataFrame([(i, f"the red fox {i % 3} runs") for i in range(30)], "row_id bigint, text string")
    plan = tfidf.weights(rows, tfidf.fit(rows, CHAR_BLOCK), CHAR_BLOCK)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_tokens_are_those_of_the_pattern(spark):
    texts = ["a_b  c,d!!", "", "x", "y", None, "ünï😀b\u00a0c\u0301 日本語٣", "  lead\ttrail ", "\u2028\u3000", "ab a\u200bb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = [r.w or [] for r in df.select("i", word_tokens(F.col("t")).alias("w")).orderBy("i").collect()]
    symbols, bounds, words = rr.token_symbols(pa.array(texts), rr.kind_table(*rr.kinds(spark)))
    cut = [[words[int(s)].as_py() for s in symbols[bounds[k]:bounds[k + 1]]] for k in range(len(texts))]
    assert cut == want
    symbols, bounds, words = rr.token_symbols(pa.array(texts), rr.kind_table(*rr.kinds(spark)), True, pa.array(["ab"]))
    cut = [[words[int(s)].as_py() for s in symbols[bounds[k]:bounds[k + 1]]] for k in range(len(texts))]
    assert cut == [[w for w in ws if len(w) > 1 and w != "ab"] for ws in want]


def test_spaces_are_the_white_space(spark):
    first, kind = rr.kinds(spark)
    assert set(np.flatnonzero(rr.kind_table(first, kind) == rr.SPACE)) == {32, *map(ord, SPACES)}


def test_nested_attributions_agree_with_flat_ones(spark):
    rows = [(1, 1, [(0, "[CLS]", 9.0, True), (1, "Ignore", 4.0, False), (2, "this", 1.0, False), (3, "that", 1.0, False)]),
            (2, 2, [(0, "ignore", 2.0, False)]), (3, 3, [(0, "##ignore", 0.0, False)]), (4, 0, [(0, "ignore", 5.0, False)]), (5, 1, [])]
    nested = spark.createDataFrame(rows, "row_id bigint, pred int, tokens array<struct<pos: int, token: string, score: double, special: boolean>>")
    flat = importance.flat(nested)
    found = lambda df: sorted(tuple(r) for r in df.collect())
    for fn in (importance.top_tokens_per_prompt, lambda a: importance.mean_importance(a, 1), lambda a: importance.top_tokens(a, 2, 1)):
        assert found(fn(importance.normalized(nested))) == found(fn(importance.normalized(flat)))
    plan = importance.mean_importance(importance.normalized(nested))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_classifier_scores_without_shuffle_and_like_the_joined_route(spark, monkeypatch):
    words = ("red fox runs", "blue hen sleeps!", "grey cat 12 jumps")
    rows = spark.createDataFrame([(i, f"{words[i % 3]} at {i % 7}", i % 3, "val" if i % 5 == 0 else "train") for i in range(90)],
                                 "row_id bigint, text string, label int, split string")
    clf = experiment.train(rows, (TermSpec("word", "token", (1, 2), max_features=30), TermSpec("char", "char", (3,), max_features=20)),
                           candidates=experiment.regularization_grid((1e-2,), 5))
    plan = clf.score(rows, ("label",))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan and "Join" not in plan
    found = lambda: ({r.row_id: (r.label, r.y_pred, [round(p, 9) for p in r.probability]) for r in clf.score(rows, ("label",)).collect()},
                     {(r.row_id, r.rank, r.token): round(r.score, 9) for r in experiment.explain(clf, rows).collect()})
    sparse = found()
    monkeypatch.setattr(tfidf, "BROADCAST_ROWS", 10)
    assert not tfidf.is_bounded(*clf.specs) and found() == sparse and len(sparse[0]) == 90


@pytest.mark.parametrize("chunk", [1, 7, 1 << 22])
def test_best_similarity_in_chunks_equals_the_grid(spark, monkeypatch, chunk):
    monkeypatch.setattr(similarity, "CHUNK_PAIRS", chunk)
    words = "sun moon star cloud rain wind snow leaf tree root".split()
    text = lambda i: " ".join(words[(i * k) % 10] for k in range(1, 2 + i % 6))
    frame = lambda values: spark.createDataFrame(list(enumerate(values)), "row_id bigint, text string")
    refs = similarity.reference_texts(frame([text(i) for i in range(40)] + [""]))
    cands = frame([text(3 * i + 1) + " hill" * (i % 2) for i in range(9)] + ["", None, "lake"])
    found = lambda small: {r.row_id: r.max_sim for r in similarity.max_similarity(cands, refs, small=small).collect()}
    assert found(True) == found(False) and len(found(True)) == 12


def test_scores_of_pairs_are_not_shuffled(spark):
    frame = lambda n: spark.createDataFrame([(i, f"sun moon star{i % 4} cloud") for i in range(n)], "row_id bigint, text string")
    best = similarity.max_similarity(frame(5), similarity.reference_texts(frame(30)), small=True)
    assert "cand_weight" not in best._jdf.queryExecution().optimizedPlan().toString()
