"""Packing, whitening and phrase mining against brute force, and on odd inputs."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promptsieve.llm import packing, phrases, whitening

SF_DIR = "/root/testdata/sf0.001"
LOW = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


# ---- packing

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.default_tokenizer())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def check_sequences(rows, capacity):
    """Pieces fill their sequences from 0 on without a gap."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_words_give_the_ids_of_the_whole_text(tokenizer):
    rng = random.Random(1)
    signs = ["a", "Ab", "ß", "Σ", "é", "é", "́", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0",
             " ", " ", "　", "​", "'s", "'", "12", "३", "<|endoftext|>", "<|startoftext|>", "...", "😀", "한", "하"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(0, 30))) for _ in range(3000)]
    texts += ["don't I'LL 'sup we're.'s x'd'D '' 1234 a1b2 <|endoftext|>x <|EndOfText|> ~\x7f\x01 _-_ (Word),",
              "".join(map(chr, range(0x21, 0x250))), *map(chr, range(0x21, 0x250)), "ÀÉÎÕÜßÿ Œuvre L'ÉTÉ d'où ×÷ é́x École"]
    with open(packing.default_tokenizer()) as f:
        encoder = packing.Encoder(f.read())
    assert encoder.plain
    ids, bounds = packing.encoded(encoder, pa.array(texts))
    for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_are_the_documents_ids(docs, tokenizer):
    rows = packing.pack(docs).collect()
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id].append(r)
    for d in docs.collect():
        ids, pieces = ids_of(tokenizer, d.text), sorted(found.pop(d.doc_id), key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // 4096)))
        for r in pieces:
            part = ids[r.start:r.start + r.length]
            assert r.start == 4096 * r.piece and r.length == len(ids[4096 * r.piece:4096 * (r.piece + 1)])
            assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    assert not found
    n = check_sequences(rows, 4096)
    assert n == packing.certificate(packing.pack(docs))[0] <= packing.certificate(packing.pack(docs))[1] + 1


def fewest(lengths, capacity):
    """Bins of the best packing, by trying every place."""
    best = [len(lengths)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room >= lengths[i]:
                k = bins.index(room)
                put(i + 1, bins[:k] + [room - lengths[i]] + bins[k + 1:])
        put(i + 1, bins + [capacity - lengths[i]])
    put(0, [])
    return best[0]


def test_bounds_and_bins_around_the_optimum():
    rng = random.Random(2)
    tight = 0
    for _ in range(150):
        capacity = rng.choice([10, 16, 30])
        lengths = sorted((rng.randrange(1, capacity) for _ in range(rng.randrange(1, 10))), reverse=True)
        bound = packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        best = fewest(lengths, capacity)
        place, offset, n = packing.best_fit(lengths, capacity)
        assert math.ceil(bound) <= best <= n
        assert bound >= Fraction(sum(lengths), capacity)
        tight += math.ceil(bound) == best
        order = sorted(zip(place.tolist(), offset.tolist(), lengths))
        for _, parts in itertools.groupby(order, key=lambda x: x[0]):
            at = 0
            for _, o, s in parts:
                assert o == at
                at += s
            assert at <= capacity
    assert tight >= 135


@pytest.mark.parametrize("kind", ["small", "mixed", "thirds", "large"])
def test_partitions_exchange_what_their_bounds_leave(spark, kind):
    rng = random.Random(3)
    draw = {"small": lambda: rng.randrange(1, 300), "mixed": lambda: min(999, int(rng.paretovariate(0.7) * 20)),
            "thirds": lambda: rng.randrange(200, 420), "large": lambda: rng.randrange(400, 900)}[kind]
    lengths = [draw() for _ in range(6000)]
    cuts = spark.createDataFrame([(i % 50, 0, 0, s, i) for i, s in enumerate(lengths)], packing._PIECE)
    placed = packing.packed(cuts, 1000, partition_pieces=500)
    rows = placed.collect()
    assert Counter((r.doc_id, r.ids_crc32, r.length) for r in rows) == Counter((i % 50, i, s) for i, s in enumerate(lengths))
    n = check_sequences(rows, 1000)
    whole = packing.best_fit(sorted(lengths, reverse=True), 1000)[2]
    found, bound = packing.certificate(placed, 1000)
    assert found == n and bound <= n <= whole * 1.005 + 1      # as good as best-fit decreasing over all pieces at once
    if kind in ("small", "large"):
        assert n <= bound * 1.002 + 1
    assert [(r.sequence_id, r.offset) for r in packing.packed(cuts, 1000, partition_pieces=500).orderBy("ids_crc32").collect()] \
        == [(r.sequence_id, r.offset) for r in sorted(rows, key=lambda r: r.ids_crc32)]


def test_packing_of_odd_rows(odd, tokenizer):
    rows = packing.pack(odd).collect()
    assert check_sequences(rows, 4096)
    want = Counter((d.doc_id, -(-len(ids_of(tokenizer, d.text)) // 4096)) for d in odd.collect())
    assert Counter((r.doc_id, 0) for r in rows) == Counter(
        {(i, 0): sum(k * n for (j, k), n in want.items() if j == i) for i in {j for j, _ in want}})
    assert sum(r.length == 1 for r in rows) >= 4            # null, empty and blank texts
    empty = packing.pack(odd.limit(0))
    assert empty.count() == 0 and empty.columns[-2:] == ["sequence_id", "offset"]


def test_sequences_hold_the_ids(odd, tokenizer):
    texts = defaultdict(list)
    for d in odd.collect():
        texts[d.doc_id].append(ids_of(tokenizer, d.text))
    total = 0
    for s in packing.sequences(odd).collect():
        ids = np.frombuffer(s.ids, dtype="<u4").tolist()
        assert len(ids) <= 4096 and sum(p.length for p in s.documents) == len(ids)
        total += len(ids)
        for p in s.documents:
            part = ids[p.offset:p.offset + p.length]
            assert any(part == t[4096 * p.piece:4096 * p.piece + 4096] for t in texts[p.doc_id])
    assert total == sum(len(t) for ts in texts.values() for t in ts)


# ---- whitening

def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 1) for i, v in rows],
                                 "vec_id bigint, embedding array<float>, n int, component int")


def check_whitening(got, rows, k):
    """Against the eigenvectors of the covariance of the same whole numbers (from the rows' singular vectors, which keep
    small ones exact)."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows], dtype=np.int64)
    n, s = len(x), x.sum(axis=0)
    a = (n * x - s) / n
    _, sigma, v = np.linalg.svd(a, full_matrices=False)
    e, v = sigma ** 2 / n, v.T
    want = a @ v / np.sqrt(np.where(e > 0, e, 1))
    deviations = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s)) for row in x]
    deviations = [d if d < 1 << 63 else None for d in deviations]
    out = defaultdict(list)
    for r in got:
        out[r.vec_id].append(r)
    w = np.zeros((n, k))
    for at, (i, _) in enumerate(rows):
        mine = sorted(out[i], key=lambda r: r.component)
        assert [r.component for r in mine] == list(range(1, k + 1))
        assert {r.n for r in mine} == {n} and {r.deviation for r in mine} == {deviations[at]}
        w[at] = [r.whitened for r in mine]
        assert np.allclose([r.explained for r in mine], e[:k] / e.sum(), rtol=1e-6)
    for c in range(k):
        sign = np.sign(w[:, c] @ want[:, c])
        assert np.allclose(w[:, c] * sign, want[:, c], atol=1e-6)
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9 and {r.identity_error for r in got} == {got[0].identity_error}
    assert got[0].identity_error < 1e-9


def test_whitening_equals_the_eigenvectors(spark):
    df = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    check_whitening(whitening.whitened(df.repartition(5)).collect(), [(r.vec_id, r.embedding) for r in df.collect()], 8)


def test_whitening_of_ill_conditioned_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=12) * 10.0 ** np.arange(4, -8, -1) + 500]) for i in range(400)]
    check_whitening(whitening.whitened(table(spark, rows)).collect(), rows, 8)


def test_whitening_without_some_directions(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        a, b, c = (float(x) for x in rng.integers(-500, 500, 3) / 4)
        rows.append((i, [a, b, c, a, 7.0, a + b, b - c, 0.0, 0.0, 2 * c]))
    check_whitening(whitening.whitened(table(spark, rows)).collect(), rows, 3)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(6)
    good = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(20)]
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, [None, 1.0, 1.0, 1.0, 1.0]), (102, [nan, 1.0, 1.0, 1.0, 1.0]), (103, [1.0, inf, 1.0, 1.0, 1.0]),
           (104, [1.0, -inf, 1.0, 1.0, 1.0]), (105, [1.0, 2.0]), (106, [])]
    check_whitening(whitening.whitened(table(spark, good + bad)).collect(), good, 5)
    twice = whitening.whitened(table(spark, [*good, (3, [0.5] * 5), (None, [0.25] * 5), (None, None)])).collect()
    assert Counter(r.vec_id for r in twice) == Counter({None: 5, 3: 10, **{i: 5 for i in range(20) if i != 3}})
    for few in ([], good[:1], [good[0]] * 9, [(1, None)], [(1, [])]):
        df = whitening.whitened(table(spark, few))
        assert df.count() == 0 and df.columns == whitening.whitened(table(spark, good)).columns
    wide = table(spark, good).withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert whitening.whitened(wide).count() == 100
    far = [(i, [1e30 * (-1) ** i, float(i)]) for i in range(4)]
    assert {r.deviation for r in whitening.whitened(table(spark, far)).collect()} == {None}


# ---- phrases

def brute_phrases(rows, min_count, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 6):
                counts[lang].update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        f = {p: a for p, a in f.items() if a >= min_count}
        inside = set()
        for q, b in f.items():
            for n in range(2, len(q)):
                inside |= {q[i:i + n] for i in range(len(q) - n + 1) if 100 * b >= 100 * f[q[i:i + n]]}
        kept = []
        for p, a in f.items():
            if len(p) > 1 and p not in inside:
                score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return Counter(out)


def mined(df, *args):
    return Counter(tuple(r) for r in phrases.collocations(df, *args).collect())


def test_phrases_equal_brute_force(docs):
    rows = [(r.lang, r.text) for r in docs.collect()]
    want = brute_phrases(rows, 8, 2000)
    assert mined(docs, 8) == want and len(want) > 300
    assert mined(docs.repartition(7), 8, 25) == brute_phrases(rows, 8, 25)


def test_phrases_of_hot_prefixes_and_small_stripes(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD_ENTRIES", 50)
    monkeypatch.setattr(phrases, "HELD_WORDS", 20)
    monkeypatch.setattr(phrases, "HOT_PARTS", 20)
    monkeypatch.setattr(phrases, "MAX_BITS", 16)
    rng = random.Random(7)
    words = ["the"] * 12 + [f"w{i}" for i in range(40)] + ["THE", "a.b", "x;", "é", "　", "1"]
    rows = [(rng.choice(["en", "de", None, "und"]), rng.choice([" ", "\t", "  "]).join(rng.choices(words, k=rng.randrange(0, 60))))
            for _ in range(400)]
    rows += [("en", "many a true word, many a true word")] * 30 + [(None, "")] * 3 + [("fr", None)] * 2
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = brute_phrases(rows, 5, 2000)
    assert mined(df, 5) == want and len(want) > 200


def test_phrases_on_odd_rows(odd):
    assert mined(odd, 3) == brute_phrases([(r.lang, r.text) for r in odd.collect()], 3, 2000)
    assert phrases.collocations(odd.limit(0)).count() == 0
    assert phrases.collocations(odd.select("lang", F.lit(None).cast("string").alias("text"))).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right, n = 3 * 10 ** 12 + 7, 4 * 10 ** 12 + 1, 5 * 10 ** 12 + 3, 9 * 10 ** 15 + 11
    rows = [("en", "x", 1, left), ("en", "y", 1, right), ("en", "x y", 2, a)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, n_words int, a bigint"),
                         spark.createDataFrame([("en", n)], "lang string, n bigint")).collect()
    assert [r.score for r in got] == [1000 * a * n // (left * right)]
