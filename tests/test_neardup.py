import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptsieve.operators import neardup, split

WORDS = [f"w{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, base, n):
    words = base.split(" ")
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.random()}"
    return " ".join(words)


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(texts):
    """Partition of the positions by reachability over pairs of similarity 0.8, all pairs tried."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or (a and b and 100 * len(a & b) >= 80 * len(a | b)):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return partition({i: root(i) for i in range(len(texts))})


def partition(key_of):
    groups = {}
    for i, k in key_of.items():
        groups.setdefault(k, set()).add(i)
    return {frozenset(g) for g in groups.values()}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string")


def grouped(df):
    return partition({r.row_id: r.group_key for r in neardup.with_family(df).collect()})


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    out = []
    for _ in range(12):                         # families around the limit: some members link only through others
        base = text(rng, rng.choice((40, 100, 300)))
        out += [edited(rng, base, rng.randint(0, 4)) for _ in range(8)]
    chain = [text(rng, 120)]
    for _ in range(20):                         # each links with the next one only
        chain.append(edited(rng, chain[-1], 2))
    out += chain + [text(rng, rng.randint(1, 60)) for _ in range(60)]
    out += [out[0]] * 60 + [out[0].upper(), "  " + out[0].replace(" ", "\t\n")]     # a third are copies
    out += [None, "", " \n", "one", "One", "one two three four", "five six seven eight nine", text(rng, 30000)]
    return out


def test_families_equal_all_pairs(spark, corpus):
    got = grouped(frame(spark, corpus))
    assert got == brute(corpus) and len(got) > 60


def test_heads_do_not_decide(spark):
    rng = random.Random(6)
    body, head = text(rng, 200), "licence header " * 12
    texts = ["other start " + body, body, head + text(rng, 200), head + text(rng, 200)]
    assert grouped(frame(spark, texts)) == {frozenset({0, 1}), frozenset({2}), frozenset({3})}
    prefix = split.with_group_key(frame(spark, texts), mode="prefix").collect()
    assert partition({r.row_id: r.group_key for r in prefix}) == {frozenset({0}), frozenset({1}), frozenset({2, 3})}


def test_pairs_grow_with_the_rows(spark):
    rng = random.Random(7)
    base = text(rng, 100)
    made = {}
    for n in (100, 400):
        texts = [edited(rng, base, rng.randint(1, 3)) for _ in range(n)]
        found = neardup.classes(frame(spark, texts)).cache()
        banded = found.select("node", F.explode("bands").alias("band"), F.col("node").alias("label"))
        for turn in (0, 1):
            made[n, turn] = neardup.pivot_pairs(banded, turn).count()
            assert made[n, turn] <= neardup.BANDS * n
    assert neardup.families(frame(spark, texts)).groupBy("label").count().count() <= 3
    assert made[400, 0] <= 6 * made[100, 0]


def test_recall_of_the_bands(spark):
    """Pairs just above the limit share a band."""
    rng = random.Random(8)
    texts = []
    for k in range(150):
        base = text(rng, 90)
        texts += [base, edited(rng, base, 1 + k % 2)]
    close = {i for i in range(0, 300, 2) if 100 * len(shingles(texts[i]) & shingles(texts[i + 1]))
             >= 80 * len(shingles(texts[i]) | shingles(texts[i + 1]))}
    keys = {r.row_id: r.group_key for r in neardup.with_family(frame(spark, texts)).collect()}
    assert len(close) > 80 and all((keys[i] == keys[i + 1]) == (i in close) for i in range(0, 300, 2))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(100, 164)] + [(7, 3), (3, 7), (9, 7)], "u bigint, v bigint")
    labels = {r.node: r.label for r in neardup.components(links).collect()}
    assert labels == {i: 100 for i in range(100, 165)} | {3: 3, 7: 3, 9: 3}


def test_empty_table_and_split(spark):
    empty = spark.createDataFrame([], "row_id bigint, text string, label int")
    assert neardup.with_family(empty).collect() == []
    assert split.assign_split(empty).collect() == []
    with pytest.raises(ValueError):
        split.with_group_key(empty, mode="other")


def test_a_family_stays_in_one_split(spark):
    rng = random.Random(9)
    data = []
    for g in range(60):
        base = text(rng, 80)
        data += [(f"opening {k} of its own " + edited(rng, base, k % 2), g % 3) for k in range(4)]
    df = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(data)], "row_id bigint, text string, label int")
    placed = split.assign_split(df).collect()
    assert max(Counter(g for g, _ in {(r.row_id // 4, r.split) for r in placed}).values()) == 1


def crowded(rng, families, members, edits):
    """Families that share a long passage, so that a band holds many of them and no two of them link."""
    passage = text(rng, 150)
    out = []
    for _ in range(families):
        base = passage + " " + text(rng, 60)
        out += [base] + [edited(rng, base, edits) for _ in range(members - 1)]
    return out


def test_sets_of_unlike_classes_stay_where_they_are(spark, monkeypatch):
    """Crowded bands pair many classes that do not link; few of these pairs are compared by their sets."""
    texts, tried, verified = crowded(random.Random(10), 60, 1, 0), [], neardup.verified

    def counting(pairs, sets, *rest):
        tried.append(pairs.count())
        return verified(pairs, sets, *rest)

    monkeypatch.setattr(neardup, "verified", counting)
    assert grouped(frame(spark, texts)) == {frozenset({i}) for i in range(60)}
    assert brute(texts) == {frozenset({i}) for i in range(60)}
    assert sum(tried) <= 10


def test_families_beside_large_ones(spark):
    """What is left of a band beside a large family meets all of it at once."""
    rng = random.Random(11)
    texts = crowded(rng, 4, 2, 2) + crowded(rng, 1, 50, 1)
    assert grouped(frame(spark, texts)) == brute(texts)


def test_sketches_rule_out_no_link():
    rng = random.Random(12)
    for size in (1, 4, 5, 30, 300, 4000):
        base = text(rng, size)
        for edits in (0, 1, size // 60, size // 25, size // 8):
            a, b = (neardup.shingle_hashes(t.encode()) for t in (base, edited(rng, base, min(edits, size))))
            common = len(set(a.tolist()) & set(b.tolist()))
            assert len(a) == len(shingles(base))
            apart = sum(int(x).bit_count() for x in (neardup.sketch(a) ^ neardup.sketch(b)).view("uint64"))
            assert apart <= len(a) + len(b) - 2 * common
            if 100 * common >= 80 * (len(a) + len(b) - common):
                assert 180 * apart <= 20 * (len(a) + len(b))


def test_sets_are_made_of_classes_that_share_a_band(spark, monkeypatch):
    """Sets of other classes are neither stored nor moved."""
    rng, stored, materialized = random.Random(13), [], neardup.materialized
    base = text(rng, 200)
    near = [base, edited(rng, base, 1)]

    def counting(df, name):
        out = materialized(df, name)
        if "hashes" in out.columns:
            stored.append(out.agg(F.sum(F.size("hashes"))).first()[0])
        return out

    monkeypatch.setattr(neardup, "materialized", counting)
    got = grouped(frame(spark, near + near[:1] * 5 + [text(rng, 300) for _ in range(60)]))
    assert frozenset(range(7)) in got and len(got) == 61
    assert sum(stored) == sum(len(shingles(t)) for t in near)


def test_many_pairs_of_few_classes_move_few_sets(spark, monkeypatch, capsys):
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 10)
    pairs = spark.createDataFrame([(i, j) for i in range(5) for j in range(i)], "node bigint, pivot bigint")
    sets = spark.createDataFrame([(i, [i % 2, 7, 8, 9, 10]) for i in range(50)], "node bigint, hashes array<bigint>")
    links = neardup.verified(pairs, sets, 100)
    links.explain()
    assert capsys.readouterr().out.count("LeftSemi") == 2       # one on either side
    assert {(r.u, r.v) for r in links.collect()} == {(0, 2), (0, 4), (2, 4), (1, 3)}


def test_texts_of_single_blanks_need_no_replacement(spark):
    """The canonical form is the same whether or not a text passes the test for other white space."""
    texts = ["", None, "a b", " A b ", "a  b", "a\tb", "a \n b", "a b", "a 　b", "\x1fa", "İ x", "a\x00b", "  ", "\x85"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), f"[{neardup.WHITESPACE}]+", " "))
    got = df.select(neardup.canonical(F.col("text")).alias("c"), whole.alias("w")).collect()
    assert [r.c for r in got] == [r.w for r in got]
    blocked = neardup.band_keys(np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert neardup.BLOCK * neardup.BANDS * neardup.BAND_ROWS * 8 <= 1 << 18 and blocked.shape == (neardup.BANDS,)
