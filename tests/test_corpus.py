from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promptsieve.functions.codecs import TRAIN_CODECS, ArrowCodec
from promptsieve.functions.draws import digest
from promptsieve.operators import augment, dedup, generate, lookup, split
from promptsieve.operators.lookup import skew_safe_lookup
from promptsieve.operators.ranking import bucketed_rank, exact_sample, top_by_count
from promptsieve.plans import catalog, corpus, novel


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def raw(spark, data):
    return spark.createDataFrame([(0, i, t, l, "s") for i, (t, l) in enumerate(data)],
                                 "source_rank INT, row_id BIGINT, text STRING, label INT, source STRING")


def test_conflicts_and_duplicates(spark):
    data = [("Hello there", 0), ("hello  THERE", 1), ("twice", 2), ("Twice", 2), (None, 0), ("", 0), ("ab", 0), ("abc", 3)]
    clean, stats = corpus.consolidate(raw(spark, data))
    assert rows(clean, "text", "label") == [("abc", 3), ("twice", 2)]
    s = {(r.metric, r.name): r.n for r in stats.collect()}
    assert s[("rows_before_cleaning", "")] == 8 and s[("rows_after_cleaning", "")] == 2
    assert s[("conflicting_label_rows_dropped", "")] == 2 and s[("per_class", "obfuscation")] == 1


def test_dominant_text_collapses_before_the_shuffle(spark):
    df = spark.range(9000).select(F.lit(0).alias("source_rank"), F.col("id").alias("row_id"),
                                  F.when(F.col("id") % 3 == 0, "copy").otherwise(F.concat(F.lit("t"), "id")).alias("text"),
                                  F.lit(1).alias("label"), F.lit("s").alias("source"))
    groups = dedup.text_groups(df)
    assert dedup.consolidated(groups).count() == 6001
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and plan.count("Exchange") == 1


def test_unseen(spark):
    seen, new = raw(spark, [("Old", 0)]), raw(spark, [("old", 0), ("fresh", 1)])
    assert rows(dedup.unseen(new, seen), "text") == [("fresh",)]


def test_exact_sample_matches_global_ranking(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("g"))
    ranked = [r[0] for r in df.orderBy(digest(42, "sample", F.col("row_id")), "row_id").select("row_id").collect()]
    for n in (0, 1, 777, 5000, 9999):
        assert rows(exact_sample(df, "row_id", n=n), "row_id") == sorted((i,) for i in ranked[:n])
    shares = Counter(r.g for r in exact_sample(df, "row_id", frac=0.1, by="g", strata=(0, 1)).collect())
    assert shares == {0: int(1667 * 0.1), 1: int(1667 * 0.1)}
    assert rows(exact_sample(df.repartition(17), "row_id", n=50), "row_id") == rows(
        exact_sample(df.repartition(1), "row_id", n=50), "row_id")
    with pytest.raises(ValueError):
        exact_sample(df, "row_id")


def test_bucketed_rank_equals_row_number(spark):
    df = spark.range(3000).select("id", (F.col("id") % 4).alias("s"), digest(1, "r", F.col("id")).alias("d"))
    ranked = {r.id: r["rank"] for r in bucketed_rank(df, ["s"], "d", "id", digits=2).collect()}
    expected = [r.id for r in df.orderBy("s", "d", "id").collect()]
    assert ranked == {v: i + 1 for i, v in enumerate(expected)}


def test_top_by_count(spark):
    df = spark.range(1, 2000).select("id", (F.col("id") % 97 + 1).alias("n"))
    got = [(r.id, r.n) for r in top_by_count(df, "n", 60, "id").collect()]
    assert got == sorted([(r.id, r.n) for r in df.collect()], key=lambda p: (-p[1], p[0]))[:60]


def test_skewed_lookup_routes_hot_keys(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        (F.col("id") % 50).cast("string")).alias("k"))
    dim = df.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.concat(F.lit("v"), "k"))
    got = skew_safe_lookup(df, dim, "k", "v", "n", F.col("row_id"), hot_rows=500)
    assert got.where("v = concat('v', k)").count() == 3000 and got.columns == ["k", "row_id", "v"]


def families(spark):
    data = [(f"family {g} with its own stem for grouping of near copies {g * 7919} " + "x" * 60 + f" copy {k}", g % 3)
            for g in range(300) for k in range(3)]
    return spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(data)], "row_id BIGINT, text STRING, label INT")


def test_split_keeps_groups_whole_and_folds_level(spark):
    placed = split.assign_split(families(spark)).collect()
    folds, sizes = defaultdict(set), Counter()
    for r in placed:
        folds[r.group_key].add(r.fold)
        sizes[r.fold, r.label] += 1
    assert len(folds) == 300 and all(len(f) == 1 for f in folds.values())
    for label in range(3):
        per_fold = [sizes[f, label] for f in range(20)]
        assert max(per_fold) - min(per_fold) <= 3
    assert Counter(r.split for r in placed) == {"train": 630, "val": 135, "test": 135}


def test_split_does_not_depend_on_partitions_or_routes(spark):
    df = families(spark)
    base = rows(split.assign_split(df.repartition(1)), "row_id", "fold")
    assert rows(split.assign_split(df.repartition(17)), "row_id", "fold") == base
    assert rows(split.assign_split(df, hot_rows=3), "row_id", "fold") == base


@pytest.fixture
def no_small_tables(spark):
    """Tables are as if too large for Spark to broadcast them unasked."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_does_not_move_texts_for_few_groups(spark, monkeypatch, no_small_tables):
    df = families(spark)
    placed = split.assign_split(df)
    assert "hashpartitioning" not in plan(placed) and "SortMergeJoin" not in plan(placed)
    base = rows(placed, "row_id", "fold")
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)    # more groups than that: their rows are routed
    for hot_rows in (3, 1000):
        routed = split.assign_split(df, hot_rows=hot_rows)
        assert "hashpartitioning" in plan(routed) and rows(routed, "row_id", "fold") == base


@pytest.fixture
def tables(spark, tmp_path):
    text = lambda i: f"note {i // 2} " + " ".join(f"w{(i // 2) * 37 % 101 + k}" for k in range(30)) + (" idiot." if i % 3 else " mild.")
    docs = [(i, text(i), "src") for i in range(40)]
    judged = [(i, i % 2, int(i % 5 == 0)) for i in range(30)] + [(1, 1, 0), (3, 0, 1), (33, 1, 0), (33, 1, 0), (34, None, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(judged, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_prompts_bring_judgements_to_the_texts(spark, tables, no_small_tables):
    got = catalog.prompts(spark, tables)
    assert "SortMergeJoin" not in plan(got)
    label = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0).alias("label")
    want = catalog.judged(spark, tables).select("doc_id", label, "text", "source")
    assert rows(got, "row_id", "label", "text", "source") == rows(want, "doc_id", "label", "text", "source")
    assert got.count() == 43        # documents that were judged twice come twice


@pytest.fixture
def stored(monkeypatch):
    """Columns of the tables that the queries store beside those of the split itself."""
    found, materialized = [], catalog.materialized

    def recording(df, name):
        found.append(set(df.columns))
        return materialized(df, name)

    monkeypatch.setattr(catalog, "materialized", recording)
    return found


@pytest.mark.parametrize("name", ["q_split", "q_split_stats", "q_split_leakage", "q_stats_round_trip"])
def test_summaries_of_the_split_store_no_texts(spark, tables, stored, name):
    assert catalog.QUERIES[name](spark, tables).count() > 0
    assert len(stored) == 1 and "text" not in stored[0]


@pytest.mark.parametrize("name", ["q_confusion", "q_macro_metrics", "q_binary_metrics", "q_security_metrics", "q_class_report",
                                  "q_compare", "q_gap"])
def test_judged_rules_store_no_texts(spark, tables, stored, name):
    assert catalog.QUERIES[name](spark, tables).count() > 0
    assert len(stored) == 1 and "text" not in stored[0]


@pytest.mark.parametrize("name", ["q_encode", "q_tfidf_transform"])
def test_features_store_what_they_read(spark, tables, stored, name):
    assert catalog.QUERIES[name](spark, tables).count() > 0
    assert stored[0] == {"split", "row_id", "text"}


def test_splits_are_written_once(spark, tables, stored):
    assert catalog.q_splits_round_trip(spark, tables).count() == 43
    assert stored == []


def test_leakage_summary(spark):
    placed = split.assign_split(families(spark))
    assert tuple(split.split_leakage(placed).first()) == (300, 0, 900, 0)
    broken = placed.withColumn("split", F.when(F.col("row_id") == 0, "test").when(F.col("row_id") == 1, "val")
                               .otherwise(F.col("split")))
    assert split.split_leakage(broken).first().n_leaking_groups == 1


def test_augment_counts(spark):
    data = [("attack number %d in plain words" % i, 1 if i < 25 else 2) for i in range(50)] + [("hello there", 0)] * 50
    df = raw(spark, data)
    out = augment.augment(df, TRAIN_CODECS, 0.2, seed=1)
    added = out.where("label = 3")
    assert out.count() == 110 and added.count() == 10
    assert added.where(~F.col("source").startswith("obfuscated:")).count() == 0
    assert augment.augment(df, TRAIN_CODECS, 0).count() == 100
    assert augment.augment(df, frac=1.0, max_chars=5).where("label = 3 AND length(text) > 80").count() == 0


def test_arrow_codecs_see_their_own_rows_only(spark):
    seen = spark.sparkContext.accumulator(0)

    def shout(texts, seeds):
        seen.add(len(texts))
        return pa.array([t.upper() + str(s) for t, s in zip(texts.to_pylist(), seeds.to_pylist())])

    df = raw(spark, [(f"attack number {i}", 1) for i in range(400)])
    out = augment.augment(df, {**TRAIN_CODECS, "shout": ArrowCodec(shout)}, 0.5).where("label = 3").collect()
    mine = [r for r in out if r.source == "obfuscated:shout"]
    assert len(out) == 200 and 10 < len(mine) < 60 and seen.value == len(mine)
    assert all(r.text.startswith(f"ATTACK NUMBER {r.row_id}") for r in mine)
    plain = augment.augment(df, {"shout": ArrowCodec(shout)}, 0.1).where("label = 3")
    assert {r.source for r in plain.collect()} == {"obfuscated:shout"}
    assert len({r.source for r in out}) == 7


def test_augment_stays_in_its_split(spark):
    df = raw(spark, [("attack %d" % i, 1) for i in range(90)]).withColumn(
        "split", F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("row_id") % 3 + 1).cast("int")))
    added = augment.augment_splits(df, frac=0.5).where("label = 3").collect()
    assert Counter(r.split for r in added) == {"train": 15, "val": 15, "test": 15}
    assert all(r.row_id % 3 == ("train", "val", "test").index(r.split) for r in added)


def test_generators(texts):
    for name, fn, label, source in novel.RECIPES:
        made = generate.generate(texts(80), fn, 40, label, source).collect()
        assert len({r.text.lower() for r in made}) == len(made) == 40
        assert all(len(r.text) > 10 and "{a}" not in r.text and "{b}" not in r.text for r in made)
        assert all(r.source.startswith(source) for r in made)
    rows = texts(3)
    doubled = rows.unionByName(rows)
    assert generate.generate(doubled, generate.hard_benign, None, 0, "hard_benign").count() == 3


def test_pieces_come_from_the_text(spark):
    odd = spark.createDataFrame([(1, "only one"), (2, ""), (3, None), (4, "... !!!")], "row_id bigint, text string")
    made = {r.row_id: r.text for r in generate.generate(odd, generate.jailbreak, None, 1, "x").collect()}
    assert made[1].count("only one") == 2 and all(x in made.values() for x in made.values())


def test_toy_corpus(texts):
    toy = generate.toy_corpus(texts(4000))
    share = {r.label: r.n / 4000 for r in toy.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert abs(share[0] - 0.5) < 0.03 and abs(share[1] - 0.25) < 0.03
    assert toy.select("text").distinct().count() == 4000


def test_build_writes_every_stage(spark, texts, tmp_path):
    toy = generate.toy_corpus(texts(400)).withColumn("source_rank", F.lit(0))
    table = corpus.build(toy.select("source_rank", "row_id", "text", "label", "source"), str(tmp_path))
    base = spark.read.parquet(f"{tmp_path}/base")
    assert base.count() == 400 and table.where("label < 3").count() == 400
    attacks = {r.split: r.n for r in base.where("label > 0").groupBy("split").agg(F.count("*").alias("n")).collect()}
    added = {r.split: r.n for r in table.where("label = 3").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert added == {s: int(n * 0.15) for s, n in attacks.items()}


def test_build_gives_unique_keys(spark, texts, tmp_path):
    one = generate.toy_corpus(texts(120)).withColumn("source_rank", F.lit(0))
    other = (generate.toy_corpus(texts(120), seed=3).withColumns({"source_rank": F.lit(1), "source": F.lit("second")})
             .withColumn("text", F.concat("text", F.lit(" again"))))
    columns = ["source_rank", "row_id", "text", "label", "source"]
    table = corpus.build(one.select(*columns).unionByName(other.select(*columns)), str(tmp_path))
    assert table.where("label = 3").count() > 0
    assert table.count() == table.select("row_id").distinct().count() > 240
