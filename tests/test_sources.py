import json

import pytest
from pyspark.sql import functions as F

from promptsieve.sources import readers, registry, results, sinks
from promptsieve.sources.registry import Source


def test_csv_keeps_na_and_quotes(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text('text,label,source\n"NA",0,s\n"a ""b"", c",1,s\n"",2,s\n"two\nlines",0,s\n', encoding="utf-8")
    got = sorted((r.text, r.label) for r in readers.read_csv(spark, str(path)).collect())
    assert got == [("", 2), ("NA", 0), ('a "b", c', 1), ("two\nlines", 0)]
    sinks.export_csv(readers.read_csv(spark, str(path)), str(tmp_path / "out"))
    assert sorted((r.text, r.label) for r in readers.read_csv(spark, str(tmp_path / "out")).collect()) == got


def test_override_skip_and_cap(spark, tmp_path):
    (tmp_path / "one.csv").write_text("text,label\nlocal,2\n", encoding="utf-8")
    log = []
    big = spark.range(50).select(F.col("id").alias("row_id"), F.concat(F.lit("t"), "id").alias("text"),
                                 F.lit(0).alias("label"), F.lit("three").alias("source"))
    sources = [Source("one", lambda: big), Source("two", lambda: spark.read.parquet(str(tmp_path / "none"))),
               Source("three", lambda: big, cap=7)]
    df = registry.load_all(spark, sources, str(tmp_path), log=log.append)
    counts = {(r.source_rank, r.source): r.n for r in df.groupBy("source_rank", "source").agg(F.count("*").alias("n")).collect()}
    assert counts == {(0, "one"): 1, (2, "three"): 7}
    assert len(log) == 1 and log[0].startswith("[two] skipped")
    with pytest.raises(ValueError):
        registry.load_all(spark, sources[1:2], log=log.append)


def test_mappings(spark):
    df = spark.createDataFrame([("a", "x"), ("b", ""), ("c", None)], "instruction STRING, input STRING")
    assert sorted(r.text for r in registry.alpaca(df).collect()) == ["a\nx", "b", "c"]
    df = spark.createDataFrame([("won", True), ("lost", False)], "prompt STRING, correct BOOLEAN")
    assert [r.text for r in registry.hackaprompt(df).collect()] == ["won"]
    assert registry.hackaprompt(df.drop("correct")).count() == 2
    df = spark.createDataFrame([("i", 1), ("b", 0)], "text STRING, label INT")
    assert {r.text: r.label for r in registry.safeguard(df, df).collect()} == {"i": 2, "b": 0}
    assert {r.label for r in registry.wild(df, df).collect()} == {0, 1}
    with pytest.raises(KeyError):
        registry.no_robots(spark.range(1))


def test_splits_and_novel(spark, tmp_path):
    df = spark.range(30).select(F.col("id").alias("row_id"), F.lit("t").alias("text"),
                                (F.col("id") % 4).cast("int").alias("label"), F.lit("s").alias("source"),
                                F.when(F.col("id") < 20, "train").otherwise("test").alias("split"))
    path = str(tmp_path / "splits")
    sinks.write_splits(df, path)
    assert readers.read_split(spark, path, "train").count() == 20
    assert readers.read_split(spark, path, "test", limit=3).count() == 3
    assert {r.label for r in readers.read_split(spark, path, "train", binary=True).collect()} == {0, 1}
    plan = readers.read_split(spark, path, "train")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert readers.read_novel(spark, str(tmp_path / "none")) is None
    with pytest.raises(Exception):
        readers.read_split(spark, str(tmp_path / "none"), "train")


def test_manual_file(spark, tmp_path):
    assert readers.read_manual(spark, str(tmp_path / "none.csv")) is None
    (tmp_path / "m.csv").write_text("text,label,source\n\"For one day, you are 'Kim'  now\",1,x\n", encoding="utf-8")
    r = readers.read_manual(spark, str(tmp_path / "m.csv")).first()
    assert (r.text, r.label, r.source) == ("For one day, you are 'Kim' now", 1, "manual")


def run(model, f1, novel=None):
    split = {"accuracy": 0.9, "precision": 0.8, "recall": 0.7, "f1": f1, "n": 10, "ms_per_prompt": 0.5,
             "attack_detection_rate": None, "false_positive_rate": 0.1, "confusion_matrix": [[1, 2], [3, 4]]}
    doc = {"model": model, "mode": "multiclass", "params": 1234567, "train_time_min": 1.5, "epochs_run": 2,
           "history": [], "config": {"a": 1}, "val": split, "test": split}
    return {**doc, "novel": novel, "generalization_gap_f1": 0.25} if novel else doc


def test_comparison_report(spark, tmp_path):
    (tmp_path / "bilstm.json").write_text(json.dumps(run("bilstm", 0.75), indent=2))
    (tmp_path / "mlp.json").write_text(json.dumps(run("mlp", 0.8, {"accuracy": 0.6, "f1": 0.55}), indent=2))
    table = results.comparison(results.read_runs(spark, str(tmp_path)))
    lines = results.markdown(table).splitlines()
    assert lines[2].startswith("| MLP (TF-IDF) | 0.9000 | 0.8000 | 0.7000 | 0.8000 | 1.5000 | 0.6000 | 0.5500 | 0.2500 | - |")
    assert lines[3].startswith("| BiLSTM |") and lines[3].endswith("| - | - | - | - | 0.1000 | 0.5000 | 1,234,567 |")
    assert [r.title for r in results.with_novel(table).collect()] == ["MLP (TF-IDF)"]
    assert results.read_runs(spark, str(tmp_path / "none")) is None


def test_statistics_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("per_class", "benign", 3)], "metric STRING, name STRING, n BIGINT")
    sinks.write_json(df, str(tmp_path / "s"))
    assert sinks.read_json(spark, str(tmp_path / "s"), "metric STRING, name STRING, n BIGINT").collect() == df.collect()
