import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from promptsieve.functions import runs as rr
from promptsieve.operators import generate, metrics, split, tfidf
from promptsieve.operators.tfidf import TermSpec
from promptsieve.plans import experiment, novel
from promptsieve.plans.network import NetworkEstimator
from promptsieve.session import materialized
from promptsieve.sources import results, sinks
from promptsieve.streaming.dedup import deduplicated, start_deduplication
from promptsieve.streaming.scoring import start_scoring

SPECS = (TermSpec("word", "token", (1, 2), min_df=2, max_features=150),
         TermSpec("char", "char", (3,), min_df=3, max_features=50))
GRID = lambda: experiment.regularization_grid((1e-3,), max_iter=15)


@pytest.fixture(scope="module")
def toy(spark, texts):
    rows = generate.toy_corpus(texts(300))
    placed = split.assign_split(rows).select("row_id", "text", "label", "split")
    fresh = generate.toy_corpus(texts(40, first=1000), seed=5).select(
        "row_id", "text", "label", F.lit("novel").alias("split"))
    return materialized(placed.unionByName(fresh), "toy")


@pytest.fixture(scope="module")
def clf(toy):
    return experiment.train(toy, SPECS, candidates=GRID())


def test_experiment_reports_every_split(spark, toy, tmp_path):
    clf, report = experiment.experiment(toy, "linear", specs=SPECS, candidates=GRID())
    rows = {r.split: r for r in report.collect()}
    assert set(rows) == {"val", "test", "novel"}
    assert all(r.f1 > 0.6 and r.params == 4 * 200 + 4 or r.params == 3 * 200 + 3 for r in rows.values())
    assert rows["test"].gap == pytest.approx(rows["test"].f1 - rows["novel"].f1)
    confusion = metrics.confusion_matrix(experiment.predictions(clf, toy.where("split <> 'train'")), ["split"])
    doc = experiment.run_document(report.withColumn("model", F.lit("mlp")), confusion)
    sinks.write_json(doc.coalesce(1), str(tmp_path / "mlp.json"))
    table = results.comparison(results.read_runs(spark, str(tmp_path)))
    assert table.first().f1 == pytest.approx(rows["test"].f1)


def test_binary_training(toy):
    clf = experiment.train(toy, SPECS, binary=True, candidates=GRID())
    preds = experiment.predictions(clf, toy.where("split = 'test'"))
    assert {r.y_true for r in preds.collect()} == {0, 1}
    assert metrics.macro_metrics(metrics.confusion_matrix(preds, [], 2), []).first().f1 > 0.9
    assert experiment.explain(clf, toy.where("split = 'test'")).count() > 0


def test_any_estimator_trains(toy):
    net = MultilayerPerceptronClassifier(layers=[200, 8, 4], maxIter=30, seed=1, featuresCol="features", labelCol="label")
    clf = experiment.train(toy, SPECS, candidates=[net])
    assert experiment.predictions(clf, toy.where("split = 'test'")).where("y_true = y_pred").count() > 20
    assert experiment.n_params(clf) == 200 * 8 + 8 + 8 * 4 + 4


def test_first_strictly_best_model_wins(toy, clf):
    labelled = (toy.select("row_id", F.col("label").cast("double"), "split").join(clf.vectors(toy), "row_id")
                .withColumn("weight", F.lit(1.0)))
    weak = LogisticRegression(maxIter=1, regParam=100.0, weightCol="weight")
    good = experiment.regularization_grid((1e-3,), 10)[0]
    model, history = experiment.best_by_validation(
        [weak, good, weak, weak, good], labelled.where("split = 'train'"), labelled.where("split = 'val'"), 4,
        patience=2, log=lambda _: None)
    assert len(history) == 4 and model.getRegParam() == 1e-3


def test_training_vectors_are_stored_in_small_row_groups(texts, clf, monkeypatch):
    """A row group is the most that Spark reads at once; thousands of long rows don't fit an executor."""
    monkeypatch.setattr(experiment, "ROW_GROUP", 1 << 14)
    vectors = clf.training_vectors(texts(3000).coalesce(1), ())
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in vectors.inputFiles()]
    assert sum(g.num_rows for g in groups) == 3000
    assert all(g.row_group(k).num_rows <= 1500 for g in groups for k in range(g.num_row_groups))
    assert {r.row_id: r.features for r in vectors.collect()} == {r.row_id: r.features for r in clf.vectors(texts(3000)).collect()}


def test_vectors_are_made_in_bounded_parts():
    assert list(rr.chunks(np.array([6, 5, 4, 30, 1, 1]), 10)) == [(0, 1), (1, 3), (3, 4), (4, 6)]
    assert rr.CHUNK_SYMBOLS <= 1 << 19 and tfidf.ENTRIES <= 1 << 18     # two tasks of an executor share about 1 GB for Python


def test_explanations(toy, clf):
    top = experiment.explain(clf, toy.where("split = 'test'"))
    assert top.where("rank > 8 OR score < 0 OR score > 1").count() == 0
    assert top.select("row_id").distinct().count() == toy.where("split = 'test'").count()
    tokens = [r.token for r in experiment.corpus_importance(clf, toy).collect()]
    assert 0 < len(tokens) <= 25


def test_stream_scores_like_the_batch(spark, toy, clf, tmp_path):
    prompts = toy.where("split = 'test'").select("row_id", "text")
    inbox, sink, state = (str(tmp_path / n) for n in ("inbox", "scored", "state"))
    prompts.repartition(3).write.parquet(inbox)
    read = lambda: spark.readStream.schema(prompts.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    start_scoring(read(), clf, sink, state).awaitTermination()
    batch = {r.row_id: r.y_pred for r in clf.score(prompts).collect()}
    streamed = lambda: [(r.row_id, r.y_pred) for r in spark.read.parquet(sink).collect()]
    assert dict(streamed()) == batch and len(streamed()) == len(batch)
    start_scoring(read(), clf, sink, state).awaitTermination()  # a restart finds nothing new
    assert len(streamed()) == len(batch)


def test_stream_dedup(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "Copy"), ("2024-01-01 00:10:00", "copy"), ("2024-01-01 00:20:00", "other")]
    df = spark.createDataFrame(rows, "ts STRING, text STRING").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = deduplicated(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts")
    (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
     .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination())
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["Copy", "other"]


def test_stream_dedup_for_all_time_with_bounded_state(spark, tmp_path):
    """Copies far apart go although the state forgets them; a second run goes on where the first one ended."""
    source, sink, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    schema = "row_id bigint, text string"

    def arrive(first, n):
        data = [(i, f"Text {i}") for i in range(first, first + n)] + [(-first, f"TEXT {first}"), (-first - 1, "text 0"), (7, None)]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = start_deduplication(stream, sink, state, ttl="0 seconds")
        query.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]

    for first in (0, 50, 100):
        arrive(first, 50)
    sizes = run()
    arrive(150, 50)
    arrive(120, 50)     # all but one seen, or new copies of them
    sizes += run()
    kept = spark.read.parquet(sink).collect()
    assert len(kept) == len({r.text_key for r in kept}) == 201
    assert sorted(r.text.lower() for r in kept if r.text) == sorted(f"text {i}" for i in range(200))
    assert max(sizes) <= 2 * 53 and sizes[-1] < 201


def test_novel_set_excludes_near_copies(spark, texts, tmp_path):
    sizes = {"jailbreak": 10, "injection": 10, "obfuscation": 8, "benign": 10}
    pool = novel.with_pool_id(novel.candidate_pool(texts(60), sizes=sizes))
    seen = pool.where("label = 1").select(F.concat(F.upper("text"), F.lit("!!")).alias("text"))
    built = novel.build(texts(60), str(tmp_path / "novel"), seen, sizes=sizes)
    assert built.where("label = 1").count() == 0
    # injections share sentences with the seen prompts, so some of them go as well
    assert 0 < built.where("label = 2").count() <= 10 and built.where("label = 3").count() >= 4


def test_stored_classifier_scores_alike_in_another_session(spark, toy, clf, tmp_path):
    clf.save(str(tmp_path / "clf"))
    clf.save(str(tmp_path / "clf"))     # replaces
    loaded = experiment.Classifier.load(spark.newSession(), str(tmp_path / "clf"))
    assert (loaded.specs, loaded.history, loaded.binary) == (clf.specs, clf.history, clf.binary)
    test = toy.where("split = 'test'")
    want = {r.row_id: (r.y_pred, r.probability) for r in clf.score(test).collect()}
    assert want == {r.row_id: (r.y_pred, r.probability) for r in loaded.score(test).collect()}
    test.select("row_id", "text").write.parquet(str(tmp_path / "in"))
    arrivals = spark.readStream.schema("row_id bigint, text string").parquet(str(tmp_path / "in"))
    start_scoring(arrivals, loaded, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r.row_id: r.y_pred for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {
        k: v[0] for k, v in want.items()}


def centroids(train):
    """Softmax over dot products with class means, as a stand-in for a network."""
    import numpy as np
    from pyspark.ml.stat import Summarizer
    means = train.groupBy("label").agg(Summarizer.mean(F.col("features")).alias("m")).orderBy("label").collect()
    weights = np.zeros((4, 200), dtype=np.float32)
    for r in means:
        weights[int(r.label)] = r.m.toArray() / np.linalg.norm(r.m.toArray())

    def make_predict():
        def predict(x):
            e = np.exp(8 * x @ weights.T)
            return e / e.sum(axis=1, keepdims=True)
        return predict
    return make_predict


def test_own_network_runs_through_an_experiment(toy):
    import numpy as np
    clf, report = experiment.experiment(toy, "own", specs=SPECS, candidates=[NetworkEstimator(centroids, 200, 32)])
    test = toy.where("split = 'test'")
    predict = clf.model.make_predict()
    rows = test.select("row_id", "label").join(clf.vectors(test), "row_id").collect()
    own = predict(np.array([r.features.toArray() for r in rows], dtype=np.float32)).argmax(axis=1)
    accuracy = sum(int(p == r.label) for p, r in zip(own, rows)) / len(rows)
    assert accuracy > 0.5
    assert {r.split: r.accuracy for r in report.collect()}["test"] == pytest.approx(accuracy, abs=1e-4)
    assert clf.score(test).where("size(probability) <> 4").count() == 0
