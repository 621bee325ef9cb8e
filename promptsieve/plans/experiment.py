"""Train a classifier on one split, score all of them, report every metric in one pass; explain predictions."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.base import Estimator, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptsieve.functions import runs as rr
from promptsieve.labels import label_names
from promptsieve.operators import importance, metrics, tfidf
from promptsieve.operators.tfidf import CHAR_BLOCK, WORD_BLOCK, TermSpec
from promptsieve.session import materialized

ROW_GROUP = 1 << 20     # bytes of a row group of stored vectors; read, entries take some ten times that


@dataclass
class Classifier:
    """Fitted features and the model on top of them."""

    specs: tuple[TermSpec, ...]
    features: DataFrame  # fitted term table, bounded by the specs' max_features
    model: Transformer
    history: list[dict]
    train_seconds: float
    binary: bool = False

    def vectors(self, texts: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
        """(row_id, carried columns, features), made without a shuffle, or of joined terms for larger fits."""
        if tfidf.is_bounded(*self.specs):
            return tfidf.sparse(texts, self.features, *self.specs, carry=carry, as_vectors=True)
        rows = tfidf.sparse_rows(tfidf.weights(texts, self.features, *self.specs, keep_unknown=True))
        rows = texts.select("row_id", *carry).join(rows, "row_id") if carry else rows
        return tfidf.vectors(rows, tfidf.dimension(*self.specs))

    def score(self, texts: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
        """(row_id, carried columns, y_pred, probability array)."""
        return self.model.transform(self.vectors(texts, carry)).select(
            "row_id", *carry, F.col("prediction").cast("int").alias("y_pred"),
            vector_to_array("probability").alias("probability"))

    def training_vectors(self, rows: DataFrame, carry: tuple[str, ...]) -> DataFrame:
        """``vectors`` for several passes: stored as counts, which take a fraction of the space, and scaled when read. Spark
        reads thousands of rows at once unless a row group ends before, so these are small."""
        small = {"parquet.block.size": str(ROW_GROUP)}
        if not tfidf.is_bounded(*self.specs):
            return materialized(self.vectors(rows, carry), "vectors", **small)
        counts = tfidf.sparse(rows, self.features, *self.specs, carry=carry, counted=True)
        return tfidf.scaled_vectors(materialized(counts, "counts", **small), self.features, *self.specs)

    def save(self, path: str) -> None:
        """Store terms, model and settings in one folder, replacing what was there."""
        about = {"specs": [asdict(s) for s in self.specs], "history": self.history, "binary": self.binary,
                 "train_seconds": self.train_seconds}
        spark = self.features.sparkSession
        self.features.write.mode("overwrite").parquet(f"{path}/features")
        self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Classifier:
        """A stored classifier, ready to score batches and streams; nothing is fitted."""
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        specs = tuple(TermSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in s.items()}) for s in about["specs"])
        model = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)
        return Classifier(specs, spark.read.parquet(f"{path}/features"), model, about["history"], about["train_seconds"],
                          about["binary"])


def regularization_grid(values: tuple[float, ...] = (1e-3, 1e-2), max_iter: int = 20) -> list[Estimator]:
    return [LogisticRegression(family="multinomial", regParam=r, maxIter=max_iter, weightCol="weight",
                               labelCol="label", featuresCol="features") for r in values]


def best_by_validation(candidates: list[Estimator], train: DataFrame, val: DataFrame, k: int, patience: int = 3,
                       log: Callable[[str], None] = print) -> tuple[Transformer, list[dict]]:
    """First candidate with the strictly best validation macro-F1; gives up after ``patience`` that do no better."""
    history, chosen, leader = [], None, 0
    for place, estimator in enumerate(candidates):
        fitted = estimator.fit(train)
        guesses = fitted.transform(val).selectExpr("label AS y_true", "CAST(prediction AS INT) AS y_pred")
        scores = metrics.macro_metrics(metrics.confusion_matrix(guesses, k=k)).first().asDict()
        history.append({"step": place + 1} | {f"val_{m}": scores[m] for m in ("accuracy", "precision", "recall", "f1")})
        log(f"candidate {place + 1} of {len(candidates)}: macro-F1 {scores['f1'] or 0:.4f}")
        # the earliest row with the largest score leads
        leader = max(range(len(history)), key=lambda i: (history[i]["val_f1"] or 0.0, -i))
        if leader == place:
            chosen = fitted
        elif place - leader >= patience:
            break
    return chosen, history


def train(rows: DataFrame, specs: tuple[TermSpec, ...] = (WORD_BLOCK, CHAR_BLOCK), binary: bool = False,
          candidates: list[Estimator] | None = None, weighted: bool = True, patience: int = 3,
          log: Callable[[str], None] = lambda _: None) -> Classifier:
    """Fit features and classifier on split ``train``; choose by split ``val``. ``rows`` is a stored table with
    row_id, text, label and split, ``row_id`` unique. The fitted features are stored beside it."""
    k = len(label_names(binary))
    if binary:
        rows = rows.withColumn("label", (F.col("label") > 0).cast("int"))
    started = time.perf_counter()
    fit_rows = rows.where(F.col("split") == "train")
    features = materialized(tfidf.fit(fit_rows, *specs), "features")
    class_weight = metrics.class_weights(fit_rows, k).select("label", "weight")
    used = rows.where(F.col("split").isin("train", "val"))
    shell = Classifier(specs, features, None, [], 0.0, binary)
    labelled = shell.training_vectors(used, ("label", "split")).join(F.broadcast(class_weight), "label")  # one row per class
    if not weighted:
        labelled = labelled.withColumn("weight", F.lit(1.0))
    labelled = labelled.withColumn("label", F.col("label").cast("double"))
    model, history = best_by_validation(candidates or regularization_grid(), labelled.where("split = 'train'"),
                                        labelled.where("split = 'val'"), k, patience, log)
    return Classifier(specs, features, model, history, time.perf_counter() - started, binary)


def predictions(clf: Classifier, rows: DataFrame) -> DataFrame:
    """(split, row_id, y_true, y_pred); the label travels beside the prediction."""
    truth = F.when(F.lit(clf.binary), (F.col("label") > 0).cast("int")).otherwise(F.col("label"))
    return (clf.score(rows, ("split", "label"))
            .select("split", "row_id", truth.alias("y_true"), "y_pred"))


def n_params(clf: Classifier) -> int:
    m = clf.model
    if hasattr(m, "coefficientMatrix"):
        return m.coefficientMatrix.numRows * m.coefficientMatrix.numCols + len(m.interceptVector)
    return len(m.weights) if hasattr(m, "weights") else 0


def timed_predictions(clf: Classifier, rows: DataFrame) -> tuple[DataFrame, float]:
    """Predictions, computed once, and the milliseconds per prompt that took."""
    started = time.perf_counter()
    preds = materialized(predictions(clf, rows), "predictions")
    n = preds.count()
    return preds, 1000.0 * (time.perf_counter() - started) / max(1, n)


def experiment(rows: DataFrame, name: str = "linear", **options) -> tuple[Classifier, DataFrame]:
    """Train, then one row of metrics per split other than train, with the novel gap beside it."""
    clf = train(rows, **options)
    preds, ms = timed_predictions(clf, rows.where(F.col("split") != "train"))
    result = metrics.evaluate(preds, ["split"], clf.binary).withColumn("model", F.lit(name))
    gap = metrics.generalization_gap(result).select("model", "gap")
    return clf, (result.join(gap, "model")
                 .withColumns({"params": F.lit(n_params(clf)).cast("bigint"), "epochs_run": F.lit(len(clf.history)),
                               "train_time_min": F.lit(clf.train_seconds / 60), "ms_per_prompt": F.lit(ms)}))


def attributions(clf: Classifier, texts: DataFrame, block: int = 0) -> DataFrame:
    """(row_id, pred, tokens) of a linear model, in the form of one row per prompt: a term's score is its weight times its
    coefficient for the predicted class, negative parts cut; ``pos`` is the term's index.

    The coefficient table has one row per class and feature, both capped by the specs.
    """
    matrix = clf.model.coefficientMatrix.toArray()
    if matrix.shape[0] == 1:  # a two-class model keeps the coefficients of class 1 only
        matrix = np.concatenate([-matrix, matrix])
    first = tfidf.dimension(*clf.specs[:block])
    end = first + clf.specs[block].max_features
    if not tfidf.is_bounded(*clf.specs):
        return _joined_attributions(clf, texts, matrix, block)
    pred = clf.model.transform(clf.vectors(texts)).select("row_id", F.col("prediction").cast("int").alias("pred"), "features")
    table = clf.features.select("idx", "term").toArrow().sort_by("idx")
    place = np.zeros(tfidf.dimension(*clf.specs), dtype=np.int64)
    place[table["idx"].to_numpy()] = np.arange(len(table))
    terms = table["term"].combine_chunks()

    def attributed(batch: pa.RecordBatch) -> pa.RecordBatch:
        indices, values = batch.column("features").field("indices"), batch.column("features").field("values")
        sizes, idx = rr.sizes_of(indices), indices.flatten().to_numpy(zero_copy_only=False)
        classes = np.repeat(batch.column("pred").to_numpy(zero_copy_only=False), sizes)
        kept = np.flatnonzero((idx >= first) & (idx < end))
        bounds = np.searchsorted(kept, np.concatenate(([0], np.cumsum(sizes)))).astype(np.int32)
        classes, idx = classes[kept], idx[kept]
        score = np.maximum(0.0, values.flatten().to_numpy(zero_copy_only=False)[kept] * matrix[classes, idx])
        lists = lambda values: pa.ListArray.from_arrays(pa.array(bounds), values)
        return pa.RecordBatch.from_arrays(
            [batch.column("row_id"), batch.column("pred"), lists(pa.array(idx)), lists(terms.take(pa.array(place[idx]))),
             lists(pa.array(score)), lists(pa.array(np.zeros(len(kept), dtype=bool)))],
            names=["row_id", "pred", "indices", "term", "values", "special"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in rr.chunks(rr.sizes_of(batch.column("features").field("indices")), tfidf.ENTRIES):
                yield attributed(batch.slice(start, stop - start))

    list_of = lambda name, kind: T.StructField(name, T.ArrayType(kind))
    return importance.nested(pred.mapInArrow(run, T.StructType([
        pred.schema["row_id"], pred.schema["pred"], list_of("indices", T.IntegerType()), list_of("term", T.StringType()),
        list_of("values", T.DoubleType()), list_of("special", T.BooleanType())])))


def _joined_attributions(clf: Classifier, texts: DataFrame, matrix: np.ndarray, block: int) -> DataFrame:
    """One row per token, for fits that are too large for the tasks."""
    coefficients = texts.sparkSession.createDataFrame(
        [(c, [float(x) for x in matrix[c]]) for c in range(len(matrix))], "pred INT, coefs ARRAY<DOUBLE>")
    pred = clf.score(texts).select("row_id", F.col("y_pred").alias("pred"))
    terms = tfidf.weights(texts, clf.features, *clf.specs).where(F.col("block") == block)
    return (terms.join(pred, "row_id").join(F.broadcast(coefficients), "pred")
            .select("row_id", F.col("idx").alias("pos"), F.col("term").alias("token"),
                    F.greatest(F.lit(0.0), F.col("weight") * F.get("coefs", F.col("idx"))).alias("score"),
                    F.lit(False).alias("special"), "pred"))


def explain(clf: Classifier, texts: DataFrame, k: int = importance.TOP_PER_PROMPT) -> DataFrame:
    """(row_id, y_pred, label_name, probability, rank, token, score): the terms behind each prediction."""
    names = F.create_map(*[F.lit(x) for pair in label_names(clf.binary).items() for x in pair])
    scored = clf.score(texts).select("row_id", "y_pred", F.element_at(names, F.col("y_pred")).alias("label_name"),
                                     F.array_max("probability").alias("probability"))
    top = importance.top_tokens_per_prompt(importance.normalized(attributions(clf, texts)), k)
    return scored.join(top, "row_id", "left")


def corpus_importance(clf: Classifier, texts: DataFrame, k: int = importance.TOP_TOKENS,
                      min_count: int = importance.MIN_COUNT) -> DataFrame:
    return importance.top_tokens(importance.normalized(attributions(clf, texts)), k, min_count)


def run_document(metrics_rows: DataFrame, confusion: DataFrame, binary: bool = False) -> DataFrame:
    """One row in the shape of ``sources.results.RUN_SCHEMA`` per model, ready for the JSON sink."""
    row_counts = confusion.groupBy("split", "y_true").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("y_pred", "n"))), lambda s: s["n"]).alias("_r"))
    matrix = row_counts.groupBy("split").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("y_true", "_r"))), lambda s: s["_r"])
        .alias("confusion_matrix"))
    block = F.struct("accuracy", "precision", "recall", "f1", "attack_detection_rate", "false_positive_rate", "n",
                     "ms_per_prompt", "confusion_matrix")
    by_split = [F.max(F.when(F.col("split") == s, block)).alias(s) for s in ("val", "test", "novel")]
    return (metrics_rows.join(matrix, "split").groupBy("model").agg(
        F.lit("binary" if binary else "multiclass").alias("mode"), F.first("params").alias("params"),
        F.first("train_time_min").alias("train_time_min"), F.first("epochs_run").alias("epochs_run"), *by_split,
        F.first("gap").alias("generalization_gap_f1")))
