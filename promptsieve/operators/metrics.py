"""Evaluation metrics. One pass over the predictions counts the label grid; everything else derives from the counts.

``by`` names the columns evaluated apart (model, split); their combinations are few, so all tables here are small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsieve.labels import binary_label, label_name, label_names


def binary_view(preds: DataFrame) -> DataFrame:
    return preds.withColumns({"y_true": binary_label(F.col("y_true")), "y_pred": binary_label(F.col("y_pred"))})


def confusion_matrix(preds: DataFrame, by: list[str] = (), k: int = 4) -> DataFrame:
    """(by, y_true, y_pred, n) on the full k x k grid, zeros included."""
    grid = [(t, p) for t in range(k) for p in range(k)]
    counts = [F.count_if((F.col("y_true") == t) & (F.col("y_pred") == p)).alias(f"_{t}_{p}") for t, p in grid]
    cells = F.array(*[F.struct(F.lit(t).alias("y_true"), F.lit(p).alias("y_pred"), F.col(f"_{t}_{p}").alias("n"))
                      for t, p in grid])
    return preds.groupBy(*by).agg(*counts).select(*by, F.inline(cells))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def per_class(confusion: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, label, tp, support, predicted, precision, recall, f1); an empty ratio counts as 0."""
    n, hit = F.col("n"), F.col("y_true") == F.col("y_pred")
    roles = F.array(
        F.struct(F.col("y_true").alias("label"), n.alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(hit, n).otherwise(0).alias("tp")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("support"), n.alias("predicted"),
                 F.lit(0).cast("bigint").alias("tp")))
    sums = (confusion.select(*by, F.inline(roles)).groupBy(*by, "label")
            .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")))
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return (sums.withColumn("precision", _ratio(tp, predicted)).withColumn("recall", _ratio(tp, support))
            .withColumn("f1", _ratio(2 * tp, support + predicted)))


def macro_metrics(confusion: DataFrame, by: list[str] = ()) -> DataFrame:
    """Accuracy and macro precision, recall, F1 over the labels seen in truth or prediction."""
    seen = F.col("support") + F.col("predicted") > 0
    mean = lambda c: F.avg(F.when(seen, F.col(c))).alias(c)
    return per_class(confusion, by).groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), mean("precision"), mean("recall"), mean("f1"),
        F.sum("support").alias("n"))


def security_metrics(confusion: DataFrame, by: list[str] = ()) -> DataFrame:
    """Detection rate of attacks and false-positive rate of benign prompts; NULL without attacks or benign prompts."""
    attack, flagged, n = F.col("y_true") > 0, F.col("y_pred") > 0, F.col("n")
    share = lambda rows: F.try_divide(F.sum(F.when(rows & flagged, n).otherwise(0)),
                                      F.sum(F.when(rows, n).otherwise(0)))
    return confusion.groupBy(*by).agg(share(attack).alias("attack_detection_rate"),
                                      share(~attack).alias("false_positive_rate"))


def class_report(confusion: DataFrame, by: list[str] = (), binary: bool = False) -> DataFrame:
    """(by, name, precision, recall, f1, support) for every label of the domain, then accuracy (in ``f1``), macro
    average and support-weighted average. Labels that never occur count as 0 here."""
    classes = per_class(confusion, by)
    scores = ("precision", "recall", "f1")
    rows = classes.select(*by, label_name(F.col("label"), binary).alias("name"), *scores, "support")
    total = F.sum("support")
    weighted = [F.coalesce(F.try_divide(F.sum(F.col(s) * F.col("support")), total), F.lit(0.0)) for s in scores]
    summary = classes.groupBy(*by).agg(
        F.array(
            F.struct(F.lit("accuracy").alias("name"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), F.try_divide(F.sum("tp"), total).alias("f1")),
            F.struct(F.lit("macro avg").alias("name"), *[F.avg(s).alias(s) for s in scores]),
            F.struct(F.lit("weighted avg").alias("name"), *[w.alias(s) for w, s in zip(weighted, scores)]),
        ).alias("_rows"), total.alias("support"))
    return rows.unionByName(summary.select(*by, F.inline("_rows"), "support"))


def class_weights(labelled: DataFrame, k: int = 4) -> DataFrame:
    """(label, n, weight) with ``weight = sum / (k * n)``; an empty class counts as one row, in the sum as well."""
    counts = labelled.agg(*[F.count_if(F.col("label") == v).alias(f"_{v}") for v in range(k)])
    floors = [F.greatest(F.col(f"_{v}"), F.lit(1)) for v in range(k)]
    total = reduce(lambda a, b: a + b, floors)
    rows = [F.struct(F.lit(v).alias("label"), F.col(f"_{v}").alias("n"), (total / (k * floors[v])).alias("weight"))
            for v in range(k)]
    return counts.select(F.inline(F.array(*rows)))


def evaluate(preds: DataFrame, by: list[str], binary: bool = False) -> DataFrame:
    """Macro and guardrail metrics, one row per combination of ``by``."""
    confusion = confusion_matrix(preds, by, len(label_names(binary)))
    return macro_metrics(confusion, by).join(security_metrics(confusion, by), list(by))


def generalization_gap(metrics: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """Test F1 minus novel F1; NULL where one of them is missing."""
    f1 = lambda split: F.max(F.when(F.col("split") == split, F.col("f1")))
    return metrics.groupBy(*by).agg(f1("test").alias("test_f1"), f1("novel").alias("novel_f1"),
                                    (f1("test") - f1("novel")).alias("gap"))
