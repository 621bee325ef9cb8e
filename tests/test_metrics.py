import pytest
from pyspark.sql import functions as F

from promptsieve.operators import importance, metrics

TEST = [[4409, 222, 3, 9], [68, 87, 0, 1], [6, 4, 351, 0], [0, 0, 0, 77]]
NOVEL = [[45, 2, 0, 0], [47, 103, 0, 0], [91, 8, 51, 0], [33, 11, 1, 55]]


def preds(spark, **matrices):
    cells = [(s, t, p, n) for s, m in matrices.items() for t, row in enumerate(m) for p, n in enumerate(row) if n]
    return (spark.createDataFrame(cells, "split STRING, y_true INT, y_pred INT, n INT")
            .select(F.lit("m").alias("model"), "split", "y_true", "y_pred", F.explode(F.sequence(F.lit(1), "n"))))


def test_published_matrices_give_published_metrics(spark):
    df = preds(spark, test=TEST, novel=NOVEL)
    got = {r.split: r for r in metrics.evaluate(df, ["model", "split"]).collect()}
    for split, want in (("test", (0.940233, 0.814524, 0.875421, 0.050398)),
                        ("novel", (0.568233, 0.577165, 0.5725, 0.042553))):
        r = got[split]
        assert [round(x, 6) for x in (r.accuracy, r.f1, r.attack_detection_rate, r.false_positive_rate)] == list(want)
    gap = metrics.generalization_gap(metrics.evaluate(df, ["model", "split"])).first().gap
    assert round(gap, 4) == 0.2374
    grid = metrics.confusion_matrix(df, ["split"]).where("split = 'test'").orderBy("y_true", "y_pred").collect()
    assert [r.n for r in grid] == [n for row in TEST for n in row]


def test_absent_classes(spark):
    df = preds(spark, s=[[3, 1, 0, 0], [1, 1, 0, 0]])
    confusion = metrics.confusion_matrix(df, ["split"])
    macro = metrics.macro_metrics(confusion, ["split"]).first()
    assert macro.f1 == pytest.approx((0.75 + 0.5) / 2)
    report = {r["name"]: r for r in metrics.class_report(confusion, ["split"]).collect()}
    assert report["obfuscation"].f1 == 0 and report["macro avg"].f1 == pytest.approx((0.75 + 0.5) / 4)
    assert report["weighted avg"].f1 == pytest.approx((0.75 * 4 + 0.5 * 2) / 6)
    assert report["accuracy"].f1 == pytest.approx(4 / 6) and report["accuracy"].support == 6


def test_guardrail_rates_without_attacks_or_benign(spark):
    rate = lambda m: tuple(metrics.security_metrics(metrics.confusion_matrix(preds(spark, s=m), []), []).first())
    assert rate([[4, 1, 0, 0]]) == (None, 0.2)
    assert rate([[0, 0, 0, 0], [1, 3, 0, 0]]) == (0.75, None)


def test_binary_view(spark):
    binary = metrics.binary_view(preds(spark, s=TEST))
    assert metrics.confusion_matrix(binary, [], 2).orderBy("y_true", "y_pred").select("n").collect() == [
        (4409,), (234,), (74,), (520,)]


def test_class_weights_count_an_empty_class_as_one(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 3, "label INT")
    assert {r.label: r.weight for r in metrics.class_weights(df).collect()} == {
        0: 11 / 24, 1: 11 / 12, 2: 11 / 4, 3: 11 / 4}


def test_importance(spark):
    data = [(1, 0, "[CLS]", 9.0, True, 1), (1, 1, "ĠIgnore", 4.0, False, 1), (1, 2, "this", 1.0, False, 1),
            (2, 0, "ignore", 2.0, False, 2), (3, 0, "##ignore", 0.0, False, 3), (4, 0, "ignore", 5.0, False, 0)]
    df = spark.createDataFrame(data, "row_id BIGINT, pos INT, token STRING, score DOUBLE, special BOOLEAN, pred INT")
    norm = importance.normalized(df)
    assert {(r.row_id, r.pos): r.score for r in norm.collect()} == {
        (1, 0): 0.0, (1, 1): 1.0, (1, 2): 0.25, (2, 0): 1.0, (3, 0): 0.0, (4, 0): 1.0}
    top = importance.top_tokens(norm).collect()
    assert [(r.token, round(r.mean_importance, 6), r.n) for r in top] == [("ignore", 0.666667, 3)]
    first = importance.top_tokens_per_prompt(norm, 1).orderBy("row_id").first()
    assert (first.token, first["rank"]) == ("Ignore", 1)
