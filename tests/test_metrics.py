import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from tessera.operators import metrics as M

# (y_true, y_pred, p): tp 3, fp 1, fn 1, tn 3; of the 16 pairs of a positive and a negative,
# 0.40 loses to 0.55 and 0.45
ROWS = [(1, 1, 0.95), (1, 0, 0.40), (1, 1, 0.60), (0, 0, 0.05), (0, 1, 0.55), (0, 0, 0.30), (0, 0, 0.45), (1, 1, 0.80)]


@pytest.fixture(scope="module")
def fx(spark):
    return spark.createDataFrame(ROWS, "y int, yh int, p double")


def test_count_metrics(fx):
    r = M.count_metrics(fx, "y", "yh", "p").first()
    assert r.accuracy == pytest.approx(6 / 8)
    assert r.precision == pytest.approx(3 / 4) and r.recall == pytest.approx(3 / 4)
    assert r.f1_score == pytest.approx(3 / 4)
    ll = -np.mean([y * math.log(p) + (1 - y) * math.log(1 - p) for y, _, p in ROWS])
    assert r.log_loss == pytest.approx(ll)


def test_auc_hand_value(fx):
    assert M.roc_auc(fx, "y", "p").first().roc_auc == pytest.approx(14 / 16)


def test_confusion_and_report(fx):
    cm = {(r.actual, r.pred): r.n for r in M.confusion_matrix(fx, "y", "yh").collect()}
    assert cm == {(0, 0): 3, (0, 1): 1, (1, 0): 1, (1, 1): 3}
    rep = {r["class"]: r for r in M.classification_report(fx, "y", "yh").collect()}
    assert rep["accuracy"].f1_score == pytest.approx(6 / 8) and rep["1"].support == 4
    assert rep["macro avg"].precision == pytest.approx(3 / 4)


def test_one_class_auc_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, p double")
    assert M.roc_auc(df, "y", "p").first().roc_auc is None


def _brute_auc(ys, ps):
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=4, max_size=60))
def test_auc_matches_pair_count_with_ties(spark, data):
    ys = [y for y, _ in data]
    if len(set(ys)) < 2:
        return
    ps = [p / 6 for _, p in data]
    df = spark.createDataFrame(list(zip(ys, ps)), "y int, p double")
    assert M.roc_auc(df, "y", "p").first().roc_auc == pytest.approx(_brute_auc(ys, ps))


def test_null_labels_and_slices(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.1), ("a", None, 0.5), ("a", None, 0.05), (None, 1, 0.7), (None, 0, 0.2), (None, 0, 0.8)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    assert M.roc_auc(df.filter("g = 'a'"), "y", "p").first().roc_auc == 1.0
    assert {r.g: r.roc_auc for r in M.roc_auc(df, "y", "p", ["g"]).collect()} == {"a": 1.0, None: 0.5}
    by = {r.g: r.roc_auc for r in M.evaluate(df.withColumn("yh", F.lit(1)), "y", "yh", "p", ["g"]).collect()}
    assert by == {"a": 1.0, None: 0.5}


def test_null_classes_are_split(spark):
    from tessera.operators.quantiles import quantiles
    from tessera.operators.split import fold_ids, stratified_split
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 3) for i in range(100)], "id long, y int")
    got = stratified_split(df, "y", "id", 0.2).groupBy("y", "split").count().collect()
    size = {r.y: r["count"] for r in df.groupBy("y").count().collect()}
    assert sum(r["count"] for r in got) == 100
    assert {r.y: r["count"] for r in got if r.split == "test"} == {y: math.ceil(n * 0.2) for y, n in size.items()}
    assert fold_ids(df, "id", "y", 5).count() == 100
    middle = {r.y: r.value for r in quantiles(df, ["id"], [0.5], ["y"]).collect()}
    assert middle == {y: float(np.median([i for i in range(100) if (None if i % 4 == 0 else i % 3) == y])) for y in size}
