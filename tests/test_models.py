import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tessera.operators import models as ML
from tessera.operators import selection as SEL
from tessera.operators import split as SP
from tessera.session import scratch_path


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    n = 1200
    x1, x2, x3 = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y = ((2.0 * x1 - 1.5 * x2 + 0.3 * rng.normal(size=n)) > 0.4).astype(int)
    rows = [(i, float(a), float(b), float(c), int(t)) for i, (a, b, c, t) in enumerate(zip(x1, x2, x3, y))]
    df = spark.createDataFrame(rows, "id long, x1 double, x2 double, x3 double, label int")
    s = SP.stratified_split(df, "label", "id", 0.25, seed=7)
    return s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test")


@pytest.mark.parametrize("algo,params,floor", [
    ("logreg", {"C": 1.0}, 0.95), ("rf", {"n_estimators": 30, "max_depth": 6}, 0.9),
    ("gb", {"n_estimators": 20, "max_depth": 3}, 0.9), ("svc", {"C": 1.0, "n_components": 64}, 0.9)])
def test_models_learn_planted_signal(planted, algo, params, floor):
    train, test = planted
    _, m = ML.fit_evaluate(train, test, ["x1", "x2", "x3"], algo, params, "label", balanced=True)
    r = m.first()
    assert r.roc_auc > floor and 0 <= r.accuracy <= 1


def test_importance_ranks_signal_first(planted):
    train, _ = planted
    model = ML.fit(train, ["x1", "x2", "x3"], "rf", {"n_estimators": 30, "max_depth": 6})
    imp = ML.feature_importance(model, ["x1", "x2", "x3"])
    assert imp[-1][0] == "x3"


def test_artifact_roundtrip(spark, planted):
    train, test = planted
    model = ML.fit(train, ["x1", "x2", "x3"], "logreg", {"C": 1.0})
    path = scratch_path(spark, "model-roundtrip")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a = ML.predict(model, test).select("id", "prob").orderBy("id").collect()
    b = ML.predict(again, test).select("id", "prob").orderBy("id").collect()
    assert a == b


def test_param_grid_sorted_keys():
    g = ML.param_grid({"b": [1, 2], "a": [10]})
    assert g == [{"a": 10, "b": 1}, {"a": 10, "b": 2}]


def test_selection_first_max_wins(spark):
    runs = spark.createDataFrame([(0, "x", 0.5), (1, "x", 0.7), (2, "x", 0.7), (3, "y", float("nan")), (4, "y", 0.1)],
                                 "trial_no int, algorithm string, raw double")
    runs = runs.withColumn("score", SEL.normalise_score("raw"))
    best = {r.algorithm: r.trial_no for r in SEL.best_by_algorithm(runs).collect()}
    assert best == {"x": 1, "y": 4}
    assert SEL.best_overall(runs).first().trial_no == 1
