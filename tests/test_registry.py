"""Saved models, the stored registry, and the whole pipeline."""

import threading

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tessera.operators import models as ML
from tessera.operators import pipeline as PL
from tessera.operators import scoring as S
from tessera.operators.clean import CleanConfig, CleanerEstimator
from tessera.operators.knn import KnnModel
from tessera.operators.registry import RECORD, Registry
from tessera.operators.stored import load_model, save_model
from tessera.session import scratch_path


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    p = 1 / (1 + np.exp(-(2.5 * x[:, 0] - 2 * x[:, 1])))
    rows = [(i, *map(float, v), int(rng.random() < q)) for i, (v, q) in enumerate(zip(x, p))]
    return spark.createDataFrame(rows, "id long, x1 double, x2 double, x3 double, label int")


FEATURES = ["x1", "x2", "x3"]


def scores(model, df):
    return [(r.id, r.prob, r.prediction) for r in ML.predict(model, df).select("id", "prob", "prediction").orderBy("id").collect()]


@pytest.mark.parametrize("algorithm,params", [("svc", {"C": 1.0, "class_weight": "balanced"}), ("svc", {"kernel": "linear"}),
                                              ("knn", {"n_neighbors": 7}), ("gb", {"n_estimators": 5}), ("rf", {"n_estimators": 5})])
def test_saved_model_scores_equally(spark, planted, algorithm, params):
    model = ML.fit(planted, FEATURES, algorithm, params)
    again = load_model(spark, save_model(model, scratch_path(spark, f"saved-{algorithm}-{len(params)}")))
    assert type(again) is type(model) and again.uid == model.uid
    assert scores(model, planted) == scores(again, planted)


def test_saved_logit_and_cleaner_in_a_pipeline(spark, dirty):
    cleaner = CleanerEstimator(CleanConfig(protect=("fault",))).fit(dirty)
    logit = S.LinearLogit({"reading": 0.01, "pressure": 0.5}, -1.0)
    both = PipelineModel([cleaner, logit])
    path = scratch_path(spark, "cleaner-pipeline")
    both.write().overwrite().save(path)
    again = load_model(spark, path)
    assert again.stages[0].report == cleaner.report
    assert again.transform(dirty).collect() == both.transform(dirty).collect()
    with pytest.raises(Exception):
        KnnModel.load(f"{path}/stages/0_{cleaner.uid}")
    assert Pipeline(stages=[CleanerEstimator()]).fit(dirty).transform(dirty).count() == 60


def test_svc_probabilities_are_calibrated_out_of_fold(planted):
    """On labels drawn with known probabilities the fitted ones agree on average per tenth."""
    model = ML.fit(planted, FEATURES, "svc", {"C": 1.0})
    rows = ML.predict(model, planted).select("x1", "x2", "prob").collect()
    true = np.array([1 / (1 + np.exp(-(2.5 * r.x1 - 2 * r.x2))) for r in rows])
    got = np.array([r.prob for r in rows])
    bins = np.clip((got * 5).astype(int), 0, 4)
    assert max(abs(true[bins == b].mean() - got[bins == b].mean()) for b in range(5) if (bins == b).sum() > 20) < 0.12


def test_knn_model_matches_brute_force(spark, planted):
    model = ML.fit(planted, FEATURES, "knn", {"n_neighbors": 5, "weights": "uniform"})
    x = np.array([[r.x1, r.x2, r.x3] for r in planted.orderBy("id").collect()])
    y = np.array([r.label for r in planted.orderBy("id").collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    near = np.argsort(((z[:, None] - z[None]) ** 2).sum(-1), axis=1, kind="stable")[:, :5]
    assert [s[1] for s in scores(model, planted)] == pytest.approx(list(y[near].mean(1)))


def test_unknown_and_refused(planted):
    with pytest.raises(ValueError):
        ML.fit(planted, FEATURES, "nope", {})
    with pytest.raises(ValueError):
        ML.fit(planted, FEATURES, "rf", {"max_depth": 31})


def record(spark, n, score, algorithm="logreg"):
    return spark.createDataFrame([(n, algorithm, "{}", *[0.5] * 6, "roc_auc", score)], RECORD)


def test_registry_two_writers_and_retries(spark):
    registry = Registry(spark, scratch_path(spark, "registry-two"))
    assert registry.runs() is None
    won = []
    writers = [threading.Thread(target=lambda r=r, n=n: won.append(registry.publish(r, record(spark, n, 0.1 * n))))
               for n, r in enumerate(["a", "b", "same", "same"])]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    rows = registry.runs().collect()
    assert sorted(r.run_id for r in rows) == ["a", "b", "same"] and won.count(True) == 3
    assert not registry.publish("a", record(spark, 9, 0.99)) and len(registry.runs().collect()) == 3
    record(spark, 7, 0.95).write.parquet(f"{registry.root}/runs/dead/attempt-1/records")
    assert {r.run_id for r in registry.runs().collect()} == {"a", "b", "same"}
    best = registry.champions().first()
    assert best.run_id == max(rows, key=lambda r: r.score).run_id
    with pytest.raises(LookupError):
        registry.champion()
    with pytest.raises(ValueError):
        registry.publish("a/b", record(spark, 1, 0.5))


def test_whole_pipeline(spark, dirty):
    registry = Registry(spark, scratch_path(spark, "registry-pipeline"))
    config = PL.PipelineConfig("FAULT", "Meter No", CleanConfig(protect=("fault", "meter_no")),
                               {"logreg": {"C": [0.1, 1.0]}, "knn": {"n_neighbors": [3]}}, test_size=0.25, seed=7)
    out = PL.run_pipeline(dirty, config, registry, "first")
    assert "remark" not in out["clean"].columns and out["runs"].count() == 3
    assert {r.algorithm for r in out["runs"].collect()} == {"logreg", "knn"}
    assert out["train"].count() + out["test"].count() == 60
    saved = registry.runs().filter("model_path is not null").collect()
    assert {r.algorithm for r in saved} == {"logreg", "knn"} and out["champion"]["run_id"] == "first"
    scored = PL.score_raw(dirty, registry).collect()
    assert len(scored) == 60 and all(0 <= r.probability <= 1 and r.algorithm == out["champion"]["algorithm"] for r in scored)
    direct = ML.predict(registry.load(out["champion"]), out["test"].unionByName(out["train"]))
    want = {r[0]: r[1] for r in direct.select("meter_no", "prob").collect()}
    assert {r.meter_no: r.probability for r in scored} == pytest.approx(want)


def test_grids_are_the_configured_ones():
    assert len([1 for a in PL.GRIDS for _ in ML.param_grid(PL.GRIDS[a])]) == 32
    assert [len(ML.param_grid(PL.CV_GRIDS[a])) for a in ("logreg", "rf", "svc", "knn")] == [24, 27, 12, 8]


def test_cross_validation_rows(planted):
    folds = planted.withColumn("fold", F.col("id").cast("int") % 3)
    out = ML.cross_validate(folds, FEATURES, {"logreg": {"C": [0.1, 1.0]}, "knn": {"n_neighbors": [3]}}, k=3).collect()
    assert len(out) == 3 and all(0.6 < r.mean_accuracy < 1 and r.min_accuracy <= r.mean_accuracy <= r.max_accuracy for r in out)
