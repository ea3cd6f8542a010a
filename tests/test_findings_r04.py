"""Plans and results behind the findings of round 4."""

import glob
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tessera.operators import correlation as R
from tessera.operators import models as ML
from tessera.operators import pipeline as PL
from tessera.operators import split as SP
from tessera.operators import trees as T
from tessera.operators.clean import CleanConfig, Cleaner
from tessera.operators.registry import Registry
from tessera.plans import training
from tessera.session import scratch_path

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] - x[:, 1] * x[:, 2] + 0.7 * rng.normal(size=600) > 0).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(t), i % 3) for i, (r, t) in enumerate(zip(x, y))],
                                 "id long, a double, b double, c double, label int, fold int")


def jobs(spark, what) -> int:
    """Spark jobs of a call, by the status tracker."""
    sc = spark.sparkContext
    sc.setJobGroup("counted", "counted")
    what()
    n = len(sc.statusTracker().getJobIdsForGroup("counted"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    return n


@pytest.mark.parametrize("algo,params", [("rf", {"n_estimators": 40, "max_depth": 8}), ("gb", {"n_estimators": 40, "max_depth": 3}),
                                         ("svc", {"C": 1.0})])
def test_f1_a_fit_is_few_jobs(spark, noisy, algo, params):
    """Levels of trees and steps of a machine are no Spark jobs while the rows fit a task."""
    assert jobs(spark, lambda: ML.fit(noisy, NAMES, algo, params, balanced=True)) <= 20


@pytest.mark.parametrize("algo,params", [("rf", {"n_estimators": 60, "max_depth": 6, "min_samples_leaf": 2}),
                                         ("gb", {"n_estimators": 40, "max_depth": 3, "subsample": 0.8, "min_samples_leaf": 2})])
@pytest.mark.parametrize("balanced", [False, True])
def test_f1_local_trees_are_as_good_as_mllib(noisy, monkeypatch, algo, params, balanced):
    train, test = noisy.filter("fold < 2"), noisy.filter("fold = 2")
    own = ML.fit_evaluate(train, test, NAMES, algo, params, balanced=balanced)[1].first()
    monkeypatch.setattr(T, "LOCAL_CELLS", 0)
    model, theirs = ML.fit_evaluate(train, test, NAMES, algo, params, balanced=balanced)
    assert not isinstance(model.stages[-1], T.TreesModel)
    assert own.roc_auc > theirs.first().roc_auc - 0.03 and own.accuracy > theirs.first().accuracy - 0.05


def test_f1_boosting_without_samples_is_mllibs(noisy, monkeypatch):
    """The same bins, gains and residuals: without random samples boosting has one answer."""
    # few values, so both engines have a threshold between any two
    df = noisy.select("id", *[F.round(c, 0).alias(c) for c in NAMES], "label")
    for leaf in (1, 4):
        params = {"n_estimators": 12, "max_depth": 3, "learning_rate": 0.1, "min_samples_leaf": leaf}
        got = []
        for room in (1 << 23, 0):
            monkeypatch.setattr(T, "LOCAL_CELLS", room)
            got.append([r.prob for r in ML.predict(ML.fit(df, NAMES, "gb", params), df).orderBy("id").collect()])
        assert got[0] == pytest.approx(got[1], abs=1e-9)


def test_f1_hinge_is_the_optimum_of_mllibs_objective(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)) * [1, 3, 0.5, 1]
    y = (x @ [1, -0.4, 0.3, 0] + rng.normal(size=300) > 0.2).astype(float)
    weight, reg = np.where(y == 1, 2.0, 0.7), 1 / 30
    w, b = T.machine(x, y, weight, reg)

    def loss(w, b):
        mean = weight @ x / weight.sum()
        std = np.sqrt(weight @ (x - mean) ** 2 / (weight.sum() - weight @ weight / weight.sum()))
        return weight @ np.maximum(0, 1 - (2 * y - 1) * (x @ w + b)) / weight.sum() + reg / 2 * ((w * std) ** 2).sum()
    df = spark.createDataFrame([(Vectors.dense(r), float(t), float(v)) for r, t, v in zip(x, y, weight)], ["features", "label", "w"])
    theirs = LinearSVC(regParam=reg, maxIter=500, weightCol="w").fit(df)
    assert loss(w, b) <= loss(theirs.coefficients.toArray(), theirs.intercept) + 1e-7
    for _ in range(200):
        dw, db = rng.normal(size=4) * 1e-3, rng.normal() * 1e-3
        assert loss(w, b) <= loss(w + dw, b + db) + 1e-9


def test_f1_fits_do_not_depend_on_partitions(noisy):
    for algo, params in (("rf", {"n_estimators": 10}), ("gb", {"n_estimators": 10, "subsample": 0.7}), ("svc", {"C": 1.0, "n_components": 16})):
        got = [[r.prob for r in ML.predict(ML.fit(df, NAMES, algo, params), noisy).orderBy("id").select("prob").collect()]
               for df in (noisy, noisy.repartition(7, "a"))]
        assert got[0] == pytest.approx(got[1], abs=1e-12)


def test_f1_forests_of_a_grid_are_the_forests_alone(spark, noisy):
    grid = {"rf": {"n_estimators": [5, 12], "max_depth": [None, 3], "min_samples_leaf": [2], "min_samples_split": [2, 9]}}
    train, test = noisy.filter("fold < 2"), noisy.filter("fold = 2")
    assert sorted(map(len, ML._jobs(ML._trials(grid)))) == [4, 4]
    table, models = ML.grid_search(train, test, NAMES, grid)
    for r in table.collect():
        alone, m = ML.fit_evaluate(train, test, NAMES, "rf", json.loads(r.params))
        assert (r.roc_auc, r.accuracy, r.log_loss) == pytest.approx((m.first().roc_auc, m.first().accuracy, m.first().log_loss), abs=1e-12)
        assert np.allclose(ML.feature_importance(models[r.trial_no], ["0", "1", "2"])[0][1], ML.feature_importance(alone, ["0", "1", "2"])[0][1])
    path = scratch_path(spark, "forest")
    models[0].write().overwrite().save(path)
    again = PipelineModel.load(path)
    assert ML.predict(again, test).select("prob").collect() == ML.predict(models[0], test).select("prob").collect()


def test_f1_trees_split_as_brute_force():
    """Root of one tree against every threshold tried, with limits kept in all nodes."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 9, (200, 3)).astype(float)
    x[rng.random((200, 3)) < 0.1] = np.nan
    y = (np.nan_to_num(x[:, 1], nan=9) + rng.normal(size=200) > 5).astype(np.int64)
    cuts = [T.cut_points(x[:, j]) for j in range(3)]
    assert [list(c) for c in cuts] == [[v + 0.5 for v in range(8)]] * 3
    codes, classes = T.coded(x, cuts), np.array([0.6, 2.5])
    tree, at = T.grow(codes, np.arange(200), None, y, classes, 6, 5, 20, 3, rng)

    def gini(part):
        w = classes[part]
        return 0.0 if not len(part) else w.sum() * (1 - (w[part == 0].sum() / w.sum()) ** 2 - (w[part == 1].sum() / w.sum()) ** 2)
    tries = [(gini(y) - gini(y[codes[:, f] <= b]) - gini(y[codes[:, f] > b]), -f, -b) for f in range(3) for b in range(8)
             if min((codes[:, f] <= b).sum(), (codes[:, f] > b).sum()) >= 5]
    gain, f, b = max(tries)
    assert (tree[0]["feature"], tree[0]["bin"], tree[0]["gain"]) == (-f, -b, pytest.approx(gain, rel=1e-6))
    ends = T.leaves(tree, codes, 6)
    assert min(np.unique(ends, return_counts=True)[1]) >= 5
    for n in np.unique(ends):
        w = classes[y[ends == n]]
        assert tree[n]["value"] == pytest.approx(w[y[ends == n] == 1].sum() / w.sum())
    for level in range(len(at) - 1):
        upto = T.leaves(tree, codes, level)
        for n in np.flatnonzero(tree[at[level]:at[level + 1]]["feature"] >= 0) + at[level]:
            assert (upto == n).sum() >= 20


def test_f4_grid_cv_has_all_combinations(spark, noisy, monkeypatch):
    """The registered query fits every combination of all four configured grids."""
    seen = {}
    monkeypatch.setattr(training.ML, "cross_validate", lambda df, features, grids, *a, **k: seen.update(grids) or df)
    monkeypatch.setattr(training, "round_doubles", lambda df: df)
    training.grid_cv(spark, "/root/testdata/sf0.001")
    assert seen == PL.CV_GRIDS and len(ML._trials(seen)) == 71


def test_f4_cross_validation_of_forests_and_machines(noisy):
    """Forests vote where they grow; the accuracies are those of separate fits."""
    grids = {"rf": {"n_estimators": [5, 8], "max_depth": [None, 2], "min_samples_split": [2, 5]},
             "svc": {"C": [1], "kernel": ["linear", "rbf"], "gamma": ["scale", "auto"]}}
    rows = ML.cross_validate(noisy, NAMES, grids, k=3).orderBy("trial_no").collect()
    assert len(rows) == 12
    for r in rows:
        p = json.loads(r.params)
        parts = [ML.predict(ML.fit(noisy.filter(F.col("fold") != f), NAMES, r.algorithm, p), noisy.filter(F.col("fold") == f))
                 .agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0] for f in range(3)]
        assert (r.mean_accuracy, r.min_accuracy, r.max_accuracy) == pytest.approx((sum(parts) / 3, min(parts), max(parts)), abs=1e-12)


def tables(spark, name) -> set[str]:
    return set(glob.glob(scratch_path(spark, f"{name}-*").removeprefix("file:")))


def test_f3_tables_go_when_they_are_read(spark, dirty):
    """Tokens go with the fit, the split is not copied for the trials, scored rows go with their metrics."""
    names = ("tokens", "train", "test", "scored", "clean")
    before = {n: tables(spark, n) for n in names}
    raw = dirty.withColumn("key", F.monotonically_increasing_id())
    config = PL.PipelineConfig("FAULT", "key", CleanConfig(protect=("fault", "key")), {"logreg": {"C": [0.5, 1.0]}}, keep_clean=False)
    out = PL.run_pipeline(raw, config, Registry(spark, scratch_path(spark, "registry-f3")), "r")
    assert {n: tables(spark, n) - before[n] for n in names} == {n: set() for n in names}
    assert out["flags"].count() > 0 and out["runs"].count() == 2 and out["train"].count() + out["test"].count() == 60
    Cleaner(CleanConfig()).fit(dirty)
    clean, _ = Cleaner(CleanConfig()).fit_transform(dirty)
    assert tables(spark, "tokens") == before["tokens"] and clean.count() == 60


def test_f3_split_orders_one_bucket_a_class(spark, monkeypatch):
    rows = [(None if i % 9 == 0 else i % 3, i // 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "label int, id long")
    near, join = [], SP.join_null_safe
    monkeypatch.setattr(SP, "join_null_safe", lambda *a, **k: near.append(join(*a, **k)) or near[-1])
    got = SP.stratified_split(df, "label", "id", 0.3, seed=5)
    assert near[0].count() < 60
    u = df.select("label", "id", F.struct(SP.uniform01(F.col("id"), 5), SP.md5_key(F.col("id"), 5), "id").alias("at")).collect()
    want = {}
    for c in {r.label for r in u}:
        own = sorted(r["at"] for r in u if r.label == c)
        cut = own[int(np.ceil(len(own) * 0.3)) - 1]
        want |= {(c, r.id): "test" if r["at"] <= cut else "train" for r in u if r.label == c}
    assert {(r.label, r.id): r.split for r in got.collect()} == want
    assert [r.n for r in SP.stratified_split(df, "label", "id", 0.3, seed=5, buckets=1).groupBy("split").agg(F.count("*").alias("n"))
            .orderBy("split").collect()] == [list(want.values()).count(x) for x in ("test", "train")] or len(want) < 3000


@pytest.mark.parametrize("balanced", [False, True])
def test_f3_newton_is_mllibs_optimum(spark, noisy, monkeypatch, balanced):
    """The same model as MLlib's, with no copy of the rows kept."""
    params = {"C": 0.05, "max_iter": 400}
    df = noisy.withColumn("b", F.col("b") * 30 + 7).withColumn("fixed", F.lit(2.0))
    kept = []
    sums = ML._logit_sums
    monkeypatch.setattr(ML, "_logit_sums", lambda *a: kept.append(len(spark.sparkContext._jsc.getPersistentRDDs())) or sums(*a))
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    own = ML.fit(df, [*NAMES, "fixed"], "logreg", params, balanced=balanced).stages[-1]
    assert kept and max(kept) <= before
    monkeypatch.setattr(ML, "NEWTON_FEATURES", 0)
    theirs = ML.fit(df, [*NAMES, "fixed"], "logreg", params, balanced=balanced).stages[-1]
    assert own.coefficients.toArray() == pytest.approx(theirs.coefficients.toArray(), abs=1e-4)
    assert own.intercept == pytest.approx(theirs.intercept, abs=1e-4) and own.getRegParam() == theirs.getRegParam()
    assert ML.fit(df.filter("label = 1"), NAMES, "logreg", params) is not None


@pytest.mark.parametrize("room", [0, 30, 100_000])
def test_f2_each_column_is_ordered_once(spark, monkeypatch, room):
    """Whatever the number of NULL patterns, a value of a column is one row of the order, and the
    coefficients are pandas'."""
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({c: np.round(rng.normal(size=400), d) for c, d in zip("abcdef", (5, 5, 0, 5, 1, 5))})
    pdf["b"] += pdf["a"]
    pdf["f"] = pdf["b"]
    for c, k in zip("bcde", (3, 5, 7, 3)):
        pdf.loc[pdf.index % k == 0, c] = np.nan
    pdf["g"] = np.where(pdf.index < 3, 1.5, np.nan)
    seen = []
    order = R.ordered_prefix
    monkeypatch.setattr(R, "LOOKUP", room)
    monkeypatch.setattr(R, "ordered_prefix", lambda counts, *a, **k: seen.append(counts.count()) or order(counts, *a, **k))
    got = {(r.a, r.b): (r.r, r.n) for r in R.spearman_pairs(spark.createDataFrame(pdf), list(pdf.columns)).collect()}
    assert seen == [sum(pdf[c].nunique() for c in pdf.columns)] and len(got) == 21
    for (a, b), (r, n) in got.items():
        both = pdf[[a, b]].dropna()
        assert n == len(both)
        assert r is None if "g" in (a, b) else r == pytest.approx(both[a].rank().corr(both[b].rank()), abs=1e-12)
