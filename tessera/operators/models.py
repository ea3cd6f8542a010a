"""Binary classifiers on Spark ML and their evaluation.

* ``fit`` by name: ``logreg`` (L2/L1, C -> regParam = 1 / (C * sum of weights); L2 by Newton's method), ``rf`` (random
  forest), ``gb`` (gradient-boosted trees), ``svc`` (RBF kernel approximated by random Fourier
  features - Rahimi & Recht 2007 - or a linear kernel, then LinearSVC), ``knn`` (``knn.py``).
  ``class_weight="balanced"`` weighs rows by n / (classes * class size).
* The SVC's probabilities are Platt-scaled on out-of-fold margins: the rows are dealt to folds by
  a hash of their features, each fold's margins come from a machine that never saw it.
* ``fit_evaluate``: fit on a train frame, exact metrics on the test frame
  (``metrics.evaluate``: tie-aware AUC, not the 1000-bin evaluator).
* ``param_grid``: cartesian product in sorted-key order.
* ``grid_search``: trials on one split written once, submitted from a thread pool so Spark
  runs several fits at once; returns the run table sorted by score.  ``cross_validate``: the
  same with folds.
* Every fitted model can be saved and loaded again (``stored.py``).
* ``rf``, ``gb`` and ``svc`` over up to ``trees.LOCAL_CELLS`` numbers are one Spark job a fit (``trees.py``), over
  more they are MLlib's.

A ``max_depth`` above 30 is refused.  Where MLlib has no counterpart of a parameter: ``max_depth`` None is
its greatest depth, 30; ``min_samples_split`` s becomes ceil(s / 2) rows per child, which keeps nodes of
fewer than s rows whole (both hold for fits over more than ``LOCAL_CELLS`` numbers only); ``solver``
does not change the optimum.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LinearSVC, LogisticRegression,
                                       LogisticRegressionModel, RandomForestClassifier)
from pyspark.ml.common import _py2java
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import q
from tessera.operators import trees as T
from tessera.operators.knn import KnnModel
from tessera.operators.metrics import evaluate
from tessera.operators.split import with_class_weights
from tessera.operators.stored import Stored
from tessera.session import cut_lineage, discard

ALGORITHMS = ("logreg", "rf", "gb", "svc", "knn")
#: an iterative fit reads its rows in tasks of about so many, not in many near-empty ones
TASK_ROWS = 50_000
#: an L2 logistic regression of so many features takes Newton steps
NEWTON_FEATURES = 256
SCALED = {"logreg", "svc", "knn"}


def standardised(features, mean, std):
    """One array of doubles: (x - mean) / std per feature."""
    return F.array(*[(F.col(q(c)).cast("double") - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(features, mean, std)])


class RandomFourierFeatures(Stored):
    """Standardised x to sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), in one matrix product per
    Arrow batch.  ``n_components`` 0 leaves x as it is (the linear kernel)."""

    def __init__(self, features=(), mean=(), std=(), n_components: int = 64, gamma=None, seed: int = 42, output: str = "features_rff"):
        super().__init__()
        self.features, self.mean, self.std = list(features), list(mean), list(std)
        self.n_components, self.gamma, self.seed, self.output = int(n_components), gamma, seed, output

    def state(self) -> dict:
        return {"features": self.features, "mean": self.mean, "std": self.std, "n_components": self.n_components,
                "gamma": self.gamma, "seed": self.seed, "output": self.output}

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        p = len(self.features)
        # "scale" and "auto" are both 1 / p on inputs of unit variance
        gamma = 1.0 / max(p, 1) if self.gamma in (None, "scale", "auto") else float(self.gamma)
        rng = np.random.default_rng(self.seed)
        return rng.normal(0.0, math.sqrt(2.0 * gamma), (self.n_components, p)), rng.uniform(0.0, 2 * math.pi, self.n_components)

    def projected(self, x: np.ndarray) -> np.ndarray:
        if not self.n_components:
            return x
        w, b = self.weights()
        return np.cos(x @ w.T + b) * math.sqrt(2.0 / self.n_components)

    def _transform(self, df: DataFrame) -> DataFrame:
        own = self

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            return pd.Series(list(own.projected(np.stack(x.to_numpy())))) if len(x) else pd.Series([], dtype=object)
        x = standardised(self.features, self.mean, self.std)
        return df.withColumn(self.output, array_to_vector(project(x) if self.n_components else x))


class PlattSVCModel(Stored):
    """Random features, margin, and sigmoid(a * margin + b) as probability, in one stage."""

    def __init__(self, rff=None, coefficients=(), intercept: float = 0.0, a: float = 1.0, b: float = 0.0):
        super().__init__()
        self.rff = RandomFourierFeatures(**rff) if isinstance(rff, dict) else rff
        self.coefficients, self.intercept, self.a, self.b = list(coefficients), float(intercept), float(a), float(b)

    def state(self) -> dict:
        return {"rff": self.rff.state(), "coefficients": self.coefficients, "intercept": self.intercept, "a": self.a, "b": self.b}

    def _transform(self, df: DataFrame) -> DataFrame:
        rff, w, c, a, b = self.rff, np.array(self.coefficients), self.intercept, self.a, self.b

        @F.pandas_udf("double")
        def probability(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            margin = rff.projected(np.stack(x.to_numpy())) @ w + c
            return pd.Series(1.0 / (1.0 + np.exp(-np.clip(a * margin + b, -700, 700))))
        return df.withColumn("prob", probability(standardised(rff.features, rff.mean, rff.std))) \
            .withColumn("prediction", (F.col("prob") >= 0.5).cast("int"))


def build_pipeline(algorithm: str, params: dict, features, label: str = "label", weight_col: str | None = None,
                   scale: bool = True, seed: int = 42, n_weight: float | None = None) -> Pipeline:
    va = VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep")
    stages = [va]
    fcol = "_raw"
    if scale and algorithm in SCALED:
        stages.append(StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True))
        fcol = "_scaled"
    kw = dict(featuresCol=fcol, labelCol=label)
    if algorithm == "logreg":
        C = float(params.get("C", 1.0))
        reg = 1.0 / (C * (n_weight or 1.0))
        est = LogisticRegression(regParam=reg, elasticNetParam=1.0 if params.get("penalty") == "l1" else 0.0,
                                 maxIter=int(params.get("max_iter", 500)), standardization=False, **kw)
    elif algorithm == "rf":
        depth = params.get("max_depth") or 30
        per_child = max(int(params.get("min_samples_leaf", 1)), math.ceil(int(params.get("min_samples_split", 2)) / 2))
        est = RandomForestClassifier(numTrees=int(params.get("n_estimators", 300)), maxDepth=int(depth),
                                     minInstancesPerNode=per_child, seed=seed, **kw)
    elif algorithm == "gb":
        est = GBTClassifier(maxIter=int(params.get("n_estimators", 100)), stepSize=float(params.get("learning_rate", 0.1)),
                            maxDepth=int(params.get("max_depth", 3)), subsamplingRate=float(params.get("subsample", 1.0)),
                            minInstancesPerNode=int(params.get("min_samples_leaf", 1)), seed=seed, **kw)
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    if weight_col:
        est.setWeightCol(weight_col)
    stages.append(est)
    return Pipeline(stages=stages)


def _fit_svc(train: DataFrame, features, label, params, seed, weight_col, folds: int = 5) -> PlattSVCModel:
    row = train.agg(F.count(F.lit(1)), *[f(F.col(q(c)).cast("double")) for c in features for f in (F.avg, F.stddev_samp)]).first()
    n, mean, std = row[0], [float(v or 0.0) for v in row[1::2]], [float(v or 0.0) or 1.0 for v in row[2::2]]
    linear = params.get("kernel", "rbf") == "linear"
    rff = RandomFourierFeatures(list(features), mean, std, 0 if linear else int(params.get("n_components", 64)), params.get("gamma"), seed)
    fold = F.pmod(F.xxhash64(*[F.col(q(c)) for c in features], F.lit(seed)), F.lit(folds)).cast("int")
    if n * (rff.n_components or len(mean)) <= T.LOCAL_CELLS:
        number = [F.col(q(c)).cast("double") for c in (*features, label)]
        data = T.fetched(train, [*number, F.col(weight_col) if weight_col else F.lit(1.0), fold])
        return PlattSVCModel(rff, *T.fit_machine(train.sparkSession, data, rff.projected, mean, std, float(params.get("C", 1.0)), folds))
    extra = [F.col(weight_col).alias("_w")] if weight_col else []
    rows = cut_lineage(rff.transform(train).select("features_rff", F.col(q(label)).cast("double").alias("_y"), fold.alias("_fold"), *extra),
                       "svc_rows")

    def machine(part: DataFrame, share: float):
        svc = LinearSVC(featuresCol="features_rff", labelCol="_y", regParam=1.0 / (float(params.get("C", 1.0)) * max(n * share, 1)),
                        maxIter=int(params.get("max_iter", 100)))
        return (svc.setWeightCol("_w") if weight_col else svc).fit(part)

    margins = None
    for f in range(folds):
        unseen = rows.filter(F.col("_fold") == f)
        if rows.filter(F.col("_fold") != f).select("_y").distinct().count() < 2:
            continue
        out = machine(rows.filter(F.col("_fold") != f), 1 - 1 / folds).transform(unseen) \
            .select(vector_to_array("rawPrediction")[1].alias("m"), "_y")
        margins = out if margins is None else margins.unionByName(out)
    whole = machine(rows, 1.0)
    a, b = 1.0, 0.0
    if margins is not None:
        platt = LogisticRegression(featuresCol="_m", labelCol="_y", maxIter=100).fit(
            VectorAssembler(inputCols=["m"], outputCol="_m").transform(margins))
        a, b = float(platt.coefficients[0]), float(platt.intercept)
    return PlattSVCModel(rff, [float(v) for v in whole.coefficients.toArray()], float(whole.intercept), a, b)


def _numbers(df: DataFrame, features, label: str) -> np.ndarray:
    return T.fetched(df, [F.col(q(c)).cast("double") for c in (*features, label)])


def fit(train: DataFrame, features, algorithm: str, params: dict, label: str = "label", balanced: bool = False,
        seed: int = 42, scale: bool = True):
    weight_col = None
    balanced = balanced or params.get("class_weight") == "balanced"
    n = None if algorithm == "knn" else train.count()               # the sum of weights too, when balanced
    if algorithm == "rf" and (params.get("max_depth") or 0) > 30:
        raise ValueError("trees deeper than 30 levels are beyond MLlib")
    if algorithm in ("rf", "gb") and n * len(features) <= T.LOCAL_CELLS:
        return PipelineModel([T.fit_trees(train.sparkSession, _numbers(train, features, label), features, algorithm, params, balanced, seed)])
    if balanced:
        train = with_class_weights(train, label, "_w")
        weight_col = "_w"
    if algorithm == "knn":
        return KnnModel.fit(train, features, label, int(params.get("n_neighbors", 5)), params.get("weights", "distance"), scale)
    train = train.coalesce(max(1, math.ceil(n / TASK_ROWS)))
    if algorithm == "svc":
        return _fit_svc(train, features, label, params, seed, weight_col)
    built = build_pipeline(algorithm, params, features, label, weight_col, scale, seed, n)
    if algorithm == "logreg" and params.get("penalty") != "l1" and len(features) <= NEWTON_FEATURES:
        model = _fit_logit(built, train, features, label, weight_col)
        if model is not None:
            return model
    return built.fit(train)


def _logit_sums(shift: np.ndarray, scale: np.ndarray, v: np.ndarray):
    """A task's sums at coefficients v of (features, label, weight) rows: weights, labels, log-loss, its gradient and
    its second derivatives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(3 + len(v) + len(v) ** 2)
        for batch in batches:
            cells = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
            x = np.column_stack([(cells[:, :-2] - shift) * scale, np.ones(len(cells))])
            y, w = cells[:, -2], cells[:, -1]
            t = x @ v
            p = 1 / (1 + np.exp(-np.clip(t, -700, 700)))
            out += np.concatenate([[w.sum(), w @ y, w @ (np.logaddexp(0, t) - y * t)], (w * (p - y)) @ x,
                                   ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], names=["part"])
    return run


def _fit_logit(built: Pipeline, train: DataFrame, features, label: str, weight_col: str | None) -> PipelineModel | None:
    """The logistic regression of ``built`` by Newton's method: a step is one pass of sums over the rows, and none of
    them is kept (MLlib's solver holds a copy of the rows in memory or on disk for each fit).  None where the
    optimum is not finite: one class only, or values that are no numbers."""
    est = built.getStages()[-1]
    before = Pipeline(stages=built.getStages()[:-1]).fit(train)
    shift, scale = np.zeros(len(features)), np.ones(len(features))
    if len(before.stages) > 1:
        std = before.stages[-1].std.toArray()
        shift, scale = before.stages[-1].mean.toArray(), np.divide(1.0, std, out=np.zeros_like(std), where=std != 0)
    number = [F.col(q(c)).cast("double").alias(f"c{i}") for i, c in enumerate((*features, label, *([weight_col] if weight_col else [])))]
    rows = train.select(*number, *([] if weight_col else [F.lit(1.0).alias("w")]))
    p = len(features)
    ridge = np.append(np.full(p, est.getRegParam()), 0.0)

    def at(v):
        part = rows.mapInArrow(_logit_sums(shift, scale, v), "part array<double>").agg(Summarizer.sum(array_to_vector("part")).alias("s")).first()["s"]
        s = part.toArray()
        total, positive = s[:2]
        return total, positive, s[2] / total + ridge @ (v * v) / 2, s[3:4 + p] / total + ridge * v, s[4 + p:].reshape(p + 1, p + 1) / total + np.diag(ridge)

    v, step = np.zeros(p + 1), 1.0
    total, positive, value, grad, hess = at(v)
    if not np.isfinite(value) or not np.isfinite(grad).all() or not 0 < positive < total:
        return None
    for _ in range(est.getMaxIter()):
        way = np.linalg.lstsq(hess, -grad, rcond=1e-14)[0]
        if -(grad @ way) < 1e-14 * max(value, 1e-3):
            break
        _, _, new, new_grad, new_hess = at(v + step * way)
        if new > value + 1e-14 * abs(value):
            step /= 2
            if step < 1e-6:
                break
            continue
        v, value, grad, hess, step = v + step * way, new, new_grad, new_hess, 1.0
    sc = SparkContext._active_spark_context
    model = LogisticRegressionModel(sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        est.uid, _py2java(sc, Vectors.dense(v[:p])), float(v[p])))
    for param, x in est.extractParamMap().items():
        if model.hasParam(param.name):
            model.set(model.getParam(param.name), x)
    model._transfer_params_to_java()
    return PipelineModel([*before.stages, model])


def predict(model, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    if "prob" not in out.columns:
        out = out.withColumn("prob", vector_to_array("probability")[1]) \
                 .withColumn("prediction", F.col("prediction").cast("int"))
    return out


def fit_evaluate(train: DataFrame, test: DataFrame, features, algorithm: str, params: dict,
                 label: str = "label", balanced: bool = False, seed: int = 42):
    model = fit(train, features, algorithm, params, label, balanced, seed)
    return model, evaluate(_scored(predict(model, test), label), label, "prediction", "prob")


def _scored(predicted: DataFrame, label: str) -> DataFrame:
    """What the metrics read, written once: they pass over it several times, and a model's search or
    trees are run once."""
    return cut_lineage(predicted.select(label, "prediction", "prob"), "scored")


def param_grid(grid: dict) -> list[dict]:
    keys = sorted(grid)
    vals = [grid[k] if isinstance(grid[k], (list, tuple)) else [grid[k]] for k in keys]
    return [dict(zip(keys, combo)) for combo in itertools.product(*vals)]


RUNS = ("trial_no int, algorithm string, params string, accuracy double, precision double, recall double, f1_score double, "
        "roc_auc double, log_loss double, scoring string, score double")


def _trials(grids: dict) -> list[tuple[str, dict]]:
    return [(algo, p) for algo in grids for p in param_grid(grids[algo])]


def _vote(params: dict) -> tuple[int, str]:
    return int(params.get("n_neighbors", 5)), params.get("weights", "distance")


def _jobs(trials: list[tuple[str, dict]]) -> list[list[int]]:
    """Positions of the trials that share one fit: k-NN trials differ in how many of the nearest
    references vote and how, a logistic regression's solver does not change its optimum, boosting
    adds tree by tree, so fewer trees are the first of more, trees of a forest do not depend on each other or on
    what is below them, and on columns of unit variance gamma "scale" is "auto", which a linear machine does
    not have.  The others are fits of their own.
    Longest first, so that none is left to run alone at the end."""
    groups: dict[str, list[int]] = {}
    for i, (algo, p) in enumerate(trials):
        apart = {"knn": ("n_neighbors", "weights"), "logreg": ("solver",), "gb": ("n_estimators",), "rf": ("n_estimators", "max_depth"),
                 "svc": ("gamma",) if p.get("kernel") == "linear" else ()}.get(algo, ())
        same = {"gamma": "scale"} if algo == "svc" and p.get("gamma") == "auto" else {}
        groups.setdefault(json.dumps([algo, {k: v for k, v in (p | same).items() if k not in apart}], sort_keys=True), []).append(i)
    cost = {"rf": 3, "gb": 2, "svc": 1}
    return sorted(groups.values(), key=lambda g: (-cost.get(trials[g[0]][0], 0), -(trials[g[0]][1].get("n_estimators") or 0)))


def first_trees(model: PipelineModel, n: int) -> PipelineModel:
    """The boosted model that a fit of ``n`` trees gives: each tree depends on those before it and on
    its own number only."""
    if isinstance(model.stages[-1], T.TreesModel):
        return PipelineModel([model.stages[-1].first(n)])
    whole = model.stages[-1]._java_obj
    sc = SparkContext._active_spark_context
    trees = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = sc._gateway.new_array(sc._jvm.double, n)
    for i, (tree, w) in enumerate(zip(whole.trees()[:n], whole.treeWeights()[:n])):
        trees[i], weights[i] = tree, w
    first = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"{whole.uid()}_{n}", trees, weights)
    out = GBTClassificationModel(first)
    for param, value in model.stages[-1].extractParamMap().items():
        out.set(out.getParam(param.name), value)
    out.set(out.maxIter, n)
    out._transfer_params_to_java()
    return PipelineModel([*model.stages[:-1], out])


def _fit_score(train: DataFrame, test: DataFrame, features, trials: list[tuple[str, dict]], label: str, balanced: bool, seed: int):
    """(model, scored test rows) of each of the trials of one job (``_jobs``)."""
    algo, params = trials[0]
    if algo == "gb" and len(trials) > 1:
        sizes = [int(p.get("n_estimators", 100)) for _, p in trials]
        whole = fit(train, features, algo, {**params, "n_estimators": max(sizes)}, label, balanced, seed)
        models = [whole if n == max(sizes) else first_trees(whole, n) for n in sizes]
        return [(m, predict(m, test)) for m in models]
    if algo == "rf" and len(trials) > 1:
        shapes = [(int(p.get("n_estimators", 300)), p.get("max_depth")) for _, p in trials]
        depth = None if any(not d for _, d in shapes) else max(d for _, d in shapes)
        widest = {**params, "n_estimators": max(n for n, _ in shapes), "max_depth": depth}
        whole = fit(train, features, algo, widest, label, balanced, seed)
        if isinstance(whole.stages[-1], T.TreesModel):
            models = [PipelineModel([whole.stages[-1].first(n, d)]) for n, d in shapes]
        else:                                       # the draws of MLlib's trees depend on the forest
            models = [whole if p == widest else fit(train, features, algo, p, label, balanced, seed) for _, p in trials]
        return [(m, predict(m, test)) for m in models]
    if algo != "knn":
        model = fit(train, features, algo, params, label, balanced, seed)
        return [(model, predict(model, test))] * len(trials)
    widest = max(_vote(p)[0] for _, p in trials)
    model = fit(train, features, algo, {**params, "n_neighbors": widest}, label, balanced, seed)
    rows, near = model.neighbors(test)
    models = [model.with_vote(*_vote(p)) for _, p in trials]
    return [(m, m.voted(rows, near)) for m in models]


def grid_search(train: DataFrame, test: DataFrame, features, grids: dict, label: str = "label",
                scoring: str = "roc_auc", balanced: bool = False, parallelism: int = 4, seed: int = 42,
                written: bool = False):
    """Run every (algorithm, params) trial on one split written once; returns (run table, models).
    ``written``: the split is read from a table already, so it is not copied."""
    if not written:
        train, test = cut_lineage(train, "train"), cut_lineage(test, "test")

    trials = _trials(grids)

    def run(own):
        parts = _fit_score(train, test, features, [trials[i] for i in own], label, balanced, seed)
        scored = [d.select(F.lit(i).alias("trial_no"), label, "prediction", "prob") for i, (_, d) in zip(own, parts)]
        return {i: model for i, (model, _) in zip(own, parts)}, cut_lineage(reduce(DataFrame.unionByName, scored), "scored")

    models, scored = {}, []
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        for done, part in ex.map(run, _jobs(trials)):
            models.update(done)
            scored.append(part)
    # the rows of all trials are measured in one go
    measured = evaluate(reduce(DataFrame.unionByName, scored), label, "prediction", "prob", by=["trial_no"]).collect()
    found = {r["trial_no"]: r.asDict() for r in measured}
    discard(*scored)
    results = [(models[i], found.get(i, {})) for i in range(len(trials))]
    rows = []
    for i, ((algo, p), (_, r)) in enumerate(zip(trials, results)):
        score = r.get(scoring)
        score = float("-inf") if score is None or (isinstance(score, float) and math.isnan(score)) else float(score)
        rows.append((i, algo, json.dumps(p, sort_keys=True), *map(r.get, ("accuracy", "precision", "recall", "f1_score", "roc_auc", "log_loss")),
                     scoring, score))
    table = train.sparkSession.createDataFrame(rows, RUNS)
    return table.orderBy(F.desc("score"), "trial_no"), {i: model for i, (model, _) in enumerate(results)}


def _forest_accuracies(train: DataFrame, test: DataFrame, features, params: list[dict], label: str, seed: int) -> list[float | None]:
    """Accuracy on the test rows of the forests of one job (``_jobs``): the trees vote where they grow."""
    asked = _numbers(test, features, label)
    if not len(asked):
        return [None] * len(params)
    shares = T.forest_shares(train.sparkSession, _numbers(train, features, label), asked[:, :-1], params[0],
                             [(int(p.get("n_estimators", 300)), p.get("max_depth")) for p in params],
                             params[0].get("class_weight") == "balanced", seed)
    return [float(x) for x in ((shares > 0.5) == asked[:, -1]).mean(axis=1)]


def cross_validate(folds: DataFrame, features, grids: dict, label: str = "label", k: int = 5, parallelism: int = 4,
                   seed: int = 42) -> DataFrame:
    """(trial_no, algorithm, params, mean_accuracy, min_accuracy, max_accuracy): every trial fitted on
    each k - 1 of the folds (column ``fold``) and scored by accuracy on the one left out."""
    folds = cut_lineage(folds, "folds")

    trials = _trials(grids)

    def run(job):
        own, f = job
        train, test = folds.filter(F.col("fold") != f), folds.filter(F.col("fold") == f)
        if trials[own[0]][0] == "rf" and folds.count() * len(features) <= T.LOCAL_CELLS:
            return {(i, f): x for i, x in zip(own, _forest_accuracies(train, test, features, [trials[i][1] for i in own], label, seed))}
        parts = _fit_score(train, test, features, [trials[i] for i in own], label, False, seed)
        right = F.avg((F.col(q(label)) == F.col("prediction")).cast("double"))
        seen: dict[int, float | None] = {}             # trials with one model are scored once
        return {(i, f): seen[id(model)] if id(model) in seen else seen.setdefault(id(model), scored.agg(right).first()[0])
                for i, (model, scored) in zip(own, parts)}

    found = {}
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        for done in ex.map(run, [(own, f) for own in _jobs(trials) for f in range(k)]):
            found.update(done)
    rows = []
    for i, (algo, p) in enumerate(trials):
        own = [x for x in (found[i, f] for f in range(k)) if x is not None]
        rows.append((i, algo, json.dumps(p, sort_keys=True), sum(own) / len(own), min(own), max(own)))
    return folds.sparkSession.createDataFrame(rows, "trial_no int, algorithm string, params string, mean_accuracy double, "
                                                    "min_accuracy double, max_accuracy double")


def feature_importance(model, features, top: int | None = 15) -> list[tuple[str, float]]:
    """(feature, importance) from tree importances or |coefficients| of the final stage."""
    if isinstance(model, PlattSVCModel) and not model.rff.n_components:
        pairs = sorted(zip(features, map(abs, model.coefficients)), key=lambda t: (-t[1], t[0]))
        return pairs[:top] if top else pairs
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    if hasattr(last, "featureImportances"):
        vals = last.featureImportances.toArray()
    elif hasattr(last, "coefficients"):
        vals = np.abs(last.coefficients.toArray())
    else:
        raise ValueError("model exposes no importances")
    pairs = sorted(zip(features, [float(v) for v in vals]), key=lambda t: (-t[1], t[0]))
    return pairs[:top] if top else pairs
