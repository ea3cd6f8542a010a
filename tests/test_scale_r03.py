"""Plans and results behind the findings on time and memory of round 3."""

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tessera.operators import clean as C
from tessera.operators import correlation as R
from tessera.operators import knn as K
from tessera.operators import models as ML
from tessera.operators import quantiles as Q
from tessera.session import cut_lineage, scratch_path


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dropna_any_derives_cells_once(spark):
    """The drop's condition is not pushed below the steps that made the cells."""
    raw = spark.createDataFrame([(" a ", "　", "1"), ("b", "x", None), ("c", "y", " 2"), ("d", "n/a", "3")], "`A B` string, b string, c string")
    made = C.tokens_to_null(C.rename_columns(raw.select(*[F.concat(F.col(f"`{c}`"), F.lit(" ")).alias(c) for c in raw.columns])))
    out = C.dropna_any(made, ["a_b", "b"])
    assert [tuple(r) for r in out.orderBy("a_b").collect()] == [("b", "x", None), ("c", "y", "2")]
    assert out.schema.simpleString() == made.schema.simpleString()
    assert optimized(out).count("trim(") <= 2 * len(raw.columns)


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=400) > 0).astype(int)
    # one file: boosting draws its samples by place, so the rows of equal fits are in one order
    df = cut_lineage(spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))],
                                           "id long, a double, b double, c double, label int").coalesce(1))
    return df.filter("id % 4 > 0"), df.filter("id % 4 = 0")


GRID = {"gb": {"n_estimators": [3, 5], "learning_rate": [0.1], "max_depth": [3], "subsample": [0.8]},
        "knn": {"n_neighbors": [3, 6], "weights": ["distance", "uniform"]}, "logreg": {"C": [1.0], "solver": ["liblinear", "saga"]}}


def test_grid_search_shares_fits_with_equal_results(spark, noisy, monkeypatch):
    """Trials that share a fit have the model and the metrics they have alone, and fits and searches are not repeated."""
    train, test = noisy
    features = ["a", "b", "c"]
    alone = {}
    for algo, p in ML._trials(GRID):
        model, m = ML.fit_evaluate(train, test, features, algo, p)
        alone[json.dumps([algo, p], sort_keys=True)] = model, m.first()
    calls = []
    fit, search = ML.fit, K.knn_search
    monkeypatch.setattr(ML, "fit", lambda *a, **k: calls.append(a[2]) or fit(*a, **k))
    monkeypatch.setattr(K, "knn_search", lambda *a, **k: calls.append("search") or search(*a, **k))
    table, models = ML.grid_search(train, test, features, GRID)
    assert sorted(calls) == ["gb", "knn", "logreg", "search"]
    rows = table.collect()
    assert len(rows) == 8
    for r in rows:
        model, m = alone[json.dumps([r.algorithm, json.loads(r.params)], sort_keys=True)]
        for name in ("accuracy", "precision", "recall", "f1_score", "roc_auc", "log_loss"):
            assert r[name] == pytest.approx(m[name], abs=1e-12)
        want, got = (ML.predict(x, test).select("id", "prob").orderBy("id").collect() for x in (model, models[r.trial_no]))
        assert [x.prob for x in got] == pytest.approx([x.prob for x in want], abs=1e-12)


def test_first_trees_can_be_stored(spark, noisy):
    train, test = noisy
    model = ML.first_trees(ML.fit(train, ["a", "b", "c"], "gb", {"n_estimators": 6}), 4)
    path = scratch_path(spark, "first-trees")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    assert again.stages[-1].getNumTrees == 4
    assert len(ML.feature_importance(again, ["a", "b", "c"])) == 3
    assert ML.predict(again, test).select("prob").collect() == ML.predict(model, test).select("prob").collect()


def test_cross_validation_shares_fits(spark, noisy, monkeypatch):
    df = noisy[0].withColumn("fold", (F.col("id") % 3).cast("int"))
    grids = {a: GRID[a] for a in ("knn", "logreg")}
    calls = []
    fit = ML.fit
    monkeypatch.setattr(ML, "fit", lambda *a, **k: calls.append(a[2]) or fit(*a, **k))
    rows = ML.cross_validate(df, ["a", "b", "c"], grids, k=3).orderBy("trial_no").collect()
    assert sorted(calls) == ["knn"] * 3 + ["logreg"] * 3
    assert [(r.trial_no, r.algorithm) for r in rows] == [(i, "knn") for i in range(4)] + [(4, "logreg"), (5, "logreg")]
    monkeypatch.setattr(ML, "fit", fit)
    for r in rows:
        p = json.loads(r.params)
        parts = [ML.predict(ML.fit(df.filter(F.col("fold") != f), ["a", "b", "c"], r.algorithm, p), df.filter(F.col("fold") == f))
                 .agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0] for f in range(3)]
        assert (r.mean_accuracy, r.min_accuracy, r.max_accuracy) == pytest.approx((sum(parts) / 3, min(parts), max(parts)), abs=1e-12)


def test_knn_requests_leave_in_pieces():
    """Where no cell can be excluded, a piece of requests is bounded in numbers whatever the number of cells."""
    rng = np.random.default_rng(2)
    pivots, queries = rng.normal(size=(3000, 64)), rng.normal(size=(500, 64))
    batch = pd.DataFrame({"qid": np.arange(500), "vec": list(queries), "cell": np.arange(500) % 3000, "r": np.inf})
    seen = set()
    for out in K._other_cells(pivots, np.full(3000, 1.0))([batch]):
        assert len(out) * 64 <= K.PIECE
        seen.update(zip(out["qid"], out["cell"]))
        assert all(v is queries[i] or np.array_equal(v, queries[i]) for i, v in list(zip(out["qid"], out["vec"]))[:3])
    assert seen == {(i, c) for i in range(500) for c in range(3000) if c != i % 3000}


@pytest.mark.parametrize("room", [0, 40, 100_000])
def test_spearman_same_for_any_lookup(spark, monkeypatch, room):
    """Looked-up and joined ranks give pandas' Spearman; columns of few values are no keys of a join."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"few": rng.integers(0, 4, 300).astype(float), "many": rng.normal(size=300), "same": 4.0, "more": rng.normal(size=300)})
    pdf["many"] += pdf["few"]
    pdf.loc[pdf.index % 7 == 0, "more"] = np.nan
    pdf.loc[pdf.index % 5 == 0, "few"] = np.nan
    pdf.loc[1, "few"] = -0.0
    seen = []
    vectors = R._rank_vectors
    monkeypatch.setattr(R, "LOOKUP", room)
    monkeypatch.setattr(R, "_rank_vectors", lambda *a: seen.append(a[4]) or vectors(*a))
    got = {(r.a, r.b): (r.r, r.n) for r in R.spearman_pairs(spark.createDataFrame(pdf), list(pdf.columns)).collect()}
    for (a, b), (r, n) in got.items():
        both = pdf[[a, b]].dropna()
        assert n == len(both)
        assert r is None if "same" in (a, b) else r == pytest.approx(both[a].rank().corr(both[b].rank()), abs=1e-12)
    assert len(seen[0]) > 0 if room else not seen[0]


def test_quantile_cells_are_counted_without_records(monkeypatch):
    """Cells of a batch are counted by plain keys (sorting records took most of the profile's time)."""
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(3000, 3)), 2)
    v[rng.random((3000, 3)) < 0.2] = np.nan
    fixed = np.tile(np.array([-0.5, 0.0, 0.5]), (3, 1))
    g = rng.integers(0, 2, 3000) * (1 << 40)
    batch = pa.RecordBatch.from_arrays([pa.array(g), pa.array(list(np.where(np.isnan(v), None, v)), pa.list_(pa.float64()))], names=["_g", "_values"])
    monkeypatch.setattr(np.rec, "fromarrays", None)
    count = Q._count_cells(3, 3, [False, True, True, False], fixed)
    out = pd.concat([b.to_pandas() for b in count([batch, batch.slice(0, 0)])])
    assert out["_n"].sum() == np.count_nonzero(~np.isnan(v))
    for (group, col, value), n in out[out["_v"].notna()].groupby(["_g", "_col", "_v"])["_n"].sum().items():
        assert n == np.count_nonzero((g == group) & (v[:, col] == value)) and -0.5 < value < 0.5
    for (group, col, cut), n in out[out["_cut"].notna()].groupby(["_g", "_col", "_cut"])["_n"].sum().items():
        assert n == np.count_nonzero((g == group) & (v[:, col] == cut))
