import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import correlation as R
from tessera.operators.rank import rank_table, with_rank


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.integers(0, 40, n).astype(float),
                        "b": rng.normal(size=n).round(2), "g": rng.integers(0, 3, n)})
    pdf["c"] = pdf["a"] * 0.5 + rng.normal(size=n)
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_average_rank_matches_pandas(data, buckets):
    pdf, df = data
    rt = rank_table(df, "a", buckets=buckets).toPandas().set_index("a")["rank"]
    exp = pdf["a"].rank(method="average")
    got = pdf["a"].map(rt)
    assert np.allclose(got.to_numpy(), exp.to_numpy())


def test_grouped_rank_matches_pandas(data):
    pdf, df = data
    got = with_rank(df, "b", "rb", by=["g"]).toPandas().sort_values("id")
    exp = pdf.sort_values("id").groupby("g")["b"].rank(method="average")
    assert np.allclose(got["rb"].to_numpy(), exp.to_numpy())


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_spearman_partition_invariant(data, parts):
    pdf, df = data
    got = {(r.a, r.b): r.r for r in R.spearman_pairs(df.repartition(parts), ["a", "b", "c"]).collect()}
    exp = pdf[["a", "b", "c"]].corr(method="spearman")
    for (x, y), r in got.items():
        assert r == pytest.approx(exp.loc[x, y], abs=1e-9)


def test_spearman_pairwise_nulls(spark):
    pdf = pd.DataFrame({"x": [1.0, 2.0, None, 4.0, 5.0, 6.0], "y": [2.0, 1.0, 3.0, None, 6.0, 5.0]})
    df = spark.createDataFrame(pdf)
    r = R.spearman_pairs(df, ["x", "y"]).first()
    assert r.r == pytest.approx(pdf.corr(method="spearman").loc["x", "y"]) and r.n == 4


def test_vif_matches_ols(spark):
    rng = np.random.default_rng(1)
    n = 500
    x1 = rng.normal(size=n)
    x2 = x1 * 0.8 + rng.normal(size=n) * 0.5
    x3 = rng.normal(size=n)
    pdf = pd.DataFrame({"x1": x1, "x2": x2, "x3": x3, "dup": x1, "const": 1.0})
    got = {r.variable: r.vif for r in R.vif(spark.createDataFrame(pdf), ["x1", "x2", "x3", "dup", "const"]).collect()}
    assert set(got) == {"x1", "x2", "x3"}
    X = pdf[["x1", "x2", "x3"]].to_numpy()
    for i, c in enumerate(["x1", "x2", "x3"]):
        others = np.column_stack([np.ones(n), np.delete(X, i, axis=1)])
        beta, *_ = np.linalg.lstsq(others, X[:, i], rcond=None)
        resid = X[:, i] - others @ beta
        r2 = 1 - resid.var() / X[:, i].var()
        assert got[c] == pytest.approx(1 / (1 - r2), rel=1e-6)


def test_t_pvalue():
    from tessera.functions.stats import t_pvalue
    assert t_pvalue(0.5, 10) == pytest.approx(0.141, abs=1e-3)
    assert t_pvalue(0.0, 30) == pytest.approx(1.0)


def test_skew_kurt_match_pandas(spark):
    from tessera.operators.profile import skew_kurtosis
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"v": rng.exponential(size=400), "k": 2.0})
    r = {x.col: x for x in skew_kurtosis(spark.createDataFrame(pdf), ["v", "k"]).collect()}
    assert r["v"].skew == pytest.approx(pdf["v"].skew()) and r["v"].kurt == pytest.approx(pdf["v"].kurt())
    assert r["k"].skew == 0.0 and r["k"].kurt == 0.0


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_hot_value_third_of_rows(spark, parts):
    """One value holds a third of all rows: ranks, AUC and the split stay exact."""
    from tessera.operators.metrics import roc_auc
    from tessera.operators.split import stratified_split
    rng = np.random.default_rng(9)
    n = 3000
    score = np.where(np.arange(n) % 3 == 0, 0.5, rng.random(n).round(3))
    y = (rng.random(n) < 0.3).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "s": score, "y": y})
    df = spark.createDataFrame(pdf).repartition(parts)
    rt = rank_table(df, "s").toPandas().set_index("s")["rank"]
    assert np.allclose(pdf["s"].map(rt).to_numpy(), pdf["s"].rank(method="average").to_numpy())
    pos, neg = pdf.s[pdf.y == 1].to_numpy(), pdf.s[pdf.y == 0].to_numpy()
    exp = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert roc_auc(df, "y", "s").first().roc_auc == pytest.approx(exp)
    sp = stratified_split(df, "y", "id", 0.2).filter(F.col("split") == "test").groupBy("y").count().collect()
    assert {r.y: r["count"] for r in sp} == {c: int(np.ceil((pdf.y == c).sum() * 0.2)) for c in (0, 1)}
