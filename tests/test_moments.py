"""Masked Gram matrices, rank correlations with NULLs, exact quantiles by counting."""

import math

import numpy as np
import pandas as pd
import pytest

from tessera.functions.stats import t_pvalue
from tessera.operators import correlation as R
from tessera.operators.gram import BLOCK, gram
from tessera.operators.quantiles import quantile_columns, quantiles


def wide_table(rows=300, p=86, seed=1):
    """p columns in five NULL patterns, with a constant, duplicates, ties and a large mean."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(rows, 6))
    x = base @ rng.normal(size=(6, p)) + 0.5 * rng.normal(size=(rows, p))
    x[:, 1] = np.round(x[:, 1])
    x[:, 2] += 1e8
    x[:, 3] = 7.0
    x[:, 4] = x[:, 0]
    masks = [np.zeros(rows, bool), rng.random(rows) < 0.1, rng.random(rows) < 0.3, np.arange(rows) % 3 == 0, rng.random(rows) < 0.5]
    for c in range(5, p):
        x[masks[c % 5], c] = np.nan
    return pd.DataFrame(x, columns=[f"v{i}" for i in range(p)])


def frame(spark, pdf, parts=5):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in pdf.columns)).repartition(parts)


def test_gram_pearson_wide(spark):
    pdf = wide_table(p=BLOCK + 7)                      # two column blocks
    df = frame(spark, pdf)
    g = gram(df, pdf.columns)
    want = pdf.corr().to_numpy()
    want[3, :] = want[:, 3] = np.nan
    got = g.pearson()
    np.fill_diagonal(want, np.where(np.arange(len(want)) == 3, np.nan, 1.0))
    assert np.allclose(got, want, atol=1e-7, equal_nan=True)
    assert (g.n == pdf.notna().to_numpy().astype(int).T @ pdf.notna().to_numpy().astype(int)).all()
    assert np.allclose(g.means(), pdf.mean().to_numpy())
    whole = pdf[["v0", "v1", "v2"]]
    assert np.allclose(gram(df, whole.columns).covariance(), whole.cov().to_numpy(), atol=1e-6)


def test_gram_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert np.isnan(gram(df, ["a", "b"]).pearson()[0]).all()
    assert gram(df.limit(0), ["a", "b"]).n.sum() == 0
    assert {tuple(r) for r in R.pearson_pairs(df, ["a", "b"]).collect()} == {("a", "b", None)}
    assert R.spearman_pairs(df, ["a", "b"]).first().r is None


def test_spearman_wide_with_nulls(spark):
    pdf = wide_table(p=20)
    got = {(r.a, r.b): (r.r, r.n) for r in R.spearman_pairs(frame(spark, pdf), pdf.columns).collect()}
    want = pdf.corr(method="spearman")
    for (a, b), (r, n) in got.items():
        assert n == int((pdf[a].notna() & pdf[b].notna()).sum())
        if "v3" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)
    assert len(got) == 190
    target = {r.feature: r for r in R.spearman_target(frame(spark, pdf), ["v5", "v9", "v3"], "v0", with_pvalue=True).collect()}
    assert target["v5"].r == pytest.approx(want.loc["v5", "v0"]) and target["v3"].r is None and target["v3"].p_value is None
    assert target["v9"].p_value == pytest.approx(t_pvalue(target["v9"].r, target["v9"].n))


def test_spearman_jobs_do_not_grow_with_columns(spark):
    """The number of jobs is that of a few columns."""
    tracker = spark.sparkContext.statusTracker()

    def jobs(p):
        pdf = wide_table(rows=80, p=p)
        group = f"columns-{p}"
        spark.sparkContext.setJobGroup(group, group)
        R.spearman_pairs(frame(spark, pdf, 2), pdf.columns)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))
    assert jobs(86) <= jobs(8) + 2


def test_vif_prunes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 0] + 0.7 * x[:, 1], "c": x[:, 2] + 0.5 * x[:, 1], "const": 3.0})
    pdf["copy"], pdf["near"], pdf["neg"] = pdf["b"], pdf["c"] * (1 + 1e-6) + 1e-4 * x[:, 1], -pdf["a"]
    pdf.loc[::7, "c"] = np.nan
    pdf.loc[3, "a"] = np.inf
    got = {r.variable: r.vif for r in R.vif(frame(spark, pdf), pdf.columns).collect()}
    whole = pdf.replace(np.inf, np.nan).dropna()
    r = np.linalg.inv(whole[["a", "b", "c"]].corr().to_numpy())
    assert got == pytest.approx(dict(zip("abc", np.diag(r))), rel=1e-8)


def test_t_pvalue():
    """Closed forms for 3 to 6 pairs, symmetry, and the normal limit."""
    for r in (-0.95, -0.3, 0.0, 1e-9, 0.5, 0.999):
        a = abs(r)
        assert t_pvalue(r, 3) == pytest.approx(1 - 2 * math.asin(a) / math.pi, rel=1e-12)
        assert t_pvalue(r, 4) == pytest.approx(1 - a, rel=1e-12)
        assert t_pvalue(r, 5) == pytest.approx(1 - 2 / math.pi * (math.asin(a) + a * math.sqrt(1 - a * a)), rel=1e-9, abs=1e-15)
        assert t_pvalue(r, 6) == pytest.approx(1 - (3 * a - a ** 3) / 2, rel=1e-9, abs=1e-15)
    assert t_pvalue(2.0 / math.sqrt(1e8), 10 ** 8) == pytest.approx(math.erfc(math.sqrt(2.0)), rel=1e-6)
    assert t_pvalue(0.99, 10 ** 6) == 0.0 and t_pvalue(None, 5) is None and t_pvalue(1.0, 9) == 0.0 and t_pvalue(0.1, 2) is None


@pytest.mark.parametrize("parts", [1, 6])
def test_exact_quantiles(spark, parts):
    rng = np.random.default_rng(5)
    n = 20001
    pdf = pd.DataFrame({"ties": rng.integers(0, 30, n).astype(float), "smooth": rng.normal(size=n), "hot": np.where(np.arange(n) % 3 == 0, 0.5, rng.random(n)),
                        "tail": np.exp(rng.normal(size=n) * 20), "gap": np.where(rng.random(n) < 0.1, np.nan, rng.random(n) - 1e9), "same": -0.0,
                        "g": rng.choice(["x", "y", None], n, p=[0.6, 0.399, 0.001])})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                               "ties double, smooth double, hot double, tail double, gap double, same double, g string").repartition(parts)
    cols, probs = [c for c in pdf.columns if c != "g"], (0.0, 0.001, 0.25, 0.5, 0.9, 1.0)
    names = [f"q{i}" for i in range(len(probs))]
    for r in quantile_columns(df, cols, probs, names).collect():
        assert [r[x] for x in names] == pytest.approx(list(pdf[r.col].quantile(list(probs))), rel=1e-14), r.col
    got = quantile_columns(df, cols, probs, names, by=["g"]).collect()
    assert len(got) == len(cols) * 3
    for r in got:
        own = pdf[pdf.g.isna()] if r.g is None else pdf[pdf.g == r.g]
        assert [r[x] for x in names] == pytest.approx(list(own[r.col].quantile(list(probs))), rel=1e-14)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan"))], "a double, b double")
    assert {tuple(r) for r in quantile_columns(df, ["a", "b"], (0.5,), ("m",)).collect()} == {("a", None), ("b", 1.0)}
    assert quantiles(df.limit(0), ["a", "b"], (0.5,)).count() == 0


def test_quantiles_when_the_sketch_is_off(spark, monkeypatch):
    """Stretches that miss a position are widened until they hold it."""
    import tessera.operators.quantiles as Q
    real, tried = Q._bounds, []

    def shifted(rows, cols, edges, by):
        tried.append(edges)
        return real(rows, cols, [min(1.0, e + 0.5) for e in edges] if len(tried) == 1 else edges, by)
    monkeypatch.setattr(Q, "_bounds", shifted)
    v = np.random.default_rng(8).normal(size=5000)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    assert quantiles(df, ["v"], (0.3,)).first().value == pytest.approx(np.quantile(v, 0.3), rel=1e-14)
    assert len(tried) == 2
