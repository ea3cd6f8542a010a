import pytest
from pyspark.sql import functions as F

from tessera.operators import clean as C


def test_clean_drops_sparse_and_coerces(dirty):
    model = C.Cleaner(C.CleanConfig(drop_na_thresh=0.95, outlier_z=None, numeric_like_ratio=0.6)).fit(dirty)
    out = model.transform(dirty)
    assert "remark" not in out.columns
    assert "remark" in model.report["dropped_columns"]
    assert dict(out.dtypes)["reading"] == "double"
    assert out.filter(F.col("reading").isNull()).count() == 4
    assert out.filter(F.col("site_label").isNull()).count() == 2
    assert out.filter(F.col("plan_label").isNull()).count() == 3
    assert {"reading", "pressure", "grade"} <= set(model.report["numeric_columns"])
    assert set(out.select("site_label").distinct().toPandas()["site_label"].dropna()) == {"Harbour", "MILL", "Quay"}


def test_clean_keeps_at_higher_threshold(dirty):
    model = C.Cleaner(C.CleanConfig(drop_na_thresh=0.99, outlier_z=4.0, numeric_like_ratio=0.5)).fit(dirty)
    assert "remark" in model.transform(dirty).columns
    assert model.report["dropped_columns"] == []


def test_zscore_masks_planted_outlier(spark):
    rows = [(i, 10.0 + (i % 5)) for i in range(200)] + [(999, 1e6)]
    df = spark.createDataFrame(rows, "id long, v double")
    masked, usable = C.zscore_mask(df, ["v"], 4.0)
    assert masked.filter(F.col("v").isNull()).select("id").collect()[0][0] == 999
    const = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id long, v double")
    m2, u2 = C.zscore_mask(const, ["v"], 4.0)
    assert u2 == {} and m2.filter(F.col("v").isNull()).count() == 0


def test_config_validation():
    with pytest.raises(ValueError):
        C.CleanConfig(drop_na_thresh=1.5)
    with pytest.raises(ValueError):
        C.CleanConfig(outlier_z=-1)


def test_interval_rules_first_failure(spark):
    df = spark.createDataFrame([(1, 5.0, 0.5), (2, 50.0, 0.5), (3, 10.0, 9.0), (4, None, 0.5), (5, 60.0, 9.0)],
                               "id int, a double, b double")
    rules = {"a": (0.0, 20.0), "b": (0.0, 1.0)}
    assert [r.id for r in C.interval_filter(df, rules).collect()] == [1]
    rej = {r.rule: r.n_removed for r in C.interval_rejects(df, rules).collect()}
    assert rej == {"a": 3, "b": 1}


def test_dtype_report_and_dropna(dirty):
    t = C.tokens_to_null(C.rename_columns(dirty))
    rep = {r.col: r for r in C.dtype_report(t).collect()}
    assert rep["reading"].nulls == 4 and rep["remark"].uniques == 1
    assert C.dropna_any(t, ["reading", "site_label"]).count() == 60 - 6


def test_align_and_prepare(spark):
    df = spark.createDataFrame([("1", "x", 2.0, 1), ("bad", "y", None, 0)], "a string, b_label string, c double, t int")
    out, feats, dropped = C.prepare_features(df, "t")
    assert feats == ["a", "c"] and dropped == ["b_label"]
    rows = out.orderBy("label").collect()
    assert rows[0].a == 0.0 and rows[0].c == 0.0 and rows[1].a == 1.0
    al = C.align_features(df, ["c", "missing", "a"])
    assert al.columns == ["c", "missing", "a"] and al.first().missing == 0.0


def test_normalize_binary_target_and_roles(spark):
    from tessera.operators.profile import infer_roles
    df = spark.createDataFrame([(1, 1.0, "a", "x"), (2, 0.0, "b", "y")], "id long, t double, c string, c_label string")
    assert dict(C.normalize_binary_target(df, "t").dtypes)["t"] == "bigint"
    df2 = spark.createDataFrame([(1, 2.0)], "id long, t double")
    assert dict(C.normalize_binary_target(df2, "t").dtypes)["t"] == "double"
    roles = infer_roles(df, target="t", id_cols=["id"])
    assert roles["categorical"] == ["c"] and roles["numeric"] == ["t"] and roles["id"] == ["id"]


def test_append_runs(spark):
    import uuid
    from tessera.session import scratch_path
    from tessera.sources.files import append_runs
    path = scratch_path(spark, f"runs-{uuid.uuid4().hex[:8]}")
    a = spark.createDataFrame([(0, "x", 0.5)], "trial_no int, algorithm string, score double")
    append_runs(a, path)
    append_runs(a.withColumn("trial_no", a.trial_no + 1), path)
    assert spark.read.parquet(path).count() == 2


def test_profile_report_facade(spark):
    import numpy as np
    from tessera.operators.profile import profile_report
    rng = np.random.default_rng(2)
    rows = [(int(i), float(a), float(a * 2 + b), int(a > 0), "x" if i % 2 else "y")
            for i, (a, b) in enumerate(zip(rng.normal(size=200), rng.normal(size=200)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, t int, c string")
    rep = profile_report(df, target="t", id_cols=["id"])
    assert rep["roles"]["numeric"] == ["a", "b", "t"] and rep["roles"]["categorical"] == ["c"]
    assert rep["table"].count() == 5 and rep["strong_pairs"].count() == 1
    assert {r.feature for r in rep["target_spearman"].collect()} == {"a", "b"}
