"""Edge frames: empty, one row, all-NULL / constant columns, header collisions,
non-ASCII headers, non-plain numeric strings, unseen / missing scoring features."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import clean as C
from tessera.operators import correlation as R
from tessera.operators import metrics as M
from tessera.operators import profile as P
from tessera.operators import scoring as S


def test_empty_and_one_row(spark):
    empty = spark.createDataFrame([], "a double, b string")
    assert P.describe(empty, ["a"]).first()["count"] == 0
    assert P.missing_ratio(empty).count() == 2
    one = spark.createDataFrame([(1.5, "x")], "a double, b string")
    d = P.describe(one, ["a"]).first()
    assert d["count"] == 1 and d["std"] is None and d["p50"] == 1.5
    model = C.Cleaner(C.CleanConfig()).fit(one)
    assert model.transform(one).count() == 1


def test_all_null_and_constant_columns(spark):
    df = spark.createDataFrame([(None, 2.0, float(i)) for i in range(10)], "n double, k double, v double")
    sk = {r.col: r for r in P.skew_kurtosis(df, ["n", "k"]).collect()}
    assert sk["n"].skew is None and sk["k"].skew == 0.0
    r = {(x.a, x.b): x.r for x in R.pearson_pairs(df, ["k", "v"]).collect()}
    assert r[("k", "v")] is None                       # constant column: NULL, never an error
    assert R.vif(df, ["k", "v"]).count() == 0           # <= 1 usable column left
    model = C.Cleaner(C.CleanConfig(drop_na_thresh=0.5)).fit(df)
    assert "n" in model.report["dropped_columns"]


def test_header_collision_and_unicode(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`a` int, `A ` int, `a_1` int, `Año Ñ` int")
    names = C.rename_columns(df).columns
    assert len({n.lower() for n in names}) == 4 and names[3] == "año_ñ"


def test_non_plain_numbers_become_null(spark):
    from tessera.functions.values import strict_double
    df = spark.createDataFrame([("1d",), ("1_000",), ("inf",), ("NaN",), (" 2.5 ",), ("-3e2",), ("0x10",)], "s string")
    got = [r[0] for r in df.select(strict_double("s")).collect()]
    assert got == [None, None, None, None, 2.5, -300.0, None]


def test_one_class_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.2)], "y int, yh int, p double")
    r = M.evaluate(df, "y", "yh", "p").first()
    assert r.roc_auc is None and r.recall == 0.5 and r.precision == 1.0


def test_scoring_unseen_and_missing_features(spark):
    df = spark.createDataFrame([(1, "7", "junk", 3.0), (2, None, "x", None)], "id long, value string, other string, extra double")
    model = S.LinearLogit({"value": 0.5, "absent": 1.0}, intercept=-1.0)
    out = S.score_batch(df, model, model.feature_names, keys=["id"]).orderBy("id").collect()
    assert out[0].probability == pytest.approx(1 / (1 + 2.718281828459045 ** -2.5))
    assert out[1].probability == pytest.approx(1 / (1 + 2.718281828459045 ** 1.0))   # all filled with 0
    assert out[1].interpretation.startswith("Low")
    with pytest.raises(ValueError):
        S.score_batch(df, model, [])
