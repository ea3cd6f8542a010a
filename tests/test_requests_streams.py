"""Request envelopes, windowed drift metrics with late rows, findings, distinct counts, casts, sinks."""

import datetime as dt
import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import clean as C
from tessera.operators import metrics as M
from tessera.operators import profile as P
from tessera.operators import scoring as S
from tessera.session import scratch_path
from tessera.sources import files as FS
from tessera.streaming import jobs as J

LOGIT = S.LinearLogit({"a": 1.0, "b": -1.0}, 0.0)


def test_one_response_per_request(spark):
    bodies = [(1, '{"records": [{"a": 2, "b": 0}, {"a": "x"}, 5, {"b": 3, "other": [1, 2]}, null], "return_probabilities": true}'),
              (2, '{"records": [{"a": 1}], "return_probabilities": false}'), (3, '{"records": []}'), (4, "not json"), (5, '{"rows": []}'), (6, None),
              (7, '{"records": [{"a": 0}]}')]
    out = {r.id: r for r in S.score_requests(spark.createDataFrame(bodies, "id long, body string").repartition(3), "id", "body", LOGIT, ["a", "b"],
                                             meta={"version": "v1", "algorithm": "logit"}).collect()}
    assert len(out) == 7 and out[1].n_records == 5 and out[1].bad_records == [2, 4] and out[1].error is None
    assert out[1].predictions == [1, 1, None, 0, None]
    assert out[1].probabilities[0] == pytest.approx(1 / (1 + math.exp(-2))) and out[1].probabilities[1] == 0.5 and out[1].probabilities[2] is None
    assert out[1].interpretations[3] == S.LOW_WITH_CONF % (100 / (1 + math.exp(3)))
    assert out[2].probabilities is None and out[2].predictions == [1] and out[2].interpretations == [S.HIGH]
    assert out[3].predictions == [] and out[3].bad_records == [] and out[3].error is None
    assert all(out[i].error and out[i].predictions is None for i in (4, 5, 6))
    assert out[7].model_version == "v1" and out[7].algorithm == "logit"
    with pytest.raises(ValueError):
        S.score_requests(spark.createDataFrame(bodies, "id long, body string"), "id", "body", LOGIT, [])


def scored(spark, n=4000, seed=6):
    rng = np.random.default_rng(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        p = float(rng.random())
        rows.append((i, start + dt.timedelta(minutes=int(i * 2)), int(rng.random() < p), p, int(p >= 0.5)))
    return spark.createDataFrame(rows, "id long, ts timestamp, label int, prob double, prediction int")


def test_binned_metrics_near_exact(spark):
    df = scored(spark)
    exact = M.evaluate(df).first()
    got = M.binned_metrics(M.binned_counts(df, "label", "prediction", "prob", [F.lit(1).alias("k")], 4096), ["k"]).first()
    for name in ("n", "accuracy", "precision", "recall", "f1_score", "log_loss"):
        assert got[name] == pytest.approx(exact[name])
    assert got.roc_auc == pytest.approx(exact.roc_auc, abs=1e-4)


def test_stream_equals_batch_with_late_rows(spark):
    """Files one after the other; rows behind the watermark are left out, all else is as in a batch."""
    df = scored(spark)
    cut = dt.datetime(2024, 1, 4)
    folder = scratch_path(spark, f"drift-{uuid.uuid4().hex[:8]}")
    base = spark.createDataFrame([(0.9,)], "roc_auc double")
    parts = [df.filter(F.col("ts") < F.lit(cut)), df.filter(F.col("ts") >= F.lit(cut)),
             df.filter("id < 50").withColumn("prob", F.lit(0.99)), df.filter("id = 3999").withColumn("ts", F.lit(dt.datetime(2024, 2, 1)))]
    for i, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(folder)
        # the file source takes files by their time of change
        if i < len(parts) - 1:
            spark.sparkContext._jvm.java.lang.Thread.sleep(1100)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = J.drift_windows(stream, base, "ts")
    got = spark.read.parquet(J.run_available_now(out, "late")).orderBy("day").collect()
    want = J.drift_windows(df, base, "ts").filter("day < '2024-02'").orderBy("day").collect()
    assert [r.day for r in got] == [r.day for r in want]
    for a, b in zip(got, want):
        assert a.n == b.n and a.alert == b.alert
        assert [a[c] for c in ("accuracy", "f1_score", "roc_auc", "log_loss", "delta_roc_auc")] == \
            pytest.approx([b[c] for c in ("accuracy", "f1_score", "roc_auc", "log_loss", "delta_roc_auc")])


def test_findings_and_distinct_counts(spark):
    df = spark.createDataFrame([(1, 0.0, "a", None), (2, -0.0, "a", None), (3, 5.0, None, None)], "i long, x double, s string, e string")
    rep = {r.col: r for r in C.dtype_report(df, ["i"]).collect()}
    assert (rep["x"].uniques, rep["x"].nulls, rep["x"].is_categorical) == (2, 0, False)
    assert (rep["s"].uniques, rep["s"].nulls, rep["s"].is_categorical) == (1, 1, True)
    assert (rep["e"].uniques, rep["e"].nulls) == (0, 3) and rep["i"].is_categorical
    assert C.dtype_report(df.limit(0)).agg(F.sum("uniques")).first()[0] == 0
    vifs = spark.createDataFrame([("i", 12.0), ("x", 2.0)], "variable string, vif double")
    found = {r.finding: r for r in P.findings(P.profile_flags(df), vifs).collect()}
    assert found["vif"].columns == ["i"] and found["missing"].columns == ["e", "s"] and found["zeros"].n == 0 and found["zeros"].advice


def test_cast_types_and_matrix_with_nulls(spark):
    df = spark.createDataFrame([("1", "x", 2), ("n/a", None, 3)], "a string, b string, c int")
    out = C.cast_types(df, ["b"])
    assert dict(out.dtypes) == {"a": "double", "b": "string", "c": "double"} and out.filter("a is null").count() == 1
    with pytest.raises(ValueError):
        C.cast_types(df, ["nope"])
    y = spark.createDataFrame([(0, 1), (1, 1), (None, 0), (1, None)], "y int, p int")
    m = {(r.actual, r.pred): r.n for r in M.confusion_matrix(y, "y", "p").collect()}
    assert len(m) == 9 and m[(None, 0)] == 1 and m[(1, None)] == 1 and m[(0, 0)] == 0 and sum(m.values()) == 4


def test_json_sink(spark):
    df = spark.createDataFrame([(1, None, [1, 2]), (2, "x", [])], "a long, b string, c array<long>")
    back = FS.load_dataset(spark, FS.save_dataset(df, scratch_path(spark, f"sink-{uuid.uuid4().hex[:8]}.json")))
    assert sorted(back.select("a", "b", "c").collect()) == sorted(df.collect())
