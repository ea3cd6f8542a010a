import os
import uuid

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tessera.session import scratch_path
from tessera.sources import files as FS


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    qs = E.queries()
    a = qs["score_stream"](spark, SF_SMALL)
    b = qs["score_batch"](spark, SF_SMALL)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_monitor_stream_emits_closed_windows(spark):
    import __spark_entry__ as E
    got = E.queries()["drift_stream"](spark, SF_SMALL)
    batch = E.queries()["drift_by_day"](spark, SF_SMALL)
    days = {r.day for r in got.collect()}
    all_days = {r.day for r in batch.collect()}
    assert days and days < all_days or days == all_days


def test_csv_strings_and_errors(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text("a,B c\n,x\n?, 1 \n")
    df = FS.read_csv_strings(spark, str(p))
    rows = df.collect()
    assert df.columns == ["a", "B c"] and rows[0]["a"] == "" and rows[1]["B c"] == " 1 "
    with pytest.raises(FileNotFoundError):
        FS.read_csv_strings(spark, str(tmp_path / "missing.csv"))
    with pytest.raises(ValueError):
        FS.save_dataset(df, str(tmp_path / "out.xlsx"))


def test_headerless_width_check(spark):
    path = scratch_path(spark, f"hl-{uuid.uuid4().hex[:8]}")
    spark.createDataFrame([("1", "2")], "a string, b string").write.option("header", "false").csv(path)
    with pytest.raises(ValueError):
        FS.read_headerless(spark, path, ["x", "y", "z"])
    assert FS.read_headerless(spark, path, ["x"]).columns == ["x"]


def test_json_records(spark, tmp_path):
    from tessera.sources.records import read_json_records
    p = tmp_path / "req.json"
    p.write_text('{"records": [{"a": 1, "b": "x"}, {"a": 2}], "return_probabilities": true}\n')
    rows = read_json_records(spark, str(p)).orderBy("record_no").collect()
    assert [r.record["a"] for r in rows] == ["1", "2"] and rows[0].return_probabilities is True


def test_reloading_stream_and_estimator(spark):
    from pyspark.ml import Pipeline
    from tessera.operators.clean import CleanConfig, CleanerEstimator
    from tessera.operators.scoring import LinearLogit
    from tessera.sources.tables import load_table
    from tessera.streaming.jobs import score_stream_reloading, source
    calls = []

    def champion():
        calls.append(1)
        m = LinearLogit({"value": 0.02}, intercept=-1.0)
        return m, m.feature_names

    schema = load_table(spark, SF_SMALL, "events").schema
    out = scratch_path(spark, f"reload-out-{uuid.uuid4().hex[:8]}")
    q = score_stream_reloading(source(spark, SF_SMALL, "events.parquet", schema), champion, out, keys=["event_id"])
    q.awaitTermination()
    assert calls and spark.read.parquet(out).count() == load_table(spark, SF_SMALL, "events").count()
    raw = spark.createDataFrame([(" 1 ", "x"), ("?", "y"), ("3", "z")], "`A b` string, c string")
    model = Pipeline(stages=[CleanerEstimator(CleanConfig(outlier_z=None, drop_na_thresh=1.0))]).fit(raw)
    assert model.transform(raw).columns == ["a_b", "c"] and dict(model.transform(raw).dtypes)["a_b"] == "double"


def test_dictionary_over_two_files(spark, tmp_path):
    from tessera.sources.files import parse_dictionary
    (tmp_path / "a.txt").write_text("intro\n1 ALPHA first\n2 BETA second\n")
    (tmp_path / "b.txt").write_text("3 GAMMA third, in the longer file of the two, read first by size\n4 DELTA fourth\n\n9 OMEGA behind the end\n")
    assert [tuple(r) for r in parse_dictionary(spark, str(tmp_path)).collect()] == [(1, "ALPHA"), (2, "BETA"), (3, "GAMMA"), (4, "DELTA")]
