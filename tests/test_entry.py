import duckdb
import pytest

from tests.conftest import SF_SMALL
from tessera.sources.tables import TABLES

# a fast cross-section of the catalogue, checked against DuckDB at the smallest scale
SAMPLE = ["clean_table", "describe_numeric", "spearman_matrix", "iqr_outliers", "stratified_split", "roc_auc",
          "confusion_matrix", "knn_classify", "drift_report", "trial_runs", "feature_shift", "dictionary_parse"]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "missing_ratio" in df.columns


def test_every_oracle_has_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 70


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_duckdb(spark, name):
    import __spark_entry__ as E
    from tools.oracle_check import _rows
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dk = con.execute(E.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dk.columns)
    assert _rows(sp) == _rows(dk)
