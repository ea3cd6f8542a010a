"""tessera: data cleaning, profiling, model evaluation and monitoring as Spark plans.

Sub-packages
------------
sources    scans and sinks (parquet/csv/text/json), table loader, run table
functions  column-expression helpers (names, missing tokens, numeric parsing, hashing)
operators  DataFrame -> DataFrame operators (clean, profile, rank, correlation,
           outliers, split, metrics, knn, models, selection, scoring, monitoring)
plans      the query catalogue wired into ``__spark_entry__`` plus its SQL oracles
streaming  Structured Streaming jobs (continuous scoring, windowed monitoring)
"""

from tessera.session import get_session, checkpoint_dir, cut_lineage  # noqa: F401

__all__ = ["get_session", "checkpoint_dir", "cut_lineage"]
