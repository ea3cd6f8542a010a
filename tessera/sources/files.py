"""File scans and sinks.

* ``read_csv_strings``  every column as string, no NA conversion (raw ingest)
* ``read_csv_inferred`` types inferred by Spark
* ``read_headerless``   headerless file + external names; width checked, first N kept
* ``parse_dictionary``  column names from a numbered dictionary text
* ``load_dataset`` / ``save_dataset``  format chosen by extension
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# a value no real cell holds, so that Spark never turns text into NULL on read
_NO_NULL = "\u0000__tessera_no_null__\u0000"


def _suffix(path: str) -> str:
    p = path.rstrip("/")
    return os.path.splitext(p)[1].lower()


def read_csv_strings(spark: SparkSession, path: str, **options) -> DataFrame:
    """All-string scan; empty cells stay ''. Missing path -> FileNotFoundError."""
    opts = {"header": "true", "inferSchema": "false", "nullValue": _NO_NULL,
            "emptyValue": "", "multiLine": "false"}
    opts.update({k: str(v) for k, v in options.items()})
    try:
        df = spark.read.options(**opts).csv(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(path) from exc
        raise
    # with the sentinel as nullValue, a NULL can only be an unquoted empty cell
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def read_csv_inferred(spark: SparkSession, path: str, reject_empty: bool = False, **options) -> DataFrame:
    opts = {"header": "true", "inferSchema": "true"}
    opts.update({k: str(v) for k, v in options.items()})
    try:
        df = spark.read.options(**opts).csv(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(path) from exc
        raise
    if reject_empty and df.isEmpty():
        raise ValueError(f"empty table: {path}")
    return df


def read_headerless(spark: SparkSession, path: str, names: list[str], sep: str = ",",
                    strings: bool = True) -> DataFrame:
    """Headerless CSV: require at least ``len(names)`` columns, keep the first N, rename."""
    df = spark.read.options(header="false", inferSchema=str(not strings).lower(), sep=sep,
                            nullValue=_NO_NULL if strings else "", emptyValue="").csv(path)
    n = len(names)
    if len(df.columns) < n:
        raise ValueError(f"file has {len(df.columns)} columns, {n} names given")
    return df.select(*df.columns[:n]).toDF(*names)


def parse_dictionary(spark: SparkSession, path: str, min_entries: int | None = None) -> DataFrame:
    """Parse ``(number, name)`` pairs from a numbered dictionary text.

    The list starts at the first line that looks like ``1 <name>`` and stops at the
    first blank line or line starting with ``L0`` after that start.  Entry lines
    match ``^(\\d+)\\s+(\\S+)\\s+``; output is ordered by number.  The whole scan is a
    distributed text read; the start/stop line numbers are two scalar aggregates.
    """
    lines = (spark.read.text(path)
             .select("value", F.struct("_metadata.file_path", "_metadata.file_block_start",
                                       F.monotonically_increasing_id()).alias("line_no")))
    # files in order of their paths; the id is ordered within a block of a file
    start = lines.filter(F.col("value").rlike(r"^1\s+\S+")).agg(F.min("line_no").alias("m"))
    entry = r"^(\d+)\s+(\S+)\s+"
    begun = lines.join(F.broadcast(start), F.col("line_no") >= F.col("m")).drop("m")            # one row
    ends = begun.filter((F.trim("value") == "") | F.col("value").startswith("L0")).agg(F.min("line_no").alias("m"))
    out = (begun.join(F.broadcast(ends), F.col("m").isNull() | (F.col("line_no") < F.col("m")))
           .filter(F.col("value").rlike(entry))
           .select(F.regexp_extract("value", entry, 1).cast("int").alias("number"),
                   F.regexp_extract("value", entry, 2).alias("name"))
           .orderBy("number"))
    if min_entries is not None:
        n = out.count()
        if n < min_entries:
            raise ValueError(f"dictionary has {n} entries, {min_entries} required")
    return out


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    ext = _suffix(path)
    if ext == ".parquet":
        return spark.read.parquet(path)
    if ext in (".csv", ".txt"):
        return read_csv_inferred(spark, path)
    if ext in (".json", ".jsonl"):
        return spark.read.json(path)
    raise ValueError(f"unsupported extension: {ext}")


def save_dataset(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    ext = _suffix(path)
    if ext == ".parquet":
        df.write.mode(mode).parquet(path)
    elif ext in (".csv", ".txt"):
        # blanks around values are values
        df.write.mode(mode).options(header="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    elif ext in (".json", ".jsonl"):
        df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    else:
        raise ValueError(f"unsupported extension: {ext}")
    return path


__all__ = ["read_csv_strings", "read_csv_inferred", "read_headerless", "parse_dictionary",
           "load_dataset", "save_dataset", "append_runs"]


def append_runs(df: DataFrame, path: str) -> str:
    """Append run records to a plain parquet table.  For several writers and retried jobs use
    ``tessera.operators.registry``, which makes a run visible at once or not at all."""
    df.write.mode("append").parquet(path)
    return path
