"""Scoring request records: open dictionaries as JSON.

A request body ``{"records": [{...}, ...], "return_probabilities": bool}`` becomes one
row per record with a ``map<string,string>`` of its fields; a JSON column holding one
object per row (e.g. an event's properties) becomes the same map directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_MAP = T.MapType(T.StringType(), T.StringType())
REQUEST_SCHEMA = T.StructType([
    T.StructField("records", T.ArrayType(RECORD_MAP)),
    T.StructField("return_probabilities", T.BooleanType()),
])


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines request bodies -> (request_no, record_no, record map, return_probabilities)."""
    req = (spark.read.schema(REQUEST_SCHEMA).json(path)
           .withColumn("request_no", F.monotonically_increasing_id()))
    return req.select("request_no", "return_probabilities",
                      F.posexplode("records").alias("record_no", "record"))


def records_from_json_column(col: str | Column) -> Column:
    """Parse a JSON-object string column into map<string,string> (numbers kept as text)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.from_json(c, RECORD_MAP)
