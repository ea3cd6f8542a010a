"""Source queries (S3, S4, date parsing).  The two file readers first write their raw
input (from a test table) into the shared scratch folder, then read it back with the
library's reader; the date parser reads a text rendering of the event timestamps."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.values import to_datetime
from tessera.operators import clean as C
from tessera.plans.common import register
from tessera.session import scratch_path
from tessera.plans.standins import DIRTY_HEADERS, DIRTY_SLUGS, dirty_cte, dirty_lineitem
from tessera.sources.files import load_dataset, parse_dictionary, read_csv_strings, read_headerless, save_dataset
from tessera.sources.tables import load_table


@register("scan_headerless", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
  CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer""")
def scan_headerless(spark, sf_dir):
    path = scratch_path(spark, f"headerless-{uuid.uuid4().hex[:12]}")
    load_table(spark, sf_dir, "customer").write.mode("overwrite").option("header", "false").csv(path)
    return read_headerless(spark, path, ["c_custkey", "c_name", "c_nationkey"])


@register("dictionary_parse", """SELECT n_nationkey + 1 AS number, upper(replace(n_name, ' ', '_')) AS name FROM nation""")
def dictionary_parse(spark, sf_dir):
    n = load_table(spark, sf_dir, "nation")
    entries = n.select((F.col("n_nationkey") + 1).cast("double").alias("ord"),
                       F.concat_ws(" ", (F.col("n_nationkey") + 1).cast("string"),
                                   F.upper(F.regexp_replace("n_name", " ", "_")),
                                   F.lit("nation in region"), F.col("n_regionkey").cast("string")).alias("value"))
    extra = spark.createDataFrame(
        [(-3.0, "DATA DICTIONARY"), (-2.0, "Nr Name Description"), (-1.0, ""),
         (1e9, ""), (1e9 + 1, "L0: value labels follow"), (1e9 + 2, "1 NOT_A_COLUMN label text")],
        "ord double, value string")
    path = scratch_path(spark, f"dictionary-{uuid.uuid4().hex[:12]}")
    entries.unionByName(extra).orderBy("ord").select("value").coalesce(1).write.mode("overwrite").text(path)
    return parse_dictionary(spark, path)


@register("parse_datetimes", """WITH s AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'not a date'
    WHEN event_id % 17 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw FROM events),
p AS (SELECT event_id, try_strptime(raw, '%Y-%m-%d %H:%M:%S') AS t FROM s)
SELECT event_id, CAST(epoch(t) AS BIGINT) AS epoch_s, t IS NOT NULL AS valid FROM p""")
def parse_datetimes(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 13 == 0, F.lit("not a date")).when(F.col("event_id") % 17 == 0, F.lit("")) \
           .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    t = to_datetime(raw)
    return ev.select("event_id", t.cast("long").alias("epoch_s"), t.isNotNull().alias("valid"))


@register("scan_csv_strings", dirty_cte() + "\nSELECT " + ", ".join(f'"{h}" AS {s}' for h, s in zip(DIRTY_HEADERS, DIRTY_SLUGS)) + " FROM dirty")
def scan_csv_strings(spark, sf_dir):
    """The raw table saved as CSV and scanned as strings: blanks, tokens and empty cells as they were."""
    path = save_dataset(dirty_lineitem(spark, sf_dir), scratch_path(spark, f"raw-{uuid.uuid4().hex[:12]}.csv"))
    return read_csv_strings(spark, path).toDF(*DIRTY_SLUGS)


@register("scan_csv_inferred", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def scan_csv_inferred(spark, sf_dir):
    """A typed table saved as CSV and loaded with inferred types, by extension."""
    part = load_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    back = load_dataset(spark, save_dataset(part, scratch_path(spark, f"part-{uuid.uuid4().hex[:12]}.csv")))
    return back.select(*[F.col(f.name).cast(f.dataType) for f in part.schema.fields])


@register("json_round_trip", "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS s_acctbal FROM supplier")
def json_round_trip(spark, sf_dir):
    """A table with NULLs through the JSON sink and back."""
    table = load_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey",
                                                         F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("s_acctbal"))
    back = load_dataset(spark, save_dataset(table, scratch_path(spark, f"supplier-{uuid.uuid4().hex[:12]}.json")))
    return back.select(*[F.col(f.name).cast(f.dataType) for f in table.schema.fields])


@register("cast_types", "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, "
          "CAST(NULL AS DOUBLE) AS o_orderpriority, o_totalprice FROM orders")
def cast_types(spark, sf_dir):
    """Listed columns become categories, all others numbers (text that is none becomes NULL)."""
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    return C.cast_types(o, ["o_custkey"])
