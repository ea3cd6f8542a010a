"""Stand-in inputs derived from the test tables.

The test tables are clean and typed; the cleaning operators expect a raw,
all-string table with messy headers and missing-value tokens.  ``DIRTY_LINEITEM``
re-expresses every lineitem row in that shape (one output row per input row, so it
grows with the table).  It only produces input rows in the expected schema; every
cleaning decision is made later by the operators on whatever values they see.

The definition is SQL text rendered for two dialects (Spark SQL and DuckDB) so that
the Spark job and the DuckDB oracle see byte-identical input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import load_table

# raw header -> expression over lineitem (column order = file order)
_DIRTY_COLS = [
    ("Order Key", "cast(l_orderkey AS string)"),
    ("Part Key", "cast(l_partkey AS string)"),
    ("Supp Key", "cast(l_suppkey AS string)"),
    ("Line No.", "cast(l_linenumber AS string)"),
    (" Quantity ", "CASE WHEN l_orderkey % 11 = 0 THEN ' N/A ' WHEN l_orderkey % 17 = 0 THEN '?' "
                   "WHEN l_partkey % 19 = 0 THEN '' "
                   "ELSE concat(' ', cast(cast(l_quantity AS int) AS string), ' ') END"),
    ("Price (USD)", "CASE WHEN l_partkey % 23 = 0 THEN 'unknown' WHEN l_partkey % 29 = 0 THEN 'n.a.' "
                    "ELSE concat(cast(cast(floor(cast(round(l_extendedprice * 100) AS bigint) / 100) AS bigint) AS string), '.', "
                    "lpad(cast(cast(round(l_extendedprice * 100) AS bigint) % 100 AS string), 2, '0')) END"),
    ("Discount", "CASE WHEN l_orderkey % 7 = 0 THEN concat(cast(cast(round(l_discount * 100) AS int) AS string), '%') "
                 "ELSE cast(cast(round(l_discount * 100) AS int) AS string) END"),
    ("Tax Rate", "concat('0.0', cast(cast(round(l_tax * 100) AS int) AS string))"),
    ("Return Flag", "CASE WHEN l_linenumber = 7 THEN 'NA' WHEN l_suppkey % 31 = 0 THEN 'none' "
                    "ELSE concat(' ', l_returnflag) END"),
    ("Line Status", "CASE WHEN l_partkey % 37 = 0 THEN 'missing' ELSE l_linestatus END"),
    ("Big Value", "CASE WHEN l_orderkey % 101 = 0 THEN cast(cast(floor(l_extendedprice) AS bigint) * 1000 AS string) "
                  "ELSE cast(cast(l_quantity AS int) AS string) END"),
    ("mostly missing", "CASE WHEN l_orderkey % 97 = 0 AND l_linenumber = 1 THEN '42' ELSE '' END"),
    ("flag_label", "concat(l_returnflag, '-', l_linestatus)"),
    ("Ship Date", "cast(cast(l_shipdate AS date) AS string)"),
]

DIRTY_HEADERS = [h for h, _ in _DIRTY_COLS]
# slugs the cleaner is expected to produce (used by the oracles and tests)
DIRTY_SLUGS = ["order_key", "part_key", "supp_key", "line_no", "quantity", "price_usd",
               "discount", "tax_rate", "return_flag", "line_status", "big_value",
               "mostly_missing", "flag_label", "ship_date"]


def _quote(name: str, dialect: str) -> str:
    return f"`{name}`" if dialect == "spark" else '"' + name.replace('"', '""') + '"'


def dirty_lineitem_sql(dialect: str, table: str = "lineitem") -> str:
    cols = ",\n  ".join(f"{expr} AS {_quote(h, dialect)}" for h, expr in _DIRTY_COLS)
    return f"SELECT\n  {cols}\nFROM {table}"


def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load_table(spark, sf_dir, "lineitem")
    return li.selectExpr(*[f"{expr} AS {_quote(h, 'spark')}" for h, expr in _DIRTY_COLS])


def dirty_cte(name: str = "dirty") -> str:
    """``WITH dirty AS (...)`` prefix for DuckDB oracles."""
    return f"WITH {name} AS (\n{dirty_lineitem_sql('duckdb')}\n)"


# ------------------------------------------------------------------ order features
ORDER_FEATURES = ["n_lines", "sum_qty", "sum_price", "avg_disc", "o_totalprice"]

ORDER_FEATURES_SQL = """order_features AS (
  SELECT o.o_orderkey, CAST(s.n_lines AS DOUBLE) AS n_lines, s.sum_qty, s.sum_price, s.avg_disc, o.o_totalprice
  FROM orders o JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS sum_qty,
                             sum(l_extendedprice) AS sum_price, avg(l_discount) AS avg_disc
                      FROM lineitem GROUP BY l_orderkey) s ON o.o_orderkey = s.l_orderkey)"""


def order_features(spark: SparkSession, sf_dir: str, materialize: bool = False) -> DataFrame:
    """Per-order numeric features: lineitem aggregated by order, joined to orders.
    Both sides are partitioned on the order key, so the aggregate's shuffle is reused
    by the join."""
    from pyspark.sql import functions as F
    li = load_table(spark, sf_dir, "lineitem")
    o = load_table(spark, sf_dir, "orders")
    s = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("double").alias("n_lines"),
                                     F.sum("l_quantity").alias("sum_qty"),
                                     F.sum("l_extendedprice").alias("sum_price"),
                                     F.avg("l_discount").alias("avg_disc"))
    of = (o.join(s, o.o_orderkey == s.l_orderkey, "inner")
          .select("o_orderkey", "n_lines", "sum_qty", "sum_price", "avg_disc", "o_totalprice"))
    if not materialize:
        return of
    # for consumers that scan it several times (ranks, quantiles, PCA): one aggregate +
    # join, written to the shared folder, instead of one per pass
    from tessera.session import cut_lineage
    return cut_lineage(of, "order_features")
