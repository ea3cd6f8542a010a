"""Notebook-analytics queries (N1-N10) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import outliers as O
from tessera.plans.common import register
from tessera.plans.profiling import round_doubles
from tessera.plans.standins import ORDER_FEATURES, ORDER_FEATURES_SQL, order_features
from tessera.sources.tables import load_table


def _bounds_sql(table, cols, k=1.5):
    parts = [f"SELECT '{c}' AS col, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, "
             f"min({c}) AS mn, max({c}) AS mx FROM {table}" for c in cols]
    return ("b0 AS (" + "\nUNION ALL ".join(parts) + "),\n"
            f"b AS (SELECT col, q1, q3, q3 - q1 AS iqr, q1 - {k} * (q3 - q1) AS lower, q3 + {k} * (q3 - q1) AS upper, "
            "round_even(mn / nullif(q1, 0), 2) AS extrem_min, round_even(mx / nullif(q3, 0), 2) AS extrem_max FROM b0)")


@register("iqr_bounds", f"WITH {ORDER_FEATURES_SQL},\n{_bounds_sql('order_features', ORDER_FEATURES)}\n"
          "SELECT col, round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr, round(lower, 6) AS lower, "
          "round(upper, 6) AS upper, round(extrem_min, 6) AS extrem_min, round(extrem_max, 6) AS extrem_max FROM b")
def iqr_bounds(spark, sf_dir):
    return round_doubles(O.iqr_bounds(order_features(spark, sf_dir), ORDER_FEATURES))


@register("iqr_keep_list", f"WITH {ORDER_FEATURES_SQL},\n{_bounds_sql('order_features', ORDER_FEATURES)},\n"
          "c AS (SELECT round(quantile_cont(extrem_max, 0.15), 2) AS cut FROM b WHERE extrem_max IS NOT NULL)\n"
          "SELECT col, round(extrem_max, 6) AS extrem_max FROM b, c WHERE extrem_max IS NOT NULL AND extrem_max <= c.cut")
def iqr_keep_list(spark, sf_dir):
    b = O.iqr_bounds(order_features(spark, sf_dir), ORDER_FEATURES)
    return round_doubles(O.keep_list(b, 0.15))


EV = ["value", "user_id"]


@register("iqr_outliers", f"WITH {_bounds_sql('events', EV)},\nl AS (SELECT event_id, 'value' AS col, value FROM events "
          "UNION ALL SELECT event_id, 'user_id', CAST(user_id AS DOUBLE) FROM events)\n"
          "SELECT l.event_id, l.col, round(l.value, 6) AS value, round(b.lower, 6) AS lower, round(b.upper, 6) AS upper, "
          "round(b.extrem_min, 6) AS extrem_min, round(b.extrem_max, 6) AS extrem_max "
          "FROM l JOIN b ON l.col = b.col WHERE l.value < b.lower OR l.value > b.upper")
def iqr_outliers(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events")
    return round_doubles(O.iqr_outliers(ev, ["event_id"], EV))


@register("iqr_outlier_counts", f"WITH {_bounds_sql('events', EV)},\nl AS (SELECT event_id, 'value' AS col, value FROM events "
          "UNION ALL SELECT event_id, 'user_id', CAST(user_id AS DOUBLE) FROM events)\n"
          "SELECT l.col, count(*) AS n_outliers FROM l JOIN b ON l.col = b.col "
          "WHERE l.value < b.lower OR l.value > b.upper GROUP BY l.col")
def iqr_outlier_counts(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events")
    return O.outlier_counts(O.iqr_outliers(ev, ["event_id"], EV))


@register("iqr_filtered", f"WITH {_bounds_sql('events', ['value'])}\n"
          "SELECT event_id, value FROM events, b WHERE NOT coalesce(value < b.lower OR value > b.upper, false)")
def iqr_filtered(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events")
    b = O.iqr_bounds(ev, ["value"])
    return O.drop_outlier_rows(ev, b, ["value"]).select("event_id", "value")


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CLASS_SQL = ("WITH li AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem),\n"
              "cs AS (" + "\nUNION ALL ".join(
                  f"SELECT '{c}' AS variable, y AS class, count({c}) AS count, round_even(avg({c}), 2) AS mean, "
                  f"round_even(quantile_cont({c}, 0.5), 2) AS median, round_even(stddev_samp({c}), 2) AS std, "
                  f"round_even(min({c}), 2) AS min, round_even(max({c}), 2) AS max FROM li GROUP BY y" for c in LI_NUM) + ")")


@register("class_stats", _CLASS_SQL + "\nSELECT * FROM cs")
def class_stats(spark, sf_dir):
    li = load_table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return O.class_stats(li, "y", LI_NUM)


@register("variable_screen", _CLASS_SQL + """,
w AS (SELECT variable, max(CASE WHEN class = 0 THEN mean END) AS m0, max(CASE WHEN class = 1 THEN mean END) AS m1,
  max(CASE WHEN class = 0 THEN min END) AS min0, max(CASE WHEN class = 0 THEN max END) AS max0,
  max(CASE WHEN class = 1 THEN min END) AS min1, max(CASE WHEN class = 1 THEN max END) AS max1,
  max(CASE WHEN class = 0 THEN count END) AS n0, max(CASE WHEN class = 1 THEN count END) AS n1 FROM cs GROUP BY variable),
s AS (SELECT variable, round_even(abs(max0 - min0), 2) AS range0,
  round_even(abs(m0 - m1) / nullif(m0, 0), 2) AS dif_mean,
  round_even(abs(max0 - min0) / nullif(abs(max1 - min1), 0), 2) AS range_ratio,
  round_even(100.0 * n1 / (n0 + n1), 2) AS pct_pos FROM w),
f AS (SELECT variable, range0 > 0 AS range0_positive, dif_mean, range_ratio, pct_pos,
  coalesce(NOT (dif_mean < 0.1), true) AS consider,
  NOT coalesce(range_ratio > 0.9 AND range_ratio < 1.1 AND range0 > 0, false) AS range_changes FROM s)
SELECT *, NOT consider OR NOT range_changes AS exclude FROM f""")
def variable_screen(spark, sf_dir):
    li = load_table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return O.variable_screen(O.class_stats(li, "y", LI_NUM))


@register("standardize", """SELECT p_partkey,
  round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS z_p_size,
  round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS z_p_retailprice
FROM part""")
def standardize(spark, sf_dir):
    p = load_table(spark, sf_dir, "part")
    return round_doubles(O.standardize(p, ["p_size", "p_retailprice"], keys=["p_partkey"]))


@register("pca_variance", """WITH c AS (SELECT abs(corr(p_size, p_retailprice)) AS r FROM part)
SELECT 1 AS pc, round((1 + r) / 2, 6) AS ratio, round((1 + r) / 2, 6) AS cum FROM c
UNION ALL SELECT 2, round((1 - r) / 2, 6), round(1.0, 6) FROM c""")
def pca_variance(spark, sf_dir):
    p = load_table(spark, sf_dir, "part")
    z = O.standardize(p, ["p_size", "p_retailprice"], keys=["p_partkey"])
    return round_doubles(O.explained_variance(z, ["z_p_size", "z_p_retailprice"]))


@register("pca_scores")
def pca_scores(spark, sf_dir):
    """PCA scores (all components) of the standardised order features (rows-only check)."""
    of = order_features(spark, sf_dir)
    z = O.standardize(of, ORDER_FEATURES, keys=["o_orderkey"])
    scores, _ = O.pca(z, [f"z_{c}" for c in ORDER_FEATURES], len(ORDER_FEATURES), keys=["o_orderkey"])
    return scores
