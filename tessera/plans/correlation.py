"""Correlation queries (E6-E11) and their DuckDB oracles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tessera.operators import correlation as R
from tessera.plans.common import register
from tessera.plans.profiling import round_doubles
from tessera.plans.standins import ORDER_FEATURES, ORDER_FEATURES_SQL, order_features
from tessera.sources.tables import load_table

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _avg_rank_sql(c):
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


def _spearman_sql(min_abs=None, top=None):
    ranks = ", ".join(f"{_avg_rank_sql(c)} AS r_{c}" for c in LI_NUM)
    parts = [f"SELECT '{a}' AS a, '{b}' AS b, corr(r_{a}, r_{b}) AS r, count(*) AS n FROM rk"
             for a, b in combinations(LI_NUM, 2)]
    body = "\nUNION ALL ".join(parts)
    sql = f"WITH rk AS (SELECT {ranks} FROM lineitem),\np AS ({body})\nSELECT a, b, round(r, 6) AS r, n FROM p"
    if min_abs is not None:
        sql += f" WHERE abs(r) >= {min_abs}"
    if top is not None:
        sql += f" ORDER BY abs(r) DESC, a, b LIMIT {top}"
    return sql


@register("spearman_matrix", _spearman_sql())
def spearman_matrix(spark, sf_dir):
    li = load_table(spark, sf_dir, "lineitem")
    return round_doubles(R.spearman_pairs(li, LI_NUM))


def _of_spearman_sql(min_abs, top):
    cols = ORDER_FEATURES
    ranks = ", ".join(f"{_avg_rank_sql(c)} AS r_{c}" for c in cols)
    parts = [f"SELECT '{a}' AS a, '{b}' AS b, corr(r_{a}, r_{b}) AS r, count(*) AS n FROM rk"
             for a, b in combinations(cols, 2)]
    return (f"WITH {ORDER_FEATURES_SQL},\nrk AS (SELECT {ranks} FROM order_features),\np AS (" +
            "\nUNION ALL ".join(parts) + f")\nSELECT a, b, round(r, 6) AS r, n FROM p WHERE abs(r) >= {min_abs} "
            f"ORDER BY abs(r) DESC, a, b LIMIT {top}")


@register("strong_pairs", _of_spearman_sql(0.7, 5))
def strong_pairs(spark, sf_dir):
    of = order_features(spark, sf_dir)
    return round_doubles(R.strong_pairs(R.spearman_pairs(of, ORDER_FEATURES), 0.7, 5))


EV_FEATS = ["value", "user_id"]


@register("spearman_target", """WITH e AS (SELECT value, user_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM events),
rk AS (SELECT """ + ", ".join(f"{_avg_rank_sql(c)} AS r_{c}" for c in EV_FEATS + ["y"]) + """ FROM e),
p AS (""" + "\nUNION ALL ".join(f"SELECT '{c}' AS feature, corr(r_{c}, r_y) AS r, count(*) AS n FROM rk" for c in EV_FEATS) + """)
SELECT feature, round(r, 6) AS r, n, round(r * sqrt(n - 2) / sqrt(1 - r * r), 6) AS t_stat FROM p""")
def spearman_target(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events").withColumn(
        "y", (F.col("event_type") == "purchase").cast("int"))
    return round_doubles(R.spearman_target(ev, EV_FEATS, "y"))


@register("pearson_pairs", f"WITH {ORDER_FEATURES_SQL}\nSELECT a, b, round(r, 6) AS r FROM (" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM order_features" for a, b in combinations(ORDER_FEATURES, 2))
    + ") WHERE abs(r) >= 0.3")
def pearson_pairs(spark, sf_dir):
    return round_doubles(R.pearson_pairs(order_features(spark, sf_dir), ORDER_FEATURES, min_abs=0.3))


_CT_FEATS = ["n_lines", "sum_qty", "avg_disc", "o_totalprice"]


@register("corr_with_target", f"WITH {ORDER_FEATURES_SQL}\nSELECT feature, round(r, 6) AS r FROM (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, sum_price) AS r FROM order_features" for c in _CT_FEATS)
    + ") WHERE abs(r) > 0.1")
def corr_with_target(spark, sf_dir):
    return round_doubles(R.corr_with_target(order_features(spark, sf_dir), _CT_FEATS, "sum_price", min_abs=0.1))


_VIF = ["n_lines", "sum_qty", "sum_price"]


@register("vif", f"""WITH {ORDER_FEATURES_SQL},
c AS (SELECT corr(n_lines, sum_qty) AS r12, corr(n_lines, sum_price) AS r13,
  corr(sum_qty, sum_price) AS r23 FROM order_features),
d AS (SELECT *, 1 - r12 * r12 - r13 * r13 - r23 * r23 + 2 * r12 * r13 * r23 AS det FROM c)
SELECT 'n_lines' AS variable, round((1 - r23 * r23) / det, 6) AS vif FROM d
UNION ALL SELECT 'sum_qty', round((1 - r13 * r13) / det, 6) FROM d
UNION ALL SELECT 'sum_price', round((1 - r12 * r12) / det, 6) FROM d""")
def vif(spark, sf_dir):
    return round_doubles(R.vif(order_features(spark, sf_dir), _VIF))


# p = share of the integral of cos(x) ** (n - 3) from 0 to pi / 2 that lies beyond asin |r|, both by Simpson's rule on
# 20,000 panels; the integrands are scaled to 1 at their start and cut where they have fallen below e ** -45
_PVALUE_SQL = """WITH e AS (SELECT value, user_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM events),
rk AS (SELECT """ + ", ".join(f"{_avg_rank_sql(c)} AS r_{c}" for c in EV_FEATS + ["y"]) + """ FROM e),
p AS (""" + "\nUNION ALL ".join(f"SELECT '{c}' AS feature, corr(r_{c}, r_y) AS r, count(*) AS n FROM rk" for c in EV_FEATS) + """),
ends AS (SELECT feature, r, n, side, n - 3 AS m, CASE side WHEN 0 THEN 0.0 ELSE asin(abs(r)) END AS a FROM p, range(2) t(side)),
spans AS (SELECT *, acos(cos(a) * exp(-45.0 / m)) AS b FROM ends),
sums AS (SELECT feature, side, any_value(m) * ln(cos(any_value(a))) AS scale,
  (any_value(b) - any_value(a)) / 60000.0 * sum(CASE WHEN k IN (0, 20000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
    * exp(m * ln(cos(a + (b - a) * k / 20000.0) / cos(a)))) AS v FROM spans, range(20001) t(k) GROUP BY feature, side)
SELECT p.feature, round(r, 6) AS r, n, round(r * sqrt(n - 2) / sqrt(1 - r * r), 6) AS t_stat,
  round(least(1.0, exp(beyond.scale) * beyond.v / whole.v), 6) AS p_value
FROM p JOIN sums beyond ON beyond.feature = p.feature AND beyond.side = 1 JOIN sums whole ON whole.feature = p.feature AND whole.side = 0"""


@register("spearman_pvalues", _PVALUE_SQL)
def spearman_pvalues(spark, sf_dir):
    """Spearman r of each event feature against the purchase flag with its two-sided
    p-value (the quadrature runs on the per-feature numbers only)."""
    ev = load_table(spark, sf_dir, "events").withColumn(
        "y", (F.col("event_type") == "purchase").cast("int"))
    return round_doubles(R.spearman_target(ev, EV_FEATS, "y", with_pvalue=True))


# ---------------------------------------------------------------- columns with gaps, copies and constants
#: name -> expression over the order features (one SQL text for both engines)
_GAPS = {
    "n_lines": "n_lines", "sum_qty": "CASE WHEN o_orderkey % 7 <> 0 THEN sum_qty END", "sum_price": "sum_price",
    "avg_disc": "CASE WHEN o_orderkey % 5 <> 0 THEN avg_disc END", "total": "CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END",
    "copy": "sum_price", "steady": "CAST(4 AS DOUBLE)", "twin": "sum_price * 1.00001 + n_lines",
}
_GAPS_SQL = f"WITH {ORDER_FEATURES_SQL},\ng AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _GAPS.items()) + " FROM order_features)"


def gappy_orders(spark, sf_dir):
    return order_features(spark, sf_dir, materialize=True).selectExpr(*[f"{e} AS {c}" for c, e in _GAPS.items()])


@register("pearson_gaps", _GAPS_SQL + "\n" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, " + ("CAST(NULL AS DOUBLE) AS r" if "steady" in (a, b) else f"round(corr({a}, {b}), 6) AS r FROM g")
    for a, b in combinations(_GAPS, 2)))
def pearson_gaps(spark, sf_dir):
    """All Pearson pairs of columns with NULLs, a copy, a near copy and a constant, from one Gram pass."""
    return round_doubles(R.pearson_pairs(gappy_orders(spark, sf_dir), list(_GAPS)))


def _gap_ranks(a, b):
    if "steady" in (a, b):
        return f"SELECT '{a}' AS a, '{b}' AS b, CAST(NULL AS DOUBLE) AS r, count(*) AS n FROM g WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    return (f"SELECT '{a}' AS a, '{b}' AS b, round(corr(x, y), 6) AS r, count(*) AS n FROM (SELECT {_avg_rank_sql(a)} AS x, {_avg_rank_sql(b)} AS y "
            f"FROM g WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


@register("spearman_gaps", _GAPS_SQL + "\n" + "\nUNION ALL ".join(_gap_ranks(a, b) for a, b in combinations(_GAPS, 2)))
def spearman_gaps(spark, sf_dir):
    """All Spearman pairs of the same columns: every pair is ranked over the rows where both have values."""
    return round_doubles(R.spearman_pairs(gappy_orders(spark, sf_dir), list(_GAPS)))


@register("vif_pruned", _GAPS_SQL + """,
w AS (SELECT n_lines AS a, sum_qty AS b, sum_price AS c FROM g WHERE sum_qty IS NOT NULL AND avg_disc IS NOT NULL AND total IS NOT NULL),
k AS (SELECT corr(a, b) AS r12, corr(a, c) AS r13, corr(b, c) AS r23 FROM w),
d AS (SELECT *, 1 - r12 * r12 - r13 * r13 - r23 * r23 + 2 * r12 * r13 * r23 AS det FROM k)
SELECT 'n_lines' AS variable, round((1 - r23 * r23) / det, 6) AS vif FROM d
UNION ALL SELECT 'sum_qty', round((1 - r13 * r13) / det, 6) FROM d
UNION ALL SELECT 'sum_price', round((1 - r12 * r12) / det, 6) FROM d""")
def vif_pruned(spark, sf_dir):
    """VIF over complete rows after constants, copies and near copies are pruned."""
    whole = gappy_orders(spark, sf_dir).dropna(subset=["avg_disc", "total"])
    return round_doubles(R.vif(whole, ["n_lines", "sum_qty", "sum_price", "copy", "steady", "twin"]))
