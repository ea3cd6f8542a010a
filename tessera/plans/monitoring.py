"""Monitoring queries (D4-D7) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import monitor as MO
from tessera.plans.common import LI_KEY, register
from tessera.plans.modeling import scored_events
from tessera.plans.profiling import round_doubles
from tessera.sources.tables import load_table

BASE, CUR = "baseline", "current"


def sliced_events(spark, sf_dir):
    sc = scored_events(spark, sf_dir)
    return sc.withColumn("slice", F.when(F.dayofmonth("ts") <= 15, F.lit(BASE)).otherwise(F.lit(CUR)))


_SLICED_SQL = """WITH sc0 AS (SELECT event_id, ts, value, user_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
    1.0 / (1.0 + exp(-(-1.0 + 0.02 * value))) AS prob,
    CASE WHEN day(ts) <= 15 THEN 'baseline' ELSE 'current' END AS slice FROM events),
sc AS (SELECT *, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS prediction FROM sc0)"""


def _metrics_by_sql(key):
    return f""",
g AS (SELECT {key} AS k, prob, sum(label) AS p, sum(1 - label) AS q FROM sc GROUP BY ALL),
cu AS (SELECT k, p, q, coalesce(sum(q) OVER (PARTITION BY k ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS qb FROM g),
au AS (SELECT k, sum(p * (qb + q / 2.0)) / (sum(p) * sum(q)) AS roc_auc FROM cu GROUP BY k),
c AS (SELECT {key} AS k, count(*) AS n, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy,
  count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn,
  -avg(label * ln(least(greatest(prob, 1e-15), 1 - 1e-15)) + (1 - label) * ln(1 - least(greatest(prob, 1e-15), 1 - 1e-15))) AS log_loss,
  avg(label) AS pos_rate, avg(prob) AS mean_prob FROM sc GROUP BY ALL),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM c),
m AS (SELECT pr.k, n, accuracy, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1_score,
  log_loss, au.roc_auc, pos_rate, mean_prob FROM pr JOIN au ON pr.k = au.k)"""


_METRICS = MO.METRICS


@register("drift_report", _SLICED_SQL + _metrics_by_sql("slice") + """,
r AS (SELECT """ + ", ".join(
    [f"max(CASE WHEN k = 'baseline' THEN {m} END) AS base_{m}" for m in _METRICS] +
    [f"max(CASE WHEN k = 'current' THEN {m} END) AS cur_{m}" for m in _METRICS]) + """ FROM m)
SELECT """ + ", ".join([f"round(base_{m}, 6) AS base_{m}" for m in _METRICS] +
                       [f"round(cur_{m}, 6) AS cur_{m}" for m in _METRICS]) + f""",
  round(base_roc_auc - cur_roc_auc, 6) AS delta_roc_auc, CAST(0.05 AS DOUBLE) AS threshold,
  coalesce(base_roc_auc - cur_roc_auc >= 0.05, false) AS alert,
  CASE WHEN coalesce(base_roc_auc - cur_roc_auc >= 0.05, false) THEN '{MO.ACTION_ALERT}' ELSE '{MO.ACTION_OK}' END AS action
FROM r""")
def drift_report(spark, sf_dir):
    return round_doubles(MO.drift_report(sliced_events(spark, sf_dir), "slice", BASE, CUR, threshold=0.05))


_FEATS = ["value", "user_id"]
_SHIFT_SQL = _SLICED_SQL + """,
r AS (SELECT """ + ", ".join(f"min({f}) AS lo_{f}, (max({f}) - min({f})) / 30 AS w_{f}" for f in _FEATS) + """ FROM sc),
l AS (""" + "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v, least(29, greatest(0, CAST(floor(({f} - r.lo_{f}) / r.w_{f}) AS INTEGER))) AS bin, "
    f"slice FROM sc, r" for f in _FEATS) + """),
c AS (SELECT feature, bin, count(*) FILTER (WHERE slice = 'baseline') AS n_base, count(*) FILTER (WHERE slice = 'current') AS n_cur
      FROM l GROUP BY feature, bin),
grid AS (SELECT f.feature, CAST(b.range AS INTEGER) AS bin FROM (VALUES ('value'), ('user_id')) f(feature), range(30) b),
t AS (SELECT grid.feature, grid.bin, CAST(coalesce(c.n_base, 0) AS BIGINT) AS n_base, CAST(coalesce(c.n_cur, 0) AS BIGINT) AS n_cur
      FROM grid LEFT JOIN c ON grid.feature = c.feature AND grid.bin = c.bin)"""


@register("feature_shift", _SHIFT_SQL + "\nSELECT * FROM t")
def feature_shift(spark, sf_dir):
    ev = sliced_events(spark, sf_dir)
    table, _ = MO.feature_shift(ev, "slice", BASE, CUR, _FEATS, bins=30)
    return table


@register("feature_psi", _SHIFT_SQL + """,
s AS (SELECT feature, greatest(n_base / sum(n_base) OVER (PARTITION BY feature), 1e-4) AS pb,
      greatest(n_cur / sum(n_cur) OVER (PARTITION BY feature), 1e-4) AS pc FROM t),
p AS (SELECT feature, sum((pc - pb) * ln(pc / pb)) AS psi FROM s GROUP BY feature),
mn AS (SELECT feature, avg(v) FILTER (WHERE slice = 'baseline') AS mean_base, avg(v) FILTER (WHERE slice = 'current') AS mean_cur
       FROM l GROUP BY feature)
SELECT mn.feature, round(mean_base, 6) AS mean_base, round(mean_cur, 6) AS mean_cur, round(mean_cur - mean_base, 6) AS mean_shift,
  round(psi, 6) AS psi FROM mn JOIN p ON mn.feature = p.feature""")
def feature_psi(spark, sf_dir):
    ev = sliced_events(spark, sf_dir)
    _, summary = MO.feature_shift(ev, "slice", BASE, CUR, _FEATS, bins=30)
    return round_doubles(summary)


@register("drift_by_day", _SLICED_SQL + _metrics_by_sql("strftime(CAST(ts AS DATE), '%Y-%m-%d')") + """
SELECT k AS day, n, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1_score, 6) AS f1_score, round(log_loss, 6) AS log_loss, round(roc_auc, 6) AS roc_auc,
  round(pos_rate, 6) AS pos_rate, round(mean_prob, 6) AS mean_prob FROM m""")
def drift_by_day(spark, sf_dir):
    m = MO.metrics_by_window(scored_events(spark, sf_dir), "ts", "1 day")
    return round_doubles(m.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start"))


_STRESS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("stress_features", """WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS k,
    l_quantity * 1.3 AS l_quantity, l_extendedprice * 1.3 AS l_extendedprice, l_discount * 1.3 AS l_discount,
    l_tax * 1.3 AS l_tax FROM lineitem),
md AS (SELECT quantile_cont(l_quantity, 0.5) AS m FROM s)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  round(CASE WHEN ('0x' || substr(md5(k || ':l_quantity:42'), 1, 8))::BIGINT / 4294967296.0 < 0.4 THEN md.m ELSE l_quantity END, 6) AS l_quantity,
  round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax
FROM s, md""")
def stress_features(spark, sf_dir):
    li = load_table(spark, sf_dir, "lineitem")
    key = F.concat_ws(":", *[F.col(k).cast("string") for k in LI_KEY])
    out = MO.stress_features(li, _STRESS, key, severity=0.3, noise=False, seed=42, keys=LI_KEY)
    return round_doubles(out)
