"""Streaming queries (D3, D7).  Stream output must equal the batch computation:
scoring row for row, monitoring for every window the watermark has closed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.plans.common import register
from tessera.plans.modeling import FIXED, _SCORED_SQL, _TXT
from tessera.plans.profiling import round_doubles
from tessera.sources.tables import load_table
from tessera.streaming import jobs as J


def _events_stream(spark, sf_dir):
    schema = load_table(spark, sf_dir, "events").schema
    return J.source(spark, sf_dir, "events.parquet", schema)


@register("score_stream", _SCORED_SQL + f"""
SELECT event_id, prediction, round(prob, 6) AS probability, {_TXT} AS interpretation FROM sc""")
def score_stream(spark, sf_dir):
    scored = J.score_stream(_events_stream(spark, sf_dir), FIXED, FIXED.feature_names, keys=["event_id"])
    return round_doubles(spark.read.parquet(J.run_available_now(scored, "score")))


@register("drift_stream", """WITH sc AS (SELECT ts, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
    1.0 / (1.0 + exp(-(-1.0 + 0.02 * value))) AS prob FROM events),
w AS (SELECT date_trunc('day', ts) AS d, count(*) AS n, avg(label) AS pos_rate, avg(prob) AS mean_prob,
    avg(CASE WHEN label = (CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END) THEN 1.0 ELSE 0.0 END) AS accuracy FROM sc GROUP BY ALL)
SELECT strftime(d, '%Y-%m-%d') AS day, n, round(pos_rate, 6) AS pos_rate, round(mean_prob, 6) AS mean_prob,
  round(accuracy, 6) AS accuracy FROM w
WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def drift_stream(spark, sf_dir):
    s = _events_stream(spark, sf_dir)
    scored = FIXED.transform(s.select("event_id", "ts", "value",
                                      (F.col("event_type") == "purchase").cast("int").alias("label")))
    mon = J.monitor_stream(scored, "ts", "1 day", "1 hour")
    return round_doubles(spark.read.parquet(J.run_available_now(mon, "monitor")))


def _binned_sql(by, source):
    """Metrics by score bin, 4096 of them."""
    return f"""b AS (SELECT {by} AS k, least(greatest(CAST(floor(prob * 4096) AS INTEGER), 0), 4095) AS bin, sum(label) AS p, sum(1 - label) AS q
    FROM {source} GROUP BY ALL),
u AS (SELECT k, p, q, coalesce(sum(q) OVER (PARTITION BY k ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b),
a AS (SELECT k, sum(p * (below + q / 2.0)) / nullif(sum(p) * sum(q), 0) AS roc_auc FROM u GROUP BY k)"""


@register("drift_stream_metrics", _SCORED_SQL.replace("SELECT event_id,", "SELECT event_id, ts, user_id,", 1) + """,
base AS (SELECT * FROM sc WHERE user_id % 2 = 0), """ + _binned_sql("1", "base").replace("b AS (", "bb AS (").replace("FROM b)", "FROM bb)")
    .replace("u AS (SELECT", "bu AS (SELECT").replace("FROM u ", "FROM bu ").replace("a AS (SELECT k, sum(p", "ba AS (SELECT k, sum(p") + """,
""" + _binned_sql("date_trunc('day', ts)", "sc") + """,
c AS (SELECT date_trunc('day', ts) AS k, count(*) AS n, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy,
  count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn, avg(label) AS pos_rate, avg(prob) AS mean_prob,
  -avg(label * ln(least(greatest(prob, 1e-15), 1 - 1e-15)) + (1 - label) * ln(1 - least(greatest(prob, 1e-15), 1 - 1e-15))) AS log_loss
  FROM sc GROUP BY ALL),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM c)
SELECT strftime(r.k, '%Y-%m-%d %H:%M') AS day, n, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 6) AS f1_score, round(log_loss, 6) AS log_loss,
  round(a.roc_auc, 6) AS roc_auc, round(pos_rate, 6) AS pos_rate, round(mean_prob, 6) AS mean_prob,
  round(ba.roc_auc - a.roc_auc, 6) AS delta_roc_auc, coalesce(ba.roc_auc - a.roc_auc >= 0.05, false) AS alert
FROM r JOIN a ON a.k = r.k, ba WHERE r.k + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def drift_stream_metrics(spark, sf_dir):
    """Six metrics and the alert for every window that the watermark has closed."""
    def scored(events):
        return FIXED.transform(events.select("event_id", "ts", "user_id", "value", (F.col("event_type") == "purchase").cast("int").alias("label")))
    base = scored(load_table(spark, sf_dir, "events")).filter("user_id % 2 = 0")
    baseline = M.binned_metrics(M.binned_counts(base, "label", "prediction", "prob", [F.lit(1).alias("k")], 4096), ["k"])
    out = J.drift_windows(scored(_events_stream(spark, sf_dir)), baseline, "ts")
    return round_doubles(spark.read.parquet(J.run_available_now(out, "drift_metrics")))
