"""Model and feature drift between populations (slices of one table).

* ``drift_report``: all metrics for baseline and current in ONE grouped aggregate
  (+ grouped AUC), pivoted to one row; delta = baseline - current, alert when the
  AUC drop reaches the threshold.
* ``feature_shift``: per feature, counts per equal-width bin with edges SHARED by
  both slices (one min/max aggregate for all features), plus mean shift and PSI.
* ``metrics_by_window``: the same metrics per event-time window (tumbling).
* ``stress_features``: controlled shift of chosen columns - scale by (1 + s), optional
  hash-seeded Gaussian noise, and a hash-selected share of rows of the first
  columns replaced by the column median (exact percentile, or approximate at scale).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import q
from tessera.functions.values import uniform01
from tessera.operators.metrics import count_metrics, roc_auc
from tessera.operators.profile import bin_expr

METRICS = ["accuracy", "precision", "recall", "f1_score", "roc_auc", "log_loss"]
# fixed values: action texts
ACTION_ALERT = "Review the feature pipeline and plan retraining"
ACTION_OK = "Keep monitoring"


def metrics_by(df: DataFrame, by: list, label="label", pred="prediction", prob="prob") -> DataFrame:
    m = count_metrics(df, label, pred, prob, by)
    a = roc_auc(df, label, prob, by)
    return m.join(a, by, "left")  # both sides: one row per slice


def drift_report(df: DataFrame, slice_col: str, baseline: str, current: str, label="label",
                 pred="prediction", prob="prob", threshold: float = 0.05) -> DataFrame:
    m = metrics_by(df.filter(F.col(q(slice_col)).isin(baseline, current)), [slice_col], label, pred, prob)
    row = m.groupBy().agg(*[F.max(F.when(F.col(q(slice_col)) == baseline, F.col(k))).alias(f"base_{k}") for k in METRICS],
                          *[F.max(F.when(F.col(q(slice_col)) == current, F.col(k))).alias(f"cur_{k}") for k in METRICS])
    delta = F.col("base_roc_auc") - F.col("cur_roc_auc")
    alert = F.coalesce(delta >= F.lit(threshold), F.lit(False))
    return row.select("*", delta.alias("delta_roc_auc"), F.lit(float(threshold)).alias("threshold"),
                      alert.alias("alert"),
                      F.when(alert, F.lit(ACTION_ALERT)).otherwise(F.lit(ACTION_OK)).alias("action"))


def feature_shift(df: DataFrame, slice_col: str, baseline: str, current: str, features, bins: int = 30,
                  eps: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Returns (bins table (feature, bin, n_base, n_cur), summary (feature, mean_base,
    mean_cur, mean_shift, psi))."""
    two = df.filter(F.col(q(slice_col)).isin(baseline, current))
    r = two.agg(*[x for f in features for x in (F.min(F.col(q(f)).cast("double")).alias(f"lo_{f}"),
                                                  F.max(F.col(q(f)).cast("double")).alias(f"hi_{f}"))]).first()
    cur = (F.col(q(slice_col)) == current).cast("int")
    longs = two.select(cur.alias("_cur"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(q(f)).cast("double").alias("v"),
                 bin_expr(F.col(q(f)).cast("double"), r[f"lo_{f}"], r[f"hi_{f}"], bins).alias("bin"))
        for f in features])).alias("s")).select("_cur", "s.*").filter(F.col("v").isNotNull())
    counts = longs.groupBy("feature", "bin").agg(
        F.count_if(F.col("_cur") == 0).alias("n_base"), F.count_if(F.col("_cur") == 1).alias("n_cur"))
    grid = df.sparkSession.createDataFrame([(f,) for f in features], "feature string").select(
        "feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    table = grid.join(counts, ["feature", "bin"], "left").select(
        "feature", "bin", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.coalesce("n_cur", F.lit(0)).cast("long").alias("n_cur"))
    means = longs.groupBy("feature").agg(F.avg(F.when(F.col("_cur") == 0, F.col("v"))).alias("mean_base"),
                                         F.avg(F.when(F.col("_cur") == 1, F.col("v"))).alias("mean_cur"))
    from pyspark.sql import Window
    w = Window.partitionBy("feature")                       # bins rows per feature
    pb = F.greatest(F.col("n_base") / F.sum("n_base").over(w), F.lit(eps))
    pc = F.greatest(F.col("n_cur") / F.sum("n_cur").over(w), F.lit(eps))
    psi = table.select("feature", ((pc - pb) * F.log(pc / pb)).alias("t")).groupBy("feature").agg(
        F.sum("t").alias("psi"))
    summary = means.join(psi, "feature").select("feature", "mean_base", "mean_cur",
                                               (F.col("mean_cur") - F.col("mean_base")).alias("mean_shift"), "psi")
    return table, summary


def metrics_by_window(df: DataFrame, ts: str, duration: str = "1 day", label="label", pred="prediction",
                      prob="prob") -> DataFrame:
    """Tumbling event-time windows: (window_start, n, accuracy, ..., roc_auc, pos_rate, mean_prob)."""
    w = df.withColumn("window_start", F.window(F.col(q(ts)).cast("timestamp"), duration).start)
    m = metrics_by(w, ["window_start"], label, pred, prob)
    extra = w.groupBy("window_start").agg(F.avg(F.col(q(label)).cast("double")).alias("pos_rate"),
                                          F.avg(F.col(q(prob))).alias("mean_prob"))
    return m.join(extra, "window_start")


def _gauss(key: Column, seed, salt: str) -> Column:
    """Standard normal from two hash uniforms (Box-Muller)."""
    u1 = F.greatest(uniform01(key, seed, salt + ":n1"), F.lit(1e-12))
    u2 = uniform01(key, seed, salt + ":n2")
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2 * math.pi * u2)


def stress_features(df: DataFrame, features, key: Column, severity: float = 0.3, noise: bool = True,
                    seed: int = 42, exact_median: bool = True, keys=()) -> DataFrame:
    s = float(severity)
    shifted = {}
    for f in features:
        e = F.col(q(f)).cast("double") * F.lit(1.0 + s)
        if noise and s > 0:
            e = e + _gauss(key, seed, f) * F.lit(s)
        shifted[f] = e
    base = df.select(*[F.col(q(k)) for k in keys], key.alias("_key"), *[shifted[f].alias(f) for f in features])
    n_mask = max(1, len(features) // 8)
    masked = list(features)[:n_mask]
    share = min(0.4, s + 0.1)
    if exact_median:
        from tessera.operators.quantiles import quantiles
        med_row = {r["col"]: r["value"] for r in quantiles(base, masked, (0.5,)).collect()}  # one row per column
    else:
        med_row = base.agg(*[F.percentile_approx(f, 0.5, 10000).alias(f) for f in masked]).first().asDict()
    out = []
    for f in features:
        if f in masked:
            hit = uniform01(F.col("_key"), seed, f) < F.lit(share)
            out.append(F.when(hit, F.lit(med_row[f])).otherwise(F.col(f)).alias(f))
        else:
            out.append(F.col(f))
    return base.select(*[F.col(q(k)) for k in keys], *out)
