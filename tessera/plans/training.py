"""Training, validation and selection queries.

Trained-model queries carry no SQL oracle (the driver records a rows-only check);
their learning is asserted in pytest on a fixture with a planted signal.  The
selection queries run on a grid of fixed-form scorers, so DuckDB can check them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import models as ML
from tessera.operators import pipeline as PL
from tessera.operators import selection as SEL
from tessera.operators import split as SP
from tessera.plans.common import register
from tessera.plans.profiling import round_doubles
from tessera.operators.clean import CleanConfig
from tessera.operators.registry import Registry
from tessera.plans.standins import dirty_lineitem
from tessera.session import cut_lineage, scratch_path
from tessera.sources.tables import load_table

DOC_FEATURES = ["n_chars", "n_words", "n_lines", "upper_ratio", "digit_ratio", "excl"]


def doc_features(spark, sf_dir):
    """Numeric features over the whole text of every labelled document; label = toxic."""
    d = load_table(spark, sf_dir, "documents")
    lab = load_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    t = F.col("text")
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    feats = d.select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        (F.regexp_count(t, F.lit(r"\S+"))).cast("double").alias("n_words"),
        (F.regexp_count(t, F.lit("\n")) + 1).cast("double").alias("n_lines"),
        (F.regexp_count(t, F.lit("[A-Z]")) / n).alias("upper_ratio"),
        (F.regexp_count(t, F.lit("[0-9]")) / n).alias("digit_ratio"),
        F.regexp_count(t, F.lit("!")).cast("double").alias("excl"))
    # AQE broadcasts the label side at run time when it is small; the feature table is
    # read by the split, the fit and the evaluation, so its lineage is cut once
    # (reliable checkpoint in the shared folder) instead of re-scanning every text
    return cut_lineage(feats.join(lab, "doc_id"))


def doc_split(spark, sf_dir):
    df = cut_lineage(SP.stratified_split(doc_features(spark, sf_dir), "label", "doc_id", 0.2, seed=42), "split")
    return df.filter(F.col("split") == "train"), df.filter(F.col("split") == "test")


def _trained(algorithm, params, balanced=True):
    def q(spark, sf_dir):
        train, test = doc_split(spark, sf_dir)
        _, m = ML.fit_evaluate(train, test, DOC_FEATURES, algorithm, params, "label", balanced)
        return round_doubles(m.withColumn("algorithm", F.lit(algorithm)))
    q.__doc__ = f"Fit {algorithm} on the train split of labelled documents; exact metrics on the test split."
    return q


register("logreg_metrics")(_trained("logreg", {"C": 0.1, "penalty": "l2", "max_iter": 500}))
register("rf_metrics")(_trained("rf", {"n_estimators": 300, "max_depth": 8, "min_samples_leaf": 4}))
register("gbt_metrics")(_trained("gb", {"n_estimators": 150, "learning_rate": 0.05, "max_depth": 3,
                                        "subsample": 0.8, "min_samples_leaf": 2}, balanced=False))
register("svc_metrics")(_trained("svc", {"C": 0.5, "n_components": 64}))
register("knn_metrics")(_trained("knn", {"n_neighbors": 11, "weights": "distance"}, balanced=False))


@register("feature_importance")
def feature_importance(spark, sf_dir):
    """Random-forest importances of the document features, strongest first (top 15)."""
    train, _ = doc_split(spark, sf_dir)
    model = ML.fit(train, DOC_FEATURES, "rf", {"n_estimators": 300, "max_depth": 8}, "label", balanced=True)
    return spark.createDataFrame(ML.feature_importance(model, DOC_FEATURES, 15), "feature string, importance double")


@register("cv_scores")
def cv_scores(spark, sf_dir):
    """5-fold stratified CV (deterministic fold ids) of logistic regression: accuracy per fold."""
    df = cut_lineage(SP.fold_ids(doc_features(spark, sf_dir), "doc_id", "label", k=5, seed=42), "folds")
    rows = []
    for f in range(5):
        _, m = ML.fit_evaluate(df.filter(F.col("fold") != f), df.filter(F.col("fold") == f), DOC_FEATURES,
                               "logreg", {"C": 1.0, "max_iter": 500}, "label", balanced=True)
        rows.append((f, m.first()["accuracy"]))
    return spark.createDataFrame(rows, "fold int, accuracy double")


@register("grid_cv")
def grid_cv(spark, sf_dir):
    """The cross-validated grids of all four algorithms (71 combinations): every combination fitted on four
    of five stratified folds and scored by accuracy on the fifth."""
    df = SP.fold_ids(doc_features(spark, sf_dir), "doc_id", "label", k=5, seed=42)
    return round_doubles(ML.cross_validate(df, DOC_FEATURES, PL.CV_GRIDS, "label", k=5, parallelism=8))


@register("grid_search")
def grid_search(spark, sf_dir):
    """The configured grids of all five algorithms on one split, fitted concurrently; run table by score."""
    train, test = doc_split(spark, sf_dir)
    table, _ = ML.grid_search(train, test, DOC_FEATURES, PL.GRIDS, "label", "roc_auc", parallelism=8, written=True)
    return table


@register("champion_scores")
def champion_scores(spark, sf_dir):
    """The whole way on the raw lineitem stand-in: clean, profile, split, trials, registry; then the
    raw rows again through the stored cleaner and the stored champion."""
    raw = dirty_lineitem(spark, sf_dir).withColumn("Row Id", F.concat_ws("-", *[F.col(f"`{c}`") for c in ("Order Key", "Line No.", "Part Key", "Supp Key")])) \
        .withColumn("Returned", F.when(F.trim("Return Flag") == "R", "1").otherwise("0")).drop("Return Flag", "flag_label")
    config = PL.PipelineConfig("Returned", "Row Id", CleanConfig(protect=("returned", "row_id")), {"logreg": PL.GRIDS["logreg"]}, keep_clean=False)
    registry = Registry(spark, scratch_path(spark, f"registry-{uuid.uuid4().hex[:12]}"))
    PL.run_pipeline(raw, config, registry, "lineitem")
    return round_doubles(PL.score_raw(raw, registry))


# ---------------------------------------------------------------- selection (SQL-checkable)
ALGOS = {
    "logit_value": {"feature": "value", "grid": {"slope": [0.01, 0.02, 0.05], "threshold": [0.3, 0.5, 0.7]}},
    "logit_user": {"feature": "user_id", "grid": {"slope": [0.0001, 0.001], "threshold": [0.3, 0.5]}},
}


def _trials_sql():
    rows = ", ".join(f"({no}, '{a}', '{f}', CAST({s!r} AS DOUBLE), CAST({t!r} AS DOUBLE))"
                     for no, a, f, s, t in SEL.expand_trials(ALGOS))
    return f"""WITH tr AS (SELECT * FROM (VALUES {rows}) t(trial_no, algorithm, feature, slope, threshold)),
x0 AS (SELECT tr.trial_no, CASE WHEN e.event_type = 'purchase' THEN 1 ELSE 0 END AS y,
   1.0 / (1.0 + exp(-(-1.0 + tr.slope * CASE tr.feature WHEN 'value' THEN e.value WHEN 'user_id' THEN CAST(e.user_id AS DOUBLE) END))) AS p,
   tr.threshold FROM events e CROSS JOIN tr),
x AS (SELECT *, CASE WHEN p >= threshold THEN 1 ELSE 0 END AS yh FROM x0),
g AS (SELECT trial_no, p, sum(y) AS pp, sum(1 - y) AS qq FROM x GROUP BY trial_no, p),
cu AS (SELECT trial_no, pp, qq, coalesce(sum(qq) OVER (PARTITION BY trial_no ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS qb FROM g),
au AS (SELECT trial_no, sum(pp * (qb + qq / 2.0)) / (sum(pp) * sum(qq)) AS roc_auc FROM cu GROUP BY trial_no),
c AS (SELECT trial_no, count(*) AS n, avg(CASE WHEN y = yh THEN 1.0 ELSE 0.0 END) AS accuracy,
  count(*) FILTER (WHERE y = 1 AND yh = 1) AS tp, count(*) FILTER (WHERE y <> 1 AND yh = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND yh <> 1) AS fn,
  -avg(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15))) AS log_loss
  FROM x GROUP BY trial_no),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM c),
runs AS (SELECT tr.trial_no, tr.algorithm, tr.feature, tr.slope, tr.threshold, pr.n, pr.accuracy, pr.precision, pr.recall,
  coalesce(2 * pr.precision * pr.recall / nullif(pr.precision + pr.recall, 0), 0.0) AS f1_score, au.roc_auc, pr.log_loss
  FROM tr JOIN pr ON tr.trial_no = pr.trial_no JOIN au ON tr.trial_no = au.trial_no),
runs2 AS (SELECT *, coalesce(f1_score, '-inf'::DOUBLE) AS score FROM runs)"""


_RUN_COLS = ("trial_no, algorithm, feature, slope, threshold, n, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, "
             "round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, round(roc_auc, 6) AS roc_auc, "
             "round(log_loss, 6) AS log_loss, round(score, 6) AS score")


def _runs(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events").withColumn("y", (F.col("event_type") == "purchase").cast("int"))
    return SEL.evaluate_trials(ev, "y", ALGOS, intercept=-1.0, scoring="f1_score")


@register("trial_runs", _trials_sql() + f"\nSELECT {_RUN_COLS} FROM runs2")
def trial_runs(spark, sf_dir):
    return round_doubles(_runs(spark, sf_dir))


@register("best_by_algorithm", _trials_sql() + f""",
b AS (SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY score DESC, trial_no) AS rr FROM runs2)
SELECT {_RUN_COLS} FROM b WHERE rr = 1""")
def best_by_algorithm(spark, sf_dir):
    return round_doubles(SEL.best_by_algorithm(_runs(spark, sf_dir)))


@register("best_overall", _trials_sql() + f"\nSELECT {_RUN_COLS} FROM runs2 ORDER BY score DESC, trial_no LIMIT 1")
def best_overall(spark, sf_dir):
    return round_doubles(SEL.best_overall(_runs(spark, sf_dir)))


def stored_runs(spark, sf_dir) -> Registry:
    """One run per algorithm in a new registry, with what must not be seen beside them: a run
    published twice and an attempt that died before its marker."""
    runs = cut_lineage(_runs(spark, sf_dir), "runs")
    registry = Registry(spark, scratch_path(spark, f"registry-{uuid.uuid4().hex[:12]}"))
    for algorithm in ALGOS:
        registry.publish(algorithm, runs.filter(F.col("algorithm") == algorithm))
        registry.publish(algorithm, runs.filter(F.col("algorithm") == algorithm))
    runs.withColumn("run_id", F.lit("dead")).write.parquet(f"{registry.root}/runs/dead/attempt-0/records")
    return registry


@register("registry_runs", _trials_sql() + f"\nSELECT algorithm AS run_id, {_RUN_COLS} FROM runs2")
def registry_runs(spark, sf_dir):
    """Run records written to a stored registry and read back."""
    return round_doubles(stored_runs(spark, sf_dir).runs().drop("registered_at", "model_path", "meta"))


@register("registry_latest", _trials_sql() + """,
b AS (SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY score DESC, trial_no) AS rr FROM runs2),
reg AS (SELECT 'v' || lpad(CAST(trial_no AS VARCHAR), 4, '0') AS version,
  CASE algorithm WHEN 'logit_value' THEN 0 WHEN 'logit_user' THEN 1 END AS registered_order, * FROM b WHERE rr = 1)
SELECT version, registered_order, algorithm, trial_no, round(score, 6) AS score, round(roc_auc, 6) AS roc_auc
FROM reg ORDER BY score DESC, registered_order DESC LIMIT 1""")
def registry_latest(spark, sf_dir):
    """The current champion, by a query over the stored registry."""
    reg = SEL.register(stored_runs(spark, sf_dir).champions(), list(ALGOS))
    return round_doubles(SEL.registry_latest(reg).select("version", "registered_order", "algorithm", "trial_no",
                                                         "score", "roc_auc"))


@register("overfit_check")
def overfit_check(spark, sf_dir):
    """Accuracy (and AUC) of one logistic model on its own train split and on the test split."""
    from tessera.operators.metrics import evaluate
    train, test = doc_split(spark, sf_dir)
    model = ML.fit(train, DOC_FEATURES, "logreg", {"C": 1.0, "max_iter": 500}, "label", balanced=True)
    parts = [evaluate(ML.predict(model, d), "label", "prediction", "prob").withColumn("split", F.lit(name))
             for name, d in (("train", train), ("test", test))]
    return round_doubles(parts[0].unionByName(parts[1]))
