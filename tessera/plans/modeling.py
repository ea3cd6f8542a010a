"""Split, weights, metrics and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import scoring as S
from tessera.operators import split as SP
from tessera.plans.common import register
from tessera.plans.profiling import round_doubles
from tessera.sources.records import records_from_json_column
from tessera.sources.tables import load_table

SEED = 42

# ---------------------------------------------------------------- M1 / M3
_SPLIT_SQL = """WITH o AS (SELECT o_orderkey, o_orderstatus,
    row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey) AS rn,
    count(*) OVER (PARTITION BY o_orderstatus) AS nc FROM orders),
sp AS (SELECT o_orderkey, o_orderstatus, CASE WHEN rn <= ceil(nc * 0.2) THEN 'test' ELSE 'train' END AS split FROM o)"""


def split_orders(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return SP.stratified_split(o, "o_orderstatus", "o_orderkey", test_frac=0.2, seed=SEED)


@register("stratified_split", _SPLIT_SQL + "\nSELECT o_orderkey, split FROM sp")
def stratified_split(spark, sf_dir):
    return split_orders(spark, sf_dir).select("o_orderkey", "split")


@register("class_weights", _SPLIT_SQL + """,
t AS (SELECT o_orderstatus AS class, count(*) AS n FROM sp WHERE split = 'train' GROUP BY o_orderstatus)
SELECT class, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM t""")
def class_weights(spark, sf_dir):
    train = split_orders(spark, sf_dir).filter(F.col("split") == "train")
    return round_doubles(SP.class_weights(train, "o_orderstatus"))


# ---------------------------------------------------------------- fixed-coefficient scorer on events
FIXED = S.LinearLogit({"value": 0.02}, intercept=-1.0)
_SCORED_SQL = """WITH sc0 AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
    1.0 / (1.0 + exp(-(-1.0 + 0.02 * value))) AS prob FROM events),
sc AS (SELECT *, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS prediction FROM sc0)"""


def scored_events(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events")
    return FIXED.transform(ev.select("event_id", "value", "ts", "user_id",
                                     (F.col("event_type") == "purchase").cast("int").alias("label")))


@register("classification_metrics", _SCORED_SQL + """,
c AS (SELECT count(*) AS n, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy,
  count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn FROM sc),
p AS (SELECT n, accuracy, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM c)
SELECT n, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 6) AS f1_score FROM p""")
def classification_metrics(spark, sf_dir):
    return round_doubles(M.count_metrics(scored_events(spark, sf_dir), "label", "prediction"))


_AUC_SQL = """,
g AS (SELECT prob, sum(label) AS p, sum(1 - label) AS q FROM sc GROUP BY prob),
cu AS (SELECT prob, p, q, coalesce(sum(q) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS qb FROM g)"""


@register("roc_auc", _SCORED_SQL + _AUC_SQL + """
SELECT round(sum(p * (qb + q / 2.0)) / (sum(p) * sum(q)), 6) AS roc_auc FROM cu""")
def roc_auc(spark, sf_dir):
    return round_doubles(M.roc_auc(scored_events(spark, sf_dir), "label", "prob"))


@register("log_loss", _SCORED_SQL + """
SELECT round(-avg(label * ln(least(greatest(prob, 1e-15), 1 - 1e-15))
  + (1 - label) * ln(1 - least(greatest(prob, 1e-15), 1 - 1e-15))), 6) AS log_loss FROM sc""")
def log_loss(spark, sf_dir):
    return round_doubles(M.log_loss(scored_events(spark, sf_dir), "label", "prob"))


@register("confusion_matrix", _SCORED_SQL + """,
l AS (SELECT DISTINCT label AS v FROM sc UNION SELECT DISTINCT prediction FROM sc),
c AS (SELECT label AS actual, prediction AS pred, count(*) AS n FROM sc GROUP BY ALL)
SELECT a.v AS actual, b.v AS pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM l a CROSS JOIN l b LEFT JOIN c ON c.actual = a.v AND c.pred = b.v""")
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(scored_events(spark, sf_dir), "label", "prediction")


@register("classification_report", _SCORED_SQL + """,
k AS (SELECT DISTINCT CAST(v AS VARCHAR) AS class FROM (SELECT label AS v FROM sc UNION SELECT prediction FROM sc)),
per AS (SELECT k.class, count(*) FILTER (WHERE CAST(label AS VARCHAR) = k.class) AS support,
  count(*) FILTER (WHERE CAST(prediction AS VARCHAR) = k.class) AS predicted,
  count(*) FILTER (WHERE CAST(label AS VARCHAR) = k.class AND CAST(prediction AS VARCHAR) = k.class) AS tp
  FROM k, sc GROUP BY k.class),
m AS (SELECT class, coalesce(tp / nullif(predicted, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall,
  support, tp FROM per),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1_score FROM m)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1_score * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def classification_report(spark, sf_dir):
    return round_doubles(M.classification_report(scored_events(spark, sf_dir), "label", "prediction"))


@register("evaluate_metrics", _SCORED_SQL + _AUC_SQL + """,
c AS (SELECT count(*) AS n, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy,
  count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn,
  -avg(label * ln(least(greatest(prob, 1e-15), 1 - 1e-15)) + (1 - label) * ln(1 - least(greatest(prob, 1e-15), 1 - 1e-15))) AS ll FROM sc),
p AS (SELECT n, accuracy, ll, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM c),
a AS (SELECT sum(p * (qb + q / 2.0)) / (sum(p) * sum(q)) AS auc FROM cu)
SELECT n, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 6) AS f1_score,
  round(ll, 6) AS log_loss, round(a.auc, 6) AS roc_auc FROM p, a""")
def evaluate_metrics(spark, sf_dir):
    return round_doubles(M.evaluate(scored_events(spark, sf_dir), "label", "prediction", "prob"))


# ---------------------------------------------------------------- D1 / D2 / S8
_TXT = (f"CASE WHEN prediction >= 1 THEN printf('{S.HIGH_WITH_CONF}', prob * 100) "
        f"ELSE printf('{S.LOW_WITH_CONF}', prob * 100) END")


@register("score_batch", _SCORED_SQL + f"""
SELECT event_id, prediction, round(prob, 6) AS probability, {_TXT} AS interpretation FROM sc""")
def score_batch(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events")
    out = S.score_batch(ev, FIXED, FIXED.feature_names, keys=["event_id"])
    return round_doubles(out)


@register("interpret_predictions", _SCORED_SQL + f"""
SELECT event_id, prediction, CASE WHEN prediction >= 1 THEN '{S.HIGH}' ELSE '{S.LOW}' END AS interpretation FROM sc""")
def interpret_predictions(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events")
    return S.score_batch(ev, FIXED, FIXED.feature_names, keys=["event_id"], return_probabilities=False)


_JSON_MODEL = S.LinearLogit({"k": 0.05, "value": 0.01}, intercept=-3.0)


@register("score_json_records", """WITH r AS (SELECT event_id,
    coalesce(CASE WHEN regexp_matches(trim(json_extract_string(props, '$.k')), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$')
      THEN TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE) END, 0.0) AS k, value FROM events),
s AS (SELECT event_id, 1.0 / (1.0 + exp(-(-3.0 + 0.05 * k + 0.01 * value))) AS prob FROM r)
SELECT event_id, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS prediction, round(prob, 6) AS probability FROM s""")
def score_json_records(spark, sf_dir):
    """Records arrive as JSON objects (one per event); fields are parsed into a map,
    aligned to the model's feature names and scored."""
    ev = load_table(spark, sf_dir, "events")
    rec = ev.select("event_id", "value", records_from_json_column("props").alias("r"))
    flat = rec.select("event_id", "value", F.col("r")["k"].alias("k"))
    out = S.score_batch(flat, _JSON_MODEL, _JSON_MODEL.feature_names, keys=["event_id"])
    return round_doubles(out.drop("interpretation"))


@register("score_requests", """WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place,
    coalesce(CASE WHEN regexp_matches(trim(json_extract_string(props, '$.k')), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$')
      THEN TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE) END, 0.0) AS k, value FROM events),
s AS (SELECT user_id, event_id, place, event_id % 50 = 0 AS bad, 1.0 / (1.0 + exp(-(-3.0 + 0.05 * k + 0.01 * value))) AS prob FROM r)
SELECT user_id, CAST(count(*) AS INTEGER) AS n_records,
  string_agg(CASE WHEN bad THEN 'null' WHEN prob >= 0.5 THEN '1' ELSE '0' END, ',' ORDER BY event_id) AS predictions,
  CASE WHEN user_id % 2 = 0 THEN string_agg(CASE WHEN bad THEN 'null' ELSE printf('%.4f', prob) END, ',' ORDER BY event_id) END AS probabilities,
  coalesce(string_agg(CASE WHEN bad THEN CAST(place AS VARCHAR) END, ',' ORDER BY event_id), '') AS bad_records
FROM s GROUP BY user_id""")
def score_requests(spark, sf_dir):
    """One request per user with all its events as records (some are no objects), one response each."""
    ev = load_table(spark, sf_dir, "events")
    record = F.when(F.col("event_id") % 50 == 0, F.lit("17")) \
        .otherwise(F.to_json(F.struct(F.col("value"), records_from_json_column("props")["k"].alias("k"))))
    bodies = ev.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", record.alias("r")))).alias("all")).select(
        "user_id", F.concat(F.lit('{"records": ['), F.array_join("all.r", ", "), F.lit('], "return_probabilities": '),
                            (F.col("user_id") % 2 == 0).cast("string"), F.lit("}")).alias("body"))
    out = S.score_requests(bodies, "user_id", "body", _JSON_MODEL, _JSON_MODEL.feature_names)
    listed = lambda c, f: F.array_join(F.transform(c, f), ",", "null")
    return out.select("user_id", "n_records", listed("predictions", lambda x: x.cast("string")).alias("predictions"),
                      listed("probabilities", lambda x: F.when(x.isNotNull(), F.format_string("%.4f", x))).alias("probabilities"),
                      listed("bad_records", lambda x: x.cast("string")).alias("bad_records"))
