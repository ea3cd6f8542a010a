"""Batch scoring against a fitted model (re-aim of a request/response scoring service).

``score_batch``: align the incoming frame to the model's feature names (missing ->
fill, extras dropped, unparsable -> fill), run the model, take P(class 1), predict
at ``threshold`` and attach an interpretation text.  A pure projection on top of
``model.transform``: it runs per partition with no shuffle, so it is the same code
path for a batch table and for each micro-batch of a stream.
"""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import q
from tessera.operators.clean import align_features
from tessera.operators.stored import Stored

# --- fixed values: interpretation templates --------------------------------------
HIGH_WITH_CONF = "High probability of the positive class (confidence %.1f%%)."
LOW_WITH_CONF = "Low probability of the positive class (confidence %.1f%%)."
HIGH = "High probability of the positive class."
LOW = "Low probability of the positive class."
# -----------------------------------------------------------------------------------


class LinearLogit(Stored):
    """Logistic model with fixed coefficients: prob = 1 / (1 + exp(-(b0 + sum w_i x_i))).
    Produces ``prob`` (double) and ``prediction`` (int) as column expressions."""

    def state(self) -> dict:
        return {"weights": self.weights, "intercept": self.intercept, "threshold": self.threshold}

    def __init__(self, weights: dict, intercept: float = 0.0, threshold: float = 0.5):
        super().__init__()
        self.weights = dict(weights)
        self.intercept = float(intercept)
        self.threshold = float(threshold)

    @property
    def feature_names(self) -> list[str]:
        return list(self.weights)

    def margin(self) -> Column:
        m = F.lit(self.intercept)
        for c, w in self.weights.items():
            m = m + F.lit(float(w)) * F.col(q(c)).cast("double")
        return m

    def _transform(self, df: DataFrame) -> DataFrame:
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))
        return df.withColumn("prob", p).withColumn(
            "prediction", (F.col("prob") >= F.lit(self.threshold)).cast("int"))


def interpretation(pred: Column, prob: Column | None) -> Column:
    if prob is None:
        return F.when(pred >= 1, F.lit(HIGH)).otherwise(F.lit(LOW))
    pct = prob * F.lit(100.0)
    return (F.when(prob.isNull() & (pred >= 1), F.lit(HIGH))
            .when(prob.isNull(), F.lit(LOW))
            .when(pred >= 1, F.format_string(HIGH_WITH_CONF, pct))
            .otherwise(F.format_string(LOW_WITH_CONF, pct)))


def positive_probability(df: DataFrame) -> Column:
    """P(class 1) from either a ``prob`` double or a Spark ML ``probability`` vector."""
    if "prob" in df.columns:
        return F.col("prob")
    if "probability" in df.columns:
        return vector_to_array(F.col("probability"))[1]
    return F.lit(None).cast("double")


def score_batch(df: DataFrame, model: Transformer, feature_names: list[str], keys=(),
                threshold: float = 0.5, fill_value: float = 0.0, return_probabilities: bool = True,
                meta: dict | None = None) -> DataFrame:
    """(keys..., prediction, probability?, interpretation[, model_version, algorithm])."""
    if not feature_names:
        raise ValueError("model metadata has no feature names")
    aligned = align_features(df, feature_names, fill_value=fill_value, keep=keys)
    out = model.transform(aligned)
    prob = positive_probability(out)
    out = out.withColumn("_p", prob)
    pred = F.when(F.col("_p").isNotNull(), (F.col("_p") >= F.lit(threshold)).cast("int")) \
            .otherwise(F.col("prediction").cast("int"))
    cols = [F.col(q(k)) for k in keys] + [pred.alias("prediction")]
    if return_probabilities:
        cols.append(F.col("_p").alias("probability"))
    cols.append(interpretation(pred, F.col("_p") if return_probabilities else None).alias("interpretation"))
    if meta:
        cols += [F.lit(str(meta.get("version"))).alias("model_version"),
                 F.lit(str(meta.get("algorithm"))).alias("algorithm")]
    return out.select(*cols)


#: records stay JSON text until each is parsed by itself, so one bad record spoils no other
_ENVELOPE = "records array<string>, return_probabilities boolean"


def score_requests(requests: DataFrame, key: str, body: str, model: Transformer, feature_names: list[str],
                   threshold: float = 0.5, fill_value: float = 0.0, meta: dict | None = None) -> DataFrame:
    """One response per request: (key, n_records, predictions, probabilities, interpretations, bad_records,
    error, model_version, algorithm).

    ``body`` is the JSON envelope ``{"records": [{...}, ...], "return_probabilities": bool}`` (true
    when absent).  Records are exploded with their positions, scored by ``score_batch`` and
    gathered again by request in the order they came in; a record that is no object has NULLs in the
    lists and its position in ``bad_records``.  Without probabilities asked for,
    ``probabilities`` is NULL and the texts name no confidence.  A body that is not an envelope has
    ``error`` and no lists.  ``key`` must be unique; a response is one row, as long as its request."""
    if not feature_names:
        raise ValueError("model metadata has no feature names")
    parsed = requests.select(F.col(q(key)).alias("_key"), F.from_json(F.col(q(body)), _ENVELOPE).alias("e")) \
        .select("_key", F.col("e.records").alias("records"), F.coalesce("e.return_probabilities", F.lit(True)).alias("asked"))
    each = parsed.select("_key", "asked", F.posexplode("records").alias("_at", "text")) \
        .withColumn("r", F.from_json("text", "map<string,string>"))
    ready = each.select("_key", "_at", "asked", F.col("r").isNull().alias("_bad"), *[F.col("r")[c].alias(c) for c in feature_names])
    scored = score_batch(ready, model, feature_names, ["_key", "_at", "asked", "_bad"], threshold, fill_value)
    good = lambda c: F.when(~F.col("_bad"), c)
    text = F.when(F.col("asked"), F.col("interpretation")).otherwise(interpretation(F.col("prediction"), None))
    one = F.struct("_at", good(F.col("prediction")).alias("prediction"), good(F.col("probability")).alias("probability"),
                   good(text).alias("interpretation"), "_bad")
    lists = scored.groupBy("_key").agg(F.sort_array(F.collect_list(one)).alias("all"))
    out = parsed.join(lists, "_key", "left")
    none = F.size("records") == 0
    part = lambda name, kind: F.when(none, F.array().cast(f"array<{kind}>")).otherwise(F.col(f"all.{name}"))
    bad = F.transform(F.filter("all", lambda r: r["_bad"]), lambda r: r["_at"])
    meta = meta or {}
    return out.select(
        F.col("_key").alias(key), F.when(F.col("records").isNotNull(), F.size("records")).alias("n_records"), part("prediction", "int").alias("predictions"),
        F.when(F.col("asked"), part("probability", "double")).alias("probabilities"), part("interpretation", "string").alias("interpretations"),
        F.when(none, F.array().cast("array<int>")).otherwise(bad).alias("bad_records"),
        F.when(F.col("records").isNull(), F.lit("the body is not an object with a list of records")).alias("error"),
        F.lit(meta.get("version")).cast("string").alias("model_version"), F.lit(meta.get("algorithm")).cast("string").alias("algorithm"))
