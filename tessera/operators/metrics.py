"""Exact distributed classification metrics.

* accuracy / precision / recall / F1 (positive class 1, zero division -> 0),
  log-loss (clipped to [1e-15, 1 - 1e-15]), counts: ONE aggregate (optionally by slice);
* ROC-AUC: tie-aware Mann-Whitney on scores grouped to distinct values -
  sum_s P_s * (N_before(s) + N_s / 2) / (P * N) with N_before from ``ordered_prefix``
  (no single-task sort; ``BinaryClassificationEvaluator`` would bin to 1000 points);
* confusion matrix (dense over the union of labels) and per-class report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import q
from tessera.operators.rank import join_null_safe, ordered_prefix

EPS = 1e-15


def _c(c) -> Column:
    return F.col(q(c)) if isinstance(c, str) else c


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def count_metrics(df: DataFrame, label: str, pred: str, prob: str | None = None, by=()) -> DataFrame:
    """(by..., n, accuracy, precision, recall, f1_score[, log_loss]) in one aggregate."""
    y, yh = _c(label).cast("int"), _c(pred).cast("int")
    tp = F.count_if((y == 1) & (yh == 1)).cast("double")
    fp = F.count_if((y != 1) & (yh == 1)).cast("double")
    fn = F.count_if((y == 1) & (yh != 1)).cast("double")
    n = F.count(F.lit(1))
    aggs = [n.alias("n"), F.avg((y == yh).cast("double")).alias("accuracy"),
            tp.alias("_tp"), fp.alias("_fp"), fn.alias("_fn")]
    if prob is not None:
        p = F.least(F.greatest(_c(prob).cast("double"), F.lit(EPS)), F.lit(1 - EPS))
        aggs.append((-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))
    g = df.groupBy(*[_c(b) for b in by]).agg(*aggs)
    prec = F.coalesce(F.try_divide(F.col("_tp"), F.col("_tp") + F.col("_fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("_tp"), F.col("_tp") + F.col("_fn")), F.lit(0.0))
    cols = [*by, "n", "accuracy", prec.alias("precision"), rec.alias("recall"), _f1(prec, rec).alias("f1_score")]
    if prob is not None:
        cols.append("log_loss")
    return g.select(*cols)


def roc_auc(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    """(by..., roc_auc); NULL when a slice has only one class.  Rows without a label count for
    neither class."""
    by = list(by)
    y = _c(label).cast("int")
    g = (df.filter(_c(score).isNotNull())
         .groupBy(*[_c(b) for b in by], _c(score).cast("double").alias("_s"))
         .agg(F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("_p"),
              F.sum(F.when(y != 1, 1).otherwise(0)).cast("long").alias("_q")))
    pref = ordered_prefix(g, "_s", ["_q"], by=by)
    contrib = F.col("_p").cast("double") * (F.col("_q_before").cast("double") + F.col("_q").cast("double") / 2.0)
    a = pref.groupBy(*by).agg(F.sum(contrib).alias("_num"), F.sum("_p").cast("double").alias("_P"),
                              F.sum("_q").cast("double").alias("_N"))
    return a.select(*by, F.try_divide(F.col("_num"), F.col("_P") * F.col("_N")).alias("roc_auc"))


def log_loss(df: DataFrame, label: str, prob: str) -> DataFrame:
    y = _c(label).cast("double")
    p = F.least(F.greatest(_c(prob).cast("double"), F.lit(EPS)), F.lit(1 - EPS))
    return df.agg((-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def score_bin(prob, bins: int) -> Column:
    """Number of the equal-width bin of a probability, 0 to bins - 1."""
    return F.least(F.greatest(F.floor(_c(prob).cast("double") * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def binned_counts(df: DataFrame, label: str, pred: str, prob: str, by, bins: int) -> DataFrame:
    """(by..., bin, p, q, n, ...): sums that merge over any split of the rows, one row per score bin:
    the state from which ``binned_metrics`` gets all six metrics."""
    y, yh = _c(label).cast("int"), _c(pred).cast("int")
    x = F.least(F.greatest(_c(prob).cast("double"), F.lit(EPS)), F.lit(1 - EPS))
    return df.groupBy(*[_c(b) if isinstance(b, str) else b for b in by], score_bin(prob, bins).alias("bin")).agg(
        F.count_if(y == 1).alias("p"), F.count_if(y != 1).alias("q"), F.count(F.lit(1)).alias("n"), F.count_if(y == yh).alias("same"),
        F.count_if((y == 1) & (yh == 1)).alias("tp"), F.count_if((y != 1) & (yh == 1)).alias("fp"), F.count_if((y == 1) & (yh != 1)).alias("fn"),
        F.sum(-(y * F.log(x) + (1 - y) * F.log(1 - x))).alias("loss"), F.count(y).alias("labelled"), F.sum(y.cast("double")).alias("positive"),
        F.sum(_c(prob).cast("double")).alias("prob"))


def binned_metrics(counts: DataFrame, by) -> DataFrame:
    """(by..., n, accuracy, precision, recall, f1_score, log_loss, roc_auc, pos_rate, mean_prob).  The AUC
    takes scores of one bin as equal: it is off the exact one by at most half the share of
    (positive, negative) pairs that meet in a bin.  A group's bins (a fixed number) meet in one row."""
    hist = F.sort_array(F.collect_list(F.struct("bin", "p", "q")))
    g = counts.groupBy(*by).agg(hist.alias("h"), *[F.sum(c).alias(c) for c in ("p", "q", "n", "same", "tp", "fp", "fn", "loss", "labelled",
                                                                             "positive", "prob")])
    start = F.struct(F.lit(0.0).alias("won"), F.lit(0.0).alias("below"))
    won = F.aggregate("h", start, lambda a, b: F.struct((a["won"] + b["p"] * (a["below"] + b["q"] / 2.0)).alias("won"),
                                                        (a["below"] + b["q"]).alias("below")))["won"]
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")), F.lit(0.0))
    rows = F.col("labelled").cast("double")
    return g.select(*by, "n", F.try_divide(F.col("same").cast("double"), rows).alias("accuracy"), prec.alias("precision"), rec.alias("recall"),
                    _f1(prec, rec).alias("f1_score"), F.try_divide(F.col("loss"), rows).alias("log_loss"),
                    F.try_divide(won, F.col("p").cast("double") * F.col("q").cast("double")).alias("roc_auc"),
                    F.try_divide(F.col("positive"), rows).alias("pos_rate"), F.try_divide(F.col("prob"), F.col("n").cast("double")).alias("mean_prob"))


def evaluate(df: DataFrame, label: str = "label", pred: str = "prediction", prob: str | None = "prob",
             by=()) -> DataFrame:
    """All six reference metrics per slice: count metrics joined with AUC (both tiny)."""
    m = count_metrics(df, label, pred, prob, by)
    if prob is None:
        return m.withColumn("roc_auc", F.lit(None).cast("double")).withColumn("log_loss", F.lit(None).cast("double"))
    a = roc_auc(df, label, prob, by)
    if by:
        return join_null_safe(m, a, list(by), "left")
    # both sides are single rows: attach on a constant key
    return m.withColumn("_k", F.lit(1)).join(F.broadcast(a.withColumn("_k", F.lit(1))), "_k", "left").drop("_k")


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Dense (actual, pred, n) over the union of labels seen in either column; NULL is a label like
    any other.  The grid is made by Spark from the labels that occur (labels x labels rows)."""
    pairs = df.groupBy(_c(label).alias("actual"), _c(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    labels = pairs.select(F.col("actual").alias("v")).union(pairs.select("pred")).distinct()
    grid = labels.select(F.col("v").alias("actual"), F.lit(1).alias("k")) \
        .join(labels.select(F.col("v").alias("pred"), F.lit(1).alias("k")), "k").drop("k")
    return join_null_safe(grid, pairs, ["actual", "pred"], "left").select(
        "actual", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per class precision / recall / f1 / support, then accuracy, macro and weighted averages."""
    y, yh = _c(label), _c(pred)
    per = (df.select(y.cast("string").alias("y"), yh.cast("string").alias("yh"))
           .select(F.explode(F.array_distinct(F.array("y", "yh"))).alias("class"), "y", "yh")
           .groupBy("class").agg(F.count_if(F.col("y") == F.col("class")).alias("support"),
                                 F.count_if(F.col("yh") == F.col("class")).alias("predicted"),
                                 F.count_if((F.col("y") == F.col("class")) & (F.col("yh") == F.col("class")))
                                 .alias("tp")))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    per = per.select("class", prec.alias("precision"), rec.alias("recall"), _f1(prec, rec).alias("f1_score"),
                     F.col("support").cast("long").alias("support"), "tp")
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1_score") * F.col("support")).alias("wf"))
    n = F.col("n").cast("double")
    summary = tot.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), (F.col("tp") / n).alias("f1_score"),
                 F.col("n").cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1_score"), F.col("n").cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), (F.col("wp") / n).alias("precision"),
                 (F.col("wr") / n).alias("recall"), (F.col("wf") / n).alias("f1_score"),
                 F.col("n").cast("long").alias("support")),
    )).alias("s")).select("s.*")
    return per.drop("tp").unionByName(summary)
