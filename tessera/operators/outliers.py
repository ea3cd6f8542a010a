"""Notebook analytics: IQR bounds and outliers, per-class statistics and the
variable screen, standardisation and PCA.

* bounds for all columns: ONE aggregate (quantile arrays + min/max per column);
* outlier rows: unpivot (narrow, no shuffle) + broadcast join of the bounds table
  (one row per column: bounded by the schema) + filter;
* per-class statistics: one ``groupBy(class)`` with all variables fused.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import q
from tessera.operators.quantiles import quantile_columns


def _quant(v, probs, exact, accuracy=10000):
    return F.percentile(v, list(probs)) if exact else F.percentile_approx(v, list(probs), accuracy)


def iqr_bounds(df: DataFrame, cols, k: float = 1.5, exact: bool = True) -> DataFrame:
    """(col, q1, q3, iqr, lower, upper, extrem_min, extrem_max); extrem_* = round(min/q1, 2)
    and round(max/q3, 2) (half-even, like pandas) with a zero quartile giving NULL."""
    mm = df.agg(F.array(*[F.struct(F.lit(c).alias("col"), F.min(F.col(q(c)).cast("double")).alias("mn"),
                                   F.max(F.col(q(c)).cast("double")).alias("mx"))
                          for c in cols]).alias("_a")).select(F.inline("_a"))
    if exact:
        qt = quantile_columns(df, cols, (0.25, 0.75), ("q1", "q3"))
    else:
        qt = df.agg(F.array(*[F.struct(F.lit(c).alias("col"),
                                       *[x.alias(n) for x, n in zip(
                                           [_quant(F.col(q(c)).cast("double"), (0.25, 0.75), False)[i] for i in (0, 1)],
                                           ("q1", "q3"))]) for c in cols]).alias("_a")).select(F.inline("_a"))
    raw = mm.join(qt, "col", "left")          # one row per column on both sides
    iqr = F.col("q3") - F.col("q1")
    return raw.select(
        "col", "q1", "q3", iqr.alias("iqr"),
        (F.col("q1") - F.lit(k) * iqr).alias("lower"), (F.col("q3") + F.lit(k) * iqr).alias("upper"),
        F.bround(F.try_divide(F.col("mn"), F.nullif(F.col("q1"), F.lit(0.0))), 2).alias("extrem_min"),
        F.bround(F.try_divide(F.col("mx"), F.nullif(F.col("q3"), F.lit(0.0))), 2).alias("extrem_max"))


def unpivot(df: DataFrame, keys, cols, name: str = "col", value: str = "value") -> DataFrame:
    """Wide -> long (keys..., col, value) as a narrow projection (explode of structs)."""
    arr = F.array(*[F.struct(F.lit(c).alias(name), F.col(q(c)).cast("double").alias(value)) for c in cols])
    return df.select(*[F.col(q(k)) for k in keys], F.explode(arr).alias("_s")).select(*keys, f"_s.{name}", f"_s.{value}")


def iqr_outliers(df: DataFrame, keys, cols, bounds: DataFrame | None = None, k: float = 1.5) -> DataFrame:
    """One row per outlying cell: (keys..., col, value, lower, upper, extrem_min, extrem_max)."""
    bounds = bounds if bounds is not None else iqr_bounds(df, cols, k)
    long = unpivot(df, keys, cols)
    b = bounds.select("col", "lower", "upper", "extrem_min", "extrem_max")
    return (long.join(F.broadcast(b), "col", "inner")          # one row per column
            .filter((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))))


def outlier_counts(outliers: DataFrame) -> DataFrame:
    return outliers.groupBy("col").agg(F.count(F.lit(1)).alias("n_outliers"))


def keep_list(bounds: DataFrame, pct: float = 0.15) -> DataFrame:
    """Columns whose extrem_max <= round(percentile_pct(extrem_max), 2) (non-NULL only).
    The bounds table has one row per column, so this is schema-sized work."""
    nn = bounds.filter(F.col("extrem_max").isNotNull())
    cut = nn.agg(F.round(F.percentile("extrem_max", pct), 2).alias("cut")).first()["cut"]
    if cut is None:
        return nn.select("col", "extrem_max").limit(0)
    return nn.filter(F.col("extrem_max") <= F.lit(cut)).select("col", "extrem_max")


def drop_outlier_rows(df: DataFrame, bounds: DataFrame, cols) -> DataFrame:
    """Remove rows that are IQR outliers in any of ``cols`` (NULL values are kept).
    Bounds become literals (2 numbers per column), so this is a pushed-down filter."""
    rows = {r["col"]: (r["lower"], r["upper"]) for r in bounds.filter(F.col("col").isin(list(cols))).collect()}
    cond = F.lit(True)
    for c in cols:
        lo, hi = rows[c]
        v = F.col(q(c))
        cond = cond & ~F.coalesce((v < F.lit(lo)) | (v > F.lit(hi)), F.lit(False))
    return df.filter(cond)


def class_stats(df: DataFrame, target: str, cols, classes=(0, 1), digits: int = 2,
                exact: bool = True) -> DataFrame:
    """(variable, class, count, mean, median, std, min, max) rounded half-even; every
    class listed for every variable (empty class -> count 0, NULL stats)."""
    aggs = []
    for c in cols:
        v = F.col(q(c)).cast("double")
        extra = [] if exact else [F.percentile_approx(v, 0.5, 10000).alias("median")]
        aggs.append(F.struct(F.lit(c).alias("variable"), F.count(v).alias("count"), F.avg(v).alias("mean"),
                             *extra, F.stddev_samp(v).alias("std"),
                             F.min(v).alias("min"), F.max(v).alias("max")))
    g = (df.groupBy(F.col(q(target)).alias("class")).agg(F.array(*aggs).alias("_a"))
         .select("class", F.inline("_a")))
    if exact:
        med = quantile_columns(df.withColumnRenamed(target, "class") if target != "class" else df,
                               cols, (0.5,), ("median",), by=["class"]).withColumnRenamed("col", "variable")
        g = g.join(med, ["class", "variable"], "left")
    grid = df.sparkSession.createDataFrame([(c, k) for c in cols for k in classes],
                                           f"variable string, class {g.schema['class'].dataType.simpleString()}")
    out = grid.join(g, ["variable", "class"], "left")
    return out.select("variable", "class", F.coalesce("count", F.lit(0)).alias("count"),
                      *[F.bround(x, digits).alias(x) for x in ("mean", "median", "std", "min", "max")])


def variable_screen(stats: DataFrame, lo: float = 0.9, hi: float = 1.1, min_rel_diff: float = 0.1) -> DataFrame:
    """Per variable, from the (rounded) per-class table: relative mean difference,
    class-0/class-1 range ratio, positive share, and keep/exclude flags."""
    def pick(name, k):
        return F.max(F.when(F.col("class") == k, F.col(name)))
    w = stats.groupBy("variable").agg(
        pick("mean", 0).alias("m0"), pick("mean", 1).alias("m1"),
        pick("min", 0).alias("min0"), pick("max", 0).alias("max0"),
        pick("min", 1).alias("min1"), pick("max", 1).alias("max1"),
        pick("count", 0).alias("n0"), pick("count", 1).alias("n1"))
    range0 = F.bround(F.abs(F.col("max0") - F.col("min0")), 2)
    dif_mean = F.bround(F.try_divide(F.abs(F.col("m0") - F.col("m1")), F.col("m0")), 2)
    ratio = F.bround(F.try_divide(F.abs(F.col("max0") - F.col("min0")), F.abs(F.col("max1") - F.col("min1"))), 2)
    out = w.select(
        "variable", (range0 > 0).alias("range0_positive"), dif_mean.alias("dif_mean"), ratio.alias("range_ratio"),
        F.bround(F.try_divide(100.0 * F.col("n1"), (F.col("n0") + F.col("n1")).cast("double")), 2).alias("pct_pos"),
        F.coalesce(~(dif_mean < min_rel_diff), F.lit(True)).alias("consider"),
        (~F.coalesce((ratio > lo) & (ratio < hi) & (range0 > 0), F.lit(False))).alias("range_changes"))
    return out.withColumn("exclude", ~F.col("consider") | ~F.col("range_changes"))


def standardize(df: DataFrame, cols, ddof: int = 0, keys=(), prefix: str = "z_") -> DataFrame:
    """z = (x - mean) / std (population std by default); one aggregate + projection."""
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(q(c)).cast("double")
        aggs += [F.avg(v).alias(f"m{i}"), (F.stddev_pop(v) if ddof == 0 else F.stddev_samp(v)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    out = [F.col(q(k)) for k in keys]
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        v = F.col(q(c)).cast("double")
        out.append((F.lit(0.0) if not s else (v - F.lit(m)) / F.lit(s)).alias(f"{prefix}{c}"))
    return df.select(*out)


def pca(df: DataFrame, cols, k: int, keys=()):
    """PCA on (already standardised) columns with Spark ML; returns (scores, model).
    Spark's PCA centres via the covariance matrix; scores are x . V."""
    va = VectorAssembler(inputCols=list(cols), outputCol="_x", handleInvalid="skip")
    vec = va.transform(df.select(*[F.col(q(c)) for c in list(keys) + list(cols)]))
    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(vec)
    from pyspark.ml.functions import vector_to_array
    scores = model.transform(vec).select(*[F.col(q(x)) for x in keys],
                                         *[vector_to_array("_pc")[i].alias(f"pc{i + 1}") for i in range(k)])
    return scores, model


def explained_variance(df: DataFrame, cols, k: int | None = None) -> DataFrame:
    """(pc, ratio, cum): explained-variance ratio and running total."""
    k = k or len(cols)
    _, model = pca(df, cols, k)
    ev = [float(x) for x in model.explainedVariance.toArray()]
    spark = df.sparkSession
    tab = spark.createDataFrame([(i + 1, v) for i, v in enumerate(ev)], "pc int, ratio double")
    w = Window.orderBy("pc").rowsBetween(Window.unboundedPreceding, 0)  # k rows
    return tab.withColumn("cum", F.sum("ratio").over(w))
