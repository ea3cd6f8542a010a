"""Profiling (EDA) aggregates.

Every per-column statistic is computed for all columns in ONE aggregate job
(partial aggregation on the map side, a single-row final) and returned in long
form ``(col, stat...)`` via ``inline(array(struct(...)))``.  For very wide tables
(columns x statistics beyond what whole-stage codegen fits in one method) use the
``long=True`` path: unpivot then ``groupBy(col)`` - one shuffle of partial states.

Quantiles: ``exact=True`` uses distributed order statistics (``quantiles.py``: no
task ever holds a column's distinct values); ``exact=False`` uses
``percentile_approx`` inside the same single aggregate (bounded sketch, one pass).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import q
from tessera.functions.stats import sample_kurt, sample_skew
from tessera.operators.clean import numeric_columns
from tessera.operators.quantiles import quantile_columns


def _col(c: str) -> Column:
    return F.col(q(c))


def _long(df: DataFrame, structs: list[Column], schema: str) -> DataFrame:
    if not structs:
        return df.sparkSession.createDataFrame([], schema)
    return df.agg(F.array(*structs).alias("_a")).select(F.inline("_a"))


def _quantiles(c: Column, probs, exact: bool, accuracy: int = 10000) -> Column:
    if exact:
        return F.percentile(c, list(probs))
    return F.percentile_approx(c, list(probs), accuracy)


# ---------------------------------------------------------------- E2
def missing_ratio(df: DataFrame, cols=None) -> DataFrame:
    cols = cols if cols is not None else df.columns
    s = [F.struct(F.lit(c).alias("col"), F.avg(_col(c).isNull().cast("double")).alias("missing_ratio"))
         for c in cols]
    return _long(df, s, "col string, missing_ratio double")


# ---------------------------------------------------------------- E3 / E4 / E5
def describe(df: DataFrame, cols=None, exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """count, mean, std (ddof 1), min, 25/50/75 % (linear interpolation), max.

    Moments come from one aggregate; exact quartiles from ``quantiles`` (distributed
    order statistics), joined on the column name (one row per column on each side)."""
    cols = cols if cols is not None else numeric_columns(df)
    s = []
    for c in cols:
        v = _col(c).cast("double")
        qs = [] if exact else [_quantiles(v, (0.25, 0.5, 0.75), False, accuracy)]
        s.append(F.struct(F.lit(c).alias("col"), F.count(v).alias("count"), F.avg(v).alias("mean"),
                          F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
                          *([qs[0][0].alias("p25"), qs[0][1].alias("p50"), qs[0][2].alias("p75")] if qs else []),
                          F.max(v).alias("max")))
    schema = "col string, count bigint, mean double, std double, min double, max double"
    out_cols = ["col", "count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    if not cols:
        return df.sparkSession.createDataFrame([], schema + ", p25 double, p50 double, p75 double").select(*out_cols)
    if not exact:                                   # approximate quartiles inside the one aggregate
        return _long(df, s, schema).select(*out_cols)
    qt = quantile_columns(df, cols, (0.25, 0.5, 0.75), ("p25", "p50", "p75"))
    return _long(df, s, schema).join(qt, "col", "left").select(*out_cols)


def skew_kurtosis(df: DataFrame, cols=None) -> DataFrame:
    cols = cols if cols is not None else numeric_columns(df)
    s = [F.struct(F.lit(c).alias("col"), sample_skew(_col(c).cast("double")).alias("skew"),
                  sample_kurt(_col(c).cast("double")).alias("kurt")) for c in cols]
    return _long(df, s, "col string, skew double, kurt double")


def pct_zeros(df: DataFrame, cols=None) -> DataFrame:
    """Share of rows equal to 0; NULL rows count in the denominator."""
    cols = cols if cols is not None else numeric_columns(df)
    s = [F.struct(F.lit(c).alias("col"),
                  F.avg(F.coalesce((_col(c) == 0).cast("double"), F.lit(0.0))).alias("pct_zeros"))
         for c in cols]
    return _long(df, s, "col string, pct_zeros double")


_PROFILE_SCHEMA = ("col string, dtype string, missing_ratio double, count bigint, mean double, std double, "
                   "min double, p25 double, p50 double, p75 double, max double, skew double, kurt double, "
                   "pct_zeros double")


def _decimal_means(df: DataFrame, cols) -> dict[str, Column]:
    """Mean per column as a sum of decimals over a count.  The decimals keep 17 digits of the
    column's largest magnitude, so sums of up to 10 ** 21 values fit; columns that reach beyond
    10 ** 17, or hold infinities, keep the plain mean."""
    if not cols:
        return {}
    row = df.agg(*[F.max(F.abs(F.nanvl(_col(c).cast("double"), F.lit(None).cast("double")))) for c in cols]).first()
    out = {}
    for c, most in zip(cols, row):
        if most is None or not most < 1e17:
            continue
        digits = 17 - max(0, math.ceil(math.log10(most))) if most > 0 else 17
        v = F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))
        out[c] = F.try_divide(F.sum(v.cast(f"decimal(38,{digits})")).cast("double"), F.count(v).cast("double"))
    return out


def profile_table(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: dtype, missing ratio and (numeric) describe + skew/kurt/zeros.

    exact=False: one lazy aggregate (``percentile_approx`` inside it).
    exact=True: a pass for the columns' magnitudes, one aggregate for the moments with means by
    decimal sums (the same in any order of the rows), and the exact quartiles
    (``quantile_columns``) joined by column name."""
    num = set(numeric_columns(df))
    means = _decimal_means(df, sorted(num)) if exact else {}
    s = []
    for f in df.schema.fields:
        c = f.name
        isn = c in num
        v = _col(c).cast("double") if isn else F.lit(None).cast("double")
        nul3 = F.array(*[F.lit(None).cast("double")] * 3)
        qs = _quantiles(v, (0.25, 0.5, 0.75), False) if (isn and not exact) else nul3
        s.append(F.struct(
            F.lit(c).alias("col"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.avg(_col(c).isNull().cast("double")).alias("missing_ratio"),
            F.count(_col(c)).alias("count"),
            means.get(c, F.avg(v)).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
            qs[0].alias("p25"), qs[1].alias("p50"), qs[2].alias("p75"), F.max(v).alias("max"),
            (sample_skew(v) if isn else F.lit(None).cast("double")).alias("skew"),
            (sample_kurt(v) if isn else F.lit(None).cast("double")).alias("kurt"),
            (F.avg(F.coalesce((v == 0).cast("double"), F.lit(0.0))) if isn
             else F.lit(None).cast("double")).alias("pct_zeros"),
        ))
    ncols = [f.name for f in df.schema.fields if f.name in num]
    if not exact or not ncols:
        return _long(df, s, _PROFILE_SCHEMA)
    qt = quantile_columns(df, ncols, (0.25, 0.5, 0.75), ("q25", "q50", "q75"))
    out = (_long(df, s, _PROFILE_SCHEMA).join(qt, "col", "left")
           .withColumn("p25", F.col("q25")).withColumn("p50", F.col("q50")).withColumn("p75", F.col("q75"))
           .drop("q25", "q50", "q75"))
    return out.select("col", "dtype", "missing_ratio", "count", "mean", "std", "min", "p25", "p50", "p75",
                      "max", "skew", "kurt", "pct_zeros")


# ---------------------------------------------------------------- E12 / E13
def category_freq(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Value counts (NULL excluded), most frequent first; ``top`` keeps the first n
    (a TakeOrderedAndProject: each task keeps n, the driver merges n x tasks)."""
    out = (df.filter(_col(col).isNotNull()).groupBy(_col(col).alias("value"))
           .agg(F.count(F.lit(1)).alias("n")))
    out = out.orderBy(F.desc("n"), F.asc("value"))
    return out.limit(top) if top else out


def class_balance(df: DataFrame, col: str, digits: int = 2) -> DataFrame:
    """(class, n, pct) with pct = 100 * n / all non-NULL rows, rounded."""
    counts = df.filter(_col(col).isNotNull()).groupBy(_col(col).alias("class")).agg(
        F.count(F.lit(1)).alias("n"))
    total = df.filter(_col(col).isNotNull()).count()  # scalar action
    return counts.withColumn("pct", F.round(F.col("n") * F.lit(100.0) / F.lit(max(total, 1)), digits))


# ---------------------------------------------------------------- E14 / E18 / D5
def value_range(df: DataFrame, col: str):
    r = df.agg(F.min(_col(col).cast("double")), F.max(_col(col).cast("double"))).first()
    return r[0], r[1]


def bin_expr(v: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin id in [0, bins-1]; the last bin is closed; zero width -> bin 0."""
    width = (hi - lo) / bins if hi is not None and lo is not None else 0.0
    if not width:
        return F.when(v.isNotNull(), F.lit(0))
    b = F.floor((v - F.lit(lo)) / F.lit(width)).cast("int")
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), b))


def histogram(df: DataFrame, col: str, bins: int = 30, by: str | None = None,
              lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Counts per equal-width bin, every bin listed (zeros included).

    ``by`` groups the counts by a slice column (shared edges across slices, so
    the slices are comparable).  Edges come from one min/max aggregate unless given."""
    if lo is None or hi is None:
        lo, hi = value_range(df, col)
    spark = df.sparkSession
    v = _col(col).cast("double")
    keys = [F.col(q(by))] if by else []
    counts = (df.filter(v.isNotNull()).select(*keys, bin_expr(v, lo, hi, bins).alias("bin"))
              .groupBy(*([by] if by else []), "bin").agg(F.count(F.lit(1)).alias("n")))
    width = ((hi - lo) / bins) if lo is not None else 0.0
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if by:
        slices = df.select(F.col(q(by))).distinct()
        grid = _expand(slices, bins)
    lo_ = lo if lo is not None else 0.0
    out = (grid.join(counts, [*([by] if by else []), "bin"], "left")
           .select(*([by] if by else []), "bin",
                   (F.lit(lo_) + F.col("bin") * F.lit(width)).alias("lo"),
                   (F.lit(lo_) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
                   F.coalesce("n", F.lit(0)).cast("long").alias("n")))
    return out


def _expand(slices: DataFrame, bins: int) -> DataFrame:
    """Every (slice, bin) pair: slices x a generated bin array (no join)."""
    return slices.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))


def pair_bins(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Scatter of (x, y) as counts on a bins x bins grid (non-empty cells)."""
    r = df.agg(F.min(_col(x).cast("double")), F.max(_col(x).cast("double")),
               F.min(_col(y).cast("double")), F.max(_col(y).cast("double"))).first()
    vx, vy = _col(x).cast("double"), _col(y).cast("double")
    return (df.filter(vx.isNotNull() & vy.isNotNull())
            .select(bin_expr(vx, r[0], r[1], bins).alias("xbin"), bin_expr(vy, r[2], r[3], bins).alias("ybin"))
            .groupBy("xbin", "ybin").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- E15 / E16
def class_values(df: DataFrame, target: str, max_classes: int = 1000) -> list:
    """Distinct target classes ordered by frequency (bounded: raises above max_classes)."""
    rows = (df.filter(_col(target).isNotNull()).groupBy(_col(target).alias("t"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "t").limit(max_classes + 1).collect())
    if len(rows) > max_classes:
        raise ValueError(f"{target} has more than {max_classes} classes")
    return [r["t"] for r in rows]


def crosstab_row_norm(df: DataFrame, cat: str, target: str, classes=None, prefix: str = "share_") -> DataFrame:
    """Per category, share of each target class (missing combination -> 0)."""
    classes = classes if classes is not None else class_values(df, target)
    counts = (df.filter(_col(cat).isNotNull() & _col(target).isNotNull())
              .groupBy(_col(cat).alias(cat)).pivot(target, classes).agg(F.count(F.lit(1))).fillna(0))
    tot = sum((F.col(q(str(k))) for k in classes), F.lit(0))
    return counts.select(F.col(q(cat)), *[(F.col(q(str(k))) / tot).alias(f"{prefix}{k}") for k in classes])


def target_concentration(df: DataFrame, cats, target: str, top: int | None = 5) -> DataFrame:
    """Per categorical column: mean over its categories of the largest target share.

    All columns at once in long form: unpivot (col, value, target) -> counts (map-side
    combined) -> share per (col, value) -> max -> mean per col."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), _col(c).cast("string").alias("value"))
                                            for c in cats])).alias("s"), _col(target).alias("t"))
    counts = (stacked.filter(F.col("s.value").isNotNull() & F.col("t").isNotNull())
              .groupBy(F.col("s.col").alias("col"), F.col("s.value").alias("value"), "t")
              .agg(F.count(F.lit(1)).alias("n")))
    per_val = counts.groupBy("col", "value").agg((F.max("n") / F.sum("n")).alias("max_share"))
    out = per_val.groupBy("col").agg(F.avg("max_share").alias("score"))
    if top:
        out = out.orderBy(F.desc("score"), "col").limit(top)
    return out


# ---------------------------------------------------------------- E17 / E19
def profile_flags(df: DataFrame, missing_flag=0.30, skew_flag=1.0, zero_flag=0.80, exact=True) -> DataFrame:
    p = profile_table(df, exact=exact)
    return p.select("col", "missing_ratio", "skew", "pct_zeros",
                    (F.col("missing_ratio") >= missing_flag).alias("flag_missing"),
                    F.coalesce(F.abs("skew") > skew_flag, F.lit(False)).alias("flag_skew"),
                    F.coalesce(F.col("pct_zeros") >= zero_flag, F.lit(False)).alias("flag_zeros"))


#: finding -> advice
ADVICE = {"missing": "Impute or drop", "skew": "Transform or use a model that ranks", "zeros": "Check whether zero means missing",
          "vif": "Drop or combine collinear columns"}


def findings(flags: DataFrame, vifs: DataFrame, vif_flag: float = 10.0) -> DataFrame:
    """(finding, n, columns, advice): the flagged columns of ``profile_flags`` and of a VIF table by name,
    one row per kind of finding, those without a column too."""
    marks = flags.select("col", F.explode(F.array(*[F.struct(F.lit(k).alias("finding"), F.col(f"flag_{k}").alias("on"))
                                                    for k in ("missing", "skew", "zeros")])).alias("x")).filter("x.on").select("x.finding", "col")
    marks = marks.unionByName(vifs.filter(F.col("vif") > vif_flag).select(F.lit("vif").alias("finding"), F.col("variable").alias("col")))
    kinds = flags.sparkSession.createDataFrame(list(ADVICE.items()), "finding string, advice string")
    found = marks.groupBy("finding").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("col")).alias("columns"))   # column names
    return kinds.join(found, "finding", "left").select("finding", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                                                       F.coalesce("columns", F.array().cast("array<string>")).alias("columns"), "advice")


def profile_compare(raw: DataFrame, clean: DataFrame, name_map: dict | None = None) -> DataFrame:
    """Missing ratio before and after cleaning, matched by cleaned name.

    Raw cells count as missing when NULL or blank; a column dropped by cleaning keeps
    its raw figure with a NULL clean figure (full outer join of two small tables)."""
    from tessera.functions.names import normalized_names
    names = name_map or dict(zip(raw.columns, normalized_names(raw.columns)))
    r = _long(raw, [F.struct(F.lit(names[c]).alias("col"),
                             F.avg((_col(c).isNull() | (F.trim(_col(c).cast("string")) == "")).cast("double"))
                             .alias("raw_missing")) for c in raw.columns], "col string, raw_missing double")
    c = missing_ratio(clean).withColumnRenamed("missing_ratio", "clean_missing")
    return r.join(c, "col", "full")


__all__ = ["missing_ratio", "describe", "skew_kurtosis", "pct_zeros", "profile_table", "category_freq",
           "class_balance", "histogram", "pair_bins", "crosstab_row_norm", "target_concentration",
           "profile_flags", "profile_compare", "value_range", "bin_expr", "infer_roles", "profile_report"]


def infer_roles(df: DataFrame, target: str | None = None, id_cols=(), datetime_cols=(), cat_cols=(),
                drop_suffixes=("_label",)) -> dict:
    """Column roles from the schema (metadata only): columns with a dropped suffix
    are ignored; categorical = user list + string/boolean columns; numeric = the rest of
    the numeric columns (the target stays in the numeric list, as in the reference)."""
    cols = [c for c in df.columns if not any(c.endswith(s) for s in drop_suffixes)]
    fixed = set(id_cols) | set(datetime_cols)
    dtypes = dict(df.dtypes)
    cats = [c for c in cols if c not in fixed and (c in cat_cols or dtypes[c] in ("string", "boolean"))]
    nums = [c for c in cols if c not in fixed and c not in cats and c in set(numeric_columns(df))]
    return {"id": [c for c in cols if c in id_cols], "datetime": [c for c in cols if c in datetime_cols],
            "categorical": cats, "numeric": nums, "target": target}


def profile_report(df: DataFrame, target: str | None = None, id_cols=(), datetime_cols=(), cat_cols=(),
                   drop_suffixes=("_label",), exact: bool = True) -> dict:
    """E19 facade: the profiling tables of one frame as lazy DataFrames (no rendering).
    Keys: roles, table (per-column profile), flags, spearman, strong_pairs, vif,
    target_spearman / target_concentration (numeric / categorical target)."""
    from tessera.operators import correlation as R
    roles = infer_roles(df, target, id_cols, datetime_cols, cat_cols, drop_suffixes)
    keep = [c for c in df.columns if not any(c.endswith(s) for s in drop_suffixes)]
    frame = df.select(*[_col(c) for c in keep])
    feats = [c for c in roles["numeric"] if c != target]
    out = {"roles": roles, "table": profile_table(frame, exact), "flags": profile_flags(frame, exact=exact)}
    if len(feats) >= 2:
        pairs = R.spearman_pairs(frame, feats)
        out["spearman"] = pairs
        out["strong_pairs"] = R.strong_pairs(pairs)
        out["vif"] = R.vif(frame, feats)
    if target and target in roles["numeric"] and feats:
        out["target_spearman"] = R.spearman_target(frame, feats, target)
    elif target and roles["categorical"]:
        cats = [c for c in roles["categorical"] if c != target]
        if cats:
            out["target_concentration"] = target_concentration(frame, cats, target)
    return out
