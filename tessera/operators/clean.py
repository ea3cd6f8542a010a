"""Table cleaning: names, trimming, missing tokens, numeric promotion, z-score masking,
sparse-column drop, interval rules, row/column filters, feature preparation.

``Cleaner.fit`` runs exactly two fused aggregate jobs over the table (promotion
profile together with mean/std of every candidate's parsed values; NULL ratio
after masking - masking needs the statistics, so these two cannot merge) and returns a
``CleanerModel`` whose ``transform`` is a single lazy projection - so the same
rules replay on new data (a later batch or a stream) without re-profiling.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.names import normalized_names, q
from tessera.functions.values import binarize, missing_tokens, null_if_token, strict_double, to_double, trim_ws
from tessera.operators.stored import Stored
from tessera.session import cut_lineage, discard

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


def is_numeric_type(dt: T.DataType, include_bool: bool = False) -> bool:
    return isinstance(dt, _NUMERIC) or (include_bool and isinstance(dt, T.BooleanType))


def numeric_columns(df: DataFrame, include_bool: bool = False) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType, include_bool)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


@dataclass
class CleanConfig:
    drop_na_thresh: float = 0.95
    outlier_z: float | None = 4.0
    numeric_like_ratio: float = 0.8
    extra_missing_tokens: tuple = ()
    coerce_float: bool = True
    protect: tuple = ()          # columns never z-masked (target, ids)

    def __post_init__(self):
        if not 0 <= self.drop_na_thresh <= 1:
            raise ValueError("drop_na_thresh must be in [0, 1]")
        if self.outlier_z is not None and self.outlier_z <= 0:
            raise ValueError("outlier_z must be positive")
        if not 0 <= self.numeric_like_ratio <= 1:
            raise ValueError("numeric_like_ratio must be in [0, 1]")

    @property
    def tokens(self) -> list[str]:
        return missing_tokens(self.extra_missing_tokens)


# ------------------------------------------------------------------ single steps
def rename_columns(df: DataFrame) -> DataFrame:
    """C1+C2: slug names, made unique (metadata only)."""
    return df.toDF(*normalized_names(df.columns))


def tokens_to_null(df: DataFrame, tokens=None, cols=None) -> DataFrame:
    """C3+C4: trim string columns, missing tokens and '' -> NULL.

    Two projections on purpose: the token test references the trimmed value three
    times, so it must read a column, not repeat the regex (Catalyst keeps the two
    projections apart instead of duplicating a non-trivial expression)."""
    toks = tokens if tokens is not None else missing_tokens()
    cols = set(cols if cols is not None else string_columns(df))
    trimmed = df.select(*[trim_ws(F.col(q(c))).alias(c) if c in cols else F.col(q(c)) for c in df.columns])
    return trimmed.select(*[null_if_token(F.col(q(c)), toks).alias(c) if c in cols
                            else F.col(q(c)) for c in df.columns])


def promotion_profile(df: DataFrame, cols=None) -> DataFrame:
    """C6 fit statistics as a long table (col, non_missing, parsed) - one aggregate."""
    cols = cols if cols is not None else string_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "col string, non_missing bigint, parsed bigint")
    aggs = []
    for c in cols:
        aggs.append(F.struct(F.lit(c).alias("col"),
                             F.count(F.col(q(c))).alias("non_missing"),
                             F.count(strict_double(F.col(q(c)), trimmed=True)).alias("parsed")))
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def zscore_stats(df: DataFrame, cols) -> dict:
    """mean and sample std per column, one aggregate job; returns {col: (mean, std)}."""
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(q(c)).cast("double")
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def zscore_mask(df: DataFrame, cols, thr: float, stats: dict | None = None) -> tuple[DataFrame, dict]:
    """|z| > thr -> NULL per column (sample std); columns with std 0/NULL untouched."""
    stats = stats if stats is not None else zscore_stats(df, cols)
    usable = {c: s for c, s in stats.items() if s[1] is not None and s[1] > 0}
    out = []
    for f in df.schema.fields:
        c = f.name
        if c in usable:
            m, s = usable[c]
            z = F.abs((F.col(q(c)).cast("double") - F.lit(m)) / F.lit(s))
            out.append(F.when(z > F.lit(float(thr)), F.lit(None).cast(f.dataType))
                       .otherwise(F.col(q(c))).alias(c))
        else:
            out.append(F.col(q(c)))
    return df.select(*out), usable


def null_ratios(df: DataFrame, cols=None) -> dict:
    cols = cols if cols is not None else df.columns
    if not cols:
        return {}
    row = df.agg(*[F.avg(F.col(q(c)).isNull().cast("double")).alias(f"r{i}")
                   for i, c in enumerate(cols)]).first()
    return {c: (row[f"r{i}"] if row[f"r{i}"] is not None else 0.0) for i, c in enumerate(cols)}


# ------------------------------------------------------------------ estimator
@dataclass
class CleanerModel:
    config: CleanConfig
    renamed: list
    string_cols: list
    promoted: list
    numeric_cols: list
    z_stats: dict
    masked_cols: list
    dropped_cols: list
    report: dict = field(default_factory=dict)
    tokens: DataFrame | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """Replay the fitted rules as staged projections (no action): trim -> tokens ->
        parse -> mask; each stage reads the previous one's columns."""
        if len(df.columns) != len(self.renamed):
            raise ValueError("input width differs from the fitted table")
        df = df.toDF(*self.renamed)
        kept = [c for c in self.renamed if c not in self.dropped_cols]
        work = tokens_to_null(df.select(*[F.col(q(c)) for c in kept]), self.config.tokens,
                              [c for c in self.string_cols if c in kept])
        return self.transform_tokens(work)

    def transform_tokens(self, work: DataFrame) -> DataFrame:
        """Parse -> mask -> drop on a frame that is already renamed and tokenised."""
        thr = self.config.outlier_z
        kept = [c for c in self.renamed if c not in self.dropped_cols]
        work = work.select(*[F.col(q(c)) for c in kept])
        dtypes = dict((f.name, f.dataType) for f in work.schema.fields)
        parsed = []
        for c in kept:
            e = F.col(q(c))
            if c in self.promoted:
                e = strict_double(e, trimmed=True)
            elif isinstance(dtypes[c], (T.DoubleType, T.FloatType)):
                e = F.nanvl(e, F.lit(None).cast(dtypes[c]))
            parsed.append(e.alias(c))
        work = work.select(*parsed)
        if thr is None:
            return work
        out = []
        for c in kept:
            e = F.col(q(c))
            if c in self.z_stats:
                m, s = self.z_stats[c]
                z = F.abs((e.cast("double") - F.lit(m)) / F.lit(s))
                e = F.when(z > F.lit(float(thr)), F.lit(None)).otherwise(e)
            out.append(e.alias(c))
        return work.select(*out)


class Cleaner:
    """Rename -> trim -> tokens -> promote -> z-mask -> sparse drop."""

    def __init__(self, config: CleanConfig | None = None):
        self.config = config or CleanConfig()

    def fit(self, df: DataFrame, keep_tokens: bool = False) -> CleanerModel:
        """Two aggregate passes over the tokenised table, which is written once to the shared
        folder and removed after them.  ``keep_tokens`` leaves it on the model (``model.tokens``) for ``fit_transform``."""
        cfg = self.config
        renamed = normalized_names(df.columns)
        work = df.toDF(*renamed)
        str_cols = string_columns(work)
        # both passes, and the clean table of fit_transform, read the tokens back column by
        # column instead of deriving every string again
        work = cut_lineage(tokens_to_null(work, cfg.tokens, str_cols), "tokens")
        tokens = work

        fields = dict((f.name, f.dataType) for f in work.schema.fields)
        numeric = [c for c in renamed if c not in str_cols and is_numeric_type(fields[c], include_bool=True)]
        zable = [c for c in renamed if c not in cfg.protect and c not in str_cols
                 and is_numeric_type(fields[c]) and not isinstance(fields[c], T.BooleanType)]
        cand = [c for c in str_cols if c not in cfg.protect] if cfg.coerce_float else []
        # pass 1: promotion profile AND mean/std of every candidate's parsed values
        aggs = []
        staged = work.select("*", *[strict_double(F.col(q(c)), trimmed=True).alias(f"__num{i}")
                                    for i, c in enumerate(renamed) if c in str_cols and cfg.coerce_float])
        for i, c in enumerate(renamed):
            if c in str_cols and cfg.coerce_float:
                v = F.col(f"__num{i}")
                aggs += [F.count(F.col(q(c))).alias(f"nm{i}"), F.count(v).alias(f"np{i}")]
            elif c in zable:
                v = F.col(q(c)).cast("double")
            else:
                continue
            if c in zable or c in cand:
                aggs += [F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}")]
        row = staged.agg(*aggs).first() if aggs else None
        promoted: list[str] = []
        if cfg.coerce_float:
            for i, c in enumerate(renamed):
                if c in str_cols:
                    nm, parsed = row[f"nm{i}"], row[f"np{i}"]
                    if nm and parsed / nm >= cfg.numeric_like_ratio:
                        promoted.append(c)
        work = work.select(*[strict_double(F.col(q(c)), trimmed=True).alias(c) if c in promoted else F.col(q(c))
                             for c in work.columns])
        numeric_all = [c for c in renamed if c in numeric or c in promoted]

        z_stats, masked = {}, []
        if cfg.outlier_z is not None and row is not None:
            for i, c in enumerate(renamed):
                if c in zable or (c in promoted and c in cand):
                    m, s_ = row[f"m{i}"], row[f"s{i}"]
                    if s_ is not None and s_ > 0:
                        z_stats[c] = (m, s_)

        # one job: NULL ratio after masking + whether a mask fired per column
        masked_expr, ratio_expr = [], []
        for i, c in enumerate(renamed):
            v = F.col(q(c))
            is_out = F.lit(False)
            if c in z_stats:
                m, s = z_stats[c]
                is_out = F.coalesce(F.abs((v.cast("double") - F.lit(m)) / F.lit(s)) > F.lit(float(cfg.outlier_z)),
                                    F.lit(False))
                masked_expr.append(F.max(is_out.cast("int")).alias(f"k{i}"))
            ratio_expr.append(F.avg((v.isNull() | is_out).cast("double")).alias(f"r{i}"))
        row = work.agg(*(ratio_expr + masked_expr)).first()
        masked = [c for i, c in enumerate(renamed) if c in z_stats and row[f"k{i}"] == 1]
        ratios = {c: (row[f"r{i}"] or 0.0) for i, c in enumerate(renamed)}
        dropped = ([] if cfg.drop_na_thresh >= 1 else
                   [c for c in renamed if ratios[c] > cfg.drop_na_thresh])
        report = {"renamed_columns": renamed, "outlier_masked_cols": masked,
                  "dropped_columns": dropped, "null_ratios": ratios}
        if cfg.coerce_float:
            report["numeric_columns"] = numeric_all
        model = CleanerModel(cfg, renamed, str_cols, promoted, numeric_all, z_stats, masked, dropped, report)
        if keep_tokens:
            model.tokens = tokens
        else:
            discard(tokens)
        return model

    def fit_transform(self, df: DataFrame, name: str = "clean") -> tuple[DataFrame, CleanerModel]:
        """Fit, apply the rules to the fit's tokenised table (no second derivation from the raw
        input), write the clean table to the shared folder and read it back."""
        model = self.fit(df, keep_tokens=True)
        out = cut_lineage(model.transform_tokens(model.tokens), name)
        discard(model.tokens)
        model.tokens = None
        return out, model


def clean(df: DataFrame, config: CleanConfig | None = None) -> tuple[DataFrame, dict]:
    model = Cleaner(config).fit(df)
    return model.transform(df), model.report


# ------------------------------------------------------------------ rules / filters
def interval_filter(df: DataFrame, rules: dict) -> DataFrame:
    """C11: keep rows with lo <= c <= hi for every rule (NULL fails); Catalyst fuses
    the rules into one pushed-down filter."""
    cond = None
    for c, (lo, hi) in rules.items():
        # a NULL comparison drops the row in a filter, so plain comparisons keep the
        # predicate pushable to the parquet scan
        term = (F.col(q(c)) >= F.lit(lo)) & (F.col(q(c)) <= F.lit(hi))
        cond = term if cond is None else cond & term
    return df.filter(cond) if cond is not None else df


def first_failed_rule(rules: dict) -> Column:
    """Name of the first rule (in dict order) a row fails, NULL when it passes all."""
    e = F.lit(None).cast("string")
    for c, (lo, hi) in reversed(list(rules.items())):
        ok = F.coalesce(F.col(q(c)).between(lo, hi), F.lit(False))
        e = F.when(~ok, F.lit(c)).otherwise(e)
    return e


def interval_rejects(df: DataFrame, rules: dict) -> DataFrame:
    """Rows removed per rule when rules are applied in order - one pass, one small shuffle."""
    spark = df.sparkSession
    names = spark.createDataFrame([(i, c) for i, c in enumerate(rules)], "rule_no int, rule string")
    counts = (df.select(first_failed_rule(rules).alias("rule"))
              .filter(F.col("rule").isNotNull()).groupBy("rule").agg(F.count(F.lit(1)).alias("n_removed")))
    return (names.join(counts, "rule", "left")
            .select("rule_no", "rule", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed")))


def dropna_any(df: DataFrame, cols=None) -> DataFrame:
    """Blank strings count as missing; drop rows with any NULL.

    The cells leave as the one row of a generator: a filter on a plain projection is pushed below it
    and below those that made ``df``, and then derives every cell again for each time it is named."""
    cols = cols if cols is not None else df.columns
    strs = set(string_columns(df))
    cells = [F.when(trim_ws(F.col(q(c))) == "", F.lit(None)).otherwise(F.col(q(c))).alias(c)
             if c in strs else F.col(q(c)).alias(c) for c in df.columns]
    return df.select(F.inline(F.array(F.struct(*cells)))).dropna(how="any", subset=list(cols))


def cast_types(df: DataFrame, categorical) -> DataFrame:
    """The listed columns as strings, all others as doubles (strict parse, unparsable -> NULL)."""
    unknown = set(categorical) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    out = []
    for f in df.schema.fields:
        c = F.col(q(f.name))
        out.append((c.cast("string") if f.name in categorical else to_double(c, f.dataType.simpleString())).alias(f.name))
    return df.select(*out)


def dtype_report(df: DataFrame, categorical=(), spread: int = 64) -> DataFrame:
    """C14: (col, dtype, nulls, uniques, is_categorical).

    Rows become (column, value) pairs that are counted with partial sums, so a value held by a
    third of all rows is one row per task; the distinct values of a column are then counted in
    ``spread`` parts by their hash, and the parts added up."""
    schema = "col string, dtype string, nulls bigint, uniques bigint, is_categorical boolean"
    if not df.columns:
        return df.sparkSession.createDataFrame([], schema)
    cells = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(q(f.name))
        plain = c + F.lit(0.0).cast(f.dataType) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c     # one zero
        cells.append(F.struct(F.lit(i).alias("i"), plain.cast("string").alias("v")))
    values = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    parts = values.groupBy("i", F.pmod(F.xxhash64("v"), F.lit(spread)).alias("part")) \
        .agg(F.count("v").alias("uniques"), F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("nulls"))
    total = parts.groupBy("i").agg(F.sum("uniques").alias("uniques"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"))
    names = df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString(), f.name in categorical or isinstance(f.dataType, T.StringType))
                                             for i, f in enumerate(df.schema.fields)], "i int, col string, dtype string, is_categorical boolean")
    return names.join(total, "i", "left").select("col", "dtype", F.coalesce("nulls", F.lit(0)).cast("long").alias("nulls"),
                                                 F.coalesce("uniques", F.lit(0)).cast("long").alias("uniques"), "is_categorical")


def binarize_target(df: DataFrame, target: str, threshold: float = 0.0, out: str | None = None) -> DataFrame:
    """C17: label = 1 when numeric(target) > threshold (NULL/unparsable -> 0)."""
    dt = df.schema[target].dataType.simpleString()
    return df.withColumn(out or target, binarize(F.col(q(target)), threshold, dt))


def prepare_features(df: DataFrame, target: str, drop_suffixes=("_label",), drop=(),
                     fill_value: float = 0.0, positive_threshold: float = 0.0,
                     keep=()) -> tuple[DataFrame, list, list]:
    """features = all columns but target/suffix/drop list, coerced to double,
    NULL -> fill; label binarised.  Returns (frame, feature_names, dropped)."""
    dropped = [c for c in df.columns if c != target and
               (any(c.endswith(s) for s in drop_suffixes) or c in drop)]
    feats = [c for c in df.columns if c != target and c not in dropped and c not in keep]
    dtypes = dict((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    cols = [F.col(q(k)) for k in keep]
    cols += [F.coalesce(to_double(F.col(q(c)), dtypes[c]), F.lit(float(fill_value))).alias(c) for c in feats]
    cols.append(binarize(F.col(q(target)), positive_threshold, dtypes[target]).alias("label"))
    return df.select(*cols), feats, dropped


def align_features(df: DataFrame, feature_names, fill_value: float | None = 0.0, keep=()) -> DataFrame:
    """Reorder to ``feature_names``; absent -> fill (or NULL); extras dropped."""
    present = set(df.columns)
    dtypes = dict((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    cols = [F.col(q(k)) for k in keep]
    for c in feature_names:
        if c in present:
            e = to_double(F.col(q(c)), dtypes[c])
            if fill_value is not None:
                e = F.coalesce(e, F.lit(float(fill_value)))
        else:
            e = F.lit(fill_value).cast("double")
        cols.append(e.alias(c))
    return df.select(*cols)


def normalize_binary_target(df: DataFrame, target: str) -> DataFrame:
    """Cast the target to bigint when all its non-NULL values are 0 or 1 (one
    aggregate decides); otherwise leave it unchanged."""
    v = F.col(q(target))
    bad = df.agg(F.max(F.when(v.isNotNull() & ~v.cast("double").isin(0.0, 1.0), 1).otherwise(0))).first()[0]
    return df.withColumn(target, v.cast("double").cast("bigint")) if not bad else df


# ------------------------------------------------------------------ pyspark.ml wrappers
class CleanerEstimator(Estimator):
    """``Cleaner`` as a pyspark.ml Estimator, so it can be the first stage of a Pipeline."""

    def __init__(self, config: CleanConfig | None = None):
        super().__init__()
        self.config = config or CleanConfig()

    def _fit(self, dataset: DataFrame) -> CleanerTransformer:
        return CleanerTransformer(Cleaner(self.config).fit(dataset))


class CleanerTransformer(Stored, Model):
    """The fitted rules as a stage that can be saved; a loaded one cleans equally."""

    def __init__(self, fitted: CleanerModel | dict):
        super().__init__()
        if isinstance(fitted, dict):
            config = dict(fitted["config"])
            config = CleanConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in config.items()})
            fitted = CleanerModel(**{**fitted, "config": config})
        self.fitted = fitted

    @property
    def report(self) -> dict:
        return self.fitted.report

    def state(self) -> dict:
        return {"fitted": asdict(replace(self.fitted, tokens=None))}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset)
