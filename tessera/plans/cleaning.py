"""Cleaning queries (C1-C19, S3, S4, S8) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.names import slugify_col
from tessera.functions.values import INVALID_PATTERN, NUMERIC_PATTERN, null_if_invalid, strict_double
from tessera.operators import clean as C
from tessera.plans.common import (LI_KEY, register, r6, sql_q, sql_strict_double, sql_token_null)
from tessera.plans.standins import DIRTY_HEADERS, DIRTY_SLUGS, dirty_cte, dirty_lineitem
from tessera.sources.tables import load_table

KEY_SLUGS = ["order_key", "part_key", "supp_key", "line_no"]
# expected output schema of the cleaned dirty table (a fixed property of the stand-in)
PROMOTED = ["order_key", "part_key", "supp_key", "line_no", "quantity", "price_usd", "discount",
            "tax_rate", "big_value", "mostly_missing"]
DROPPED = ["mostly_missing"]
Z_THR = 4.0
CLEAN_CFG = dict(drop_na_thresh=0.95, outlier_z=Z_THR, numeric_like_ratio=0.8, protect=tuple(KEY_SLUGS))


def _dirty_tokens(spark, sf_dir):
    return C.tokens_to_null(C.rename_columns(dirty_lineitem(spark, sf_dir)))


def _keys_from_dirty():
    return [F.col(s).cast("bigint").alias(s) for s in KEY_SLUGS]


def _sql_keys():
    return ", ".join(f"cast({sql_q(h)} AS BIGINT) AS {s}" for h, s in zip(DIRTY_HEADERS[:4], KEY_SLUGS))


def cleaned_dirty(spark, sf_dir, materialize: bool = False):
    """Fit the cleaner on the dirty stand-in (2 aggregate passes) and apply it (a
    projection).  ``materialize`` writes the clean table to the shared folder and reads
    it back - for consumers that scan it several times (profiling), as a pipeline saves
    its interim clean table before profiling it."""
    raw = dirty_lineitem(spark, sf_dir)
    if materialize:
        return C.Cleaner(C.CleanConfig(**CLEAN_CFG)).fit_transform(raw)
    model = C.Cleaner(C.CleanConfig(**CLEAN_CFG)).fit(raw)
    return model.transform(raw), model


# ---------------------------------------------------------------- C3/C4
@register("clean_missing_tokens", f"""{dirty_cte()}
SELECT {_sql_keys()}, {sql_token_null(sql_q(' Quantity '))} AS val FROM dirty""")
def clean_missing_tokens(spark, sf_dir):
    d = _dirty_tokens(spark, sf_dir)
    return d.select(*_keys_from_dirty(), F.col("quantity").alias("val"))


# ---------------------------------------------------------------- C5
def _sql_invalid(expr):
    return (f"(CASE WHEN regexp_matches(trim({expr}), '{INVALID_PATTERN}', 'i') THEN NULL "
            f"ELSE trim({expr}) END)")


@register("clean_invalid_pattern", f"""{dirty_cte()}
SELECT {_sql_keys()}, {_sql_invalid(sql_q(' Quantity '))} AS quantity,
       {_sql_invalid(sql_q('Return Flag'))} AS return_flag FROM dirty""")
def clean_invalid_pattern(spark, sf_dir):
    d = C.rename_columns(dirty_lineitem(spark, sf_dir))
    return d.select(*_keys_from_dirty(), null_if_invalid("quantity").alias("quantity"),
                    null_if_invalid("return_flag").alias("return_flag"))


# ---------------------------------------------------------------- C1
_SLUG_SQL = """WITH v AS (SELECT p_name AS raw FROM part UNION SELECT p_brand FROM part UNION SELECT p_type FROM part),
a AS (SELECT raw, regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '[^\\w]+', '_', 'g'),
        '_+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM v),
b AS (SELECT raw, CASE WHEN s = '' THEN 'col' ELSE s END AS s FROM a)
SELECT raw, CASE WHEN regexp_matches(s, '^[0-9]') THEN 'col_' || s ELSE s END AS slug FROM b"""


@register("slugify_values", _SLUG_SQL)
def slugify_values(spark, sf_dir):
    p = load_table(spark, sf_dir, "part")
    raw = (p.select(F.col("p_name").alias("raw"))
           .union(p.select("p_brand")).union(p.select("p_type")).distinct())
    return raw.select("raw", slugify_col("raw").alias("slug"))


# ---------------------------------------------------------------- C6
def _sql_promotion_profile():
    parts = []
    for h, s in zip(DIRTY_HEADERS, DIRTY_SLUGS):
        tok = sql_token_null(sql_q(h))
        parts.append(f"SELECT '{s}' AS col, count({tok}) AS non_missing, "
                     f"count({sql_strict_double(tok)}) AS parsed FROM dirty")
    body = "\nUNION ALL ".join(parts)
    return f"""{dirty_cte()}, p AS ({body})
SELECT col, non_missing, parsed,
       round(CASE WHEN non_missing > 0 THEN parsed / non_missing END, 6) AS ratio,
       (non_missing > 0 AND parsed / non_missing >= 0.8) AS promote
FROM p"""


@register("coerce_numeric_profile", _sql_promotion_profile())
def coerce_numeric_profile(spark, sf_dir):
    prof = C.promotion_profile(_dirty_tokens(spark, sf_dir))
    ratio = F.try_divide(F.col("parsed").cast("double"), F.col("non_missing").cast("double"))
    return prof.select("col", "non_missing", "parsed", r6(ratio).alias("ratio"),
                       ((F.col("non_missing") > 0) & (ratio >= 0.8)).alias("promote"))


@register("coerce_numeric", f"""{dirty_cte()}
SELECT {_sql_keys()}, {sql_strict_double(sql_token_null(sql_q('Price (USD)')))} AS price_num,
       {sql_strict_double(sql_token_null(sql_q('Discount')))} AS discount_num FROM dirty""")
def coerce_numeric(spark, sf_dir):
    d = _dirty_tokens(spark, sf_dir)
    return d.select(*_keys_from_dirty(), strict_double("price_usd").alias("price_num"),
                    strict_double("discount").alias("discount_num"))


# ---------------------------------------------------------------- C7
@register("zscore_mask", """WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)
SELECT event_id, CASE WHEN s.sd > 0 AND abs((value - s.m) / s.sd) > 4.0 THEN NULL ELSE value END AS value_clean
FROM events, s""")
def zscore_mask(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events").select("event_id", "value")
    masked, _ = C.zscore_mask(ev, ["value"], Z_THR)
    return masked.select("event_id", F.col("value").alias("value_clean"))


@register("zscore_counts", """WITH s AS (SELECT avg(value) AS mv, stddev_samp(value) AS sv,
  avg(user_id) AS mu, stddev_samp(user_id) AS su FROM events)
SELECT 'value' AS col, count(*) FILTER (WHERE s.sv > 0 AND abs((value - s.mv) / s.sv) > 4.0) AS n_masked FROM events, s GROUP BY ALL
UNION ALL
SELECT 'user_id', count(*) FILTER (WHERE s.su > 0 AND abs((user_id - s.mu) / s.su) > 4.0) FROM events, s GROUP BY ALL""")
def zscore_counts(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events")
    cols = ["value", "user_id"]
    stats = C.zscore_stats(ev, cols)
    aggs = []
    for c in cols:
        m, s = stats[c]
        hit = (F.lit(s is not None and s > 0) &
               (F.abs((F.col(c).cast("double") - F.lit(m)) / F.lit(s or 1.0)) > Z_THR))
        aggs.append(F.struct(F.lit(c).alias("col"), F.count_if(hit).cast("long").alias("n_masked")))
    return ev.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


# ---------------------------------------------------------------- C8 / C9
def _sql_clean_ctes():
    """DuckDB re-statement of the cleaning steps on the dirty stand-in."""
    tok = ",\n  ".join(f"{sql_token_null(sql_q(h))} AS {s}" for h, s in zip(DIRTY_HEADERS, DIRTY_SLUGS))
    num = ",\n  ".join((f"{sql_strict_double(s)} AS {s}" if s in PROMOTED else s) for s in DIRTY_SLUGS)
    zc = [s for s in PROMOTED if s not in KEY_SLUGS]
    st = ", ".join(f"avg({s}) AS m_{s}, stddev_samp({s}) AS s_{s}" for s in zc)
    msk = ",\n  ".join((f"CASE WHEN st.s_{s} > 0 AND abs(({s} - st.m_{s}) / st.s_{s}) > {Z_THR} THEN NULL "
                        f"ELSE {s} END AS {s}") if s in zc else s for s in DIRTY_SLUGS)
    return f"""{dirty_cte()},
tok AS (SELECT
  {tok}
FROM dirty),
num AS (SELECT
  {num}
FROM tok),
st AS (SELECT {st} FROM num),
msk AS (SELECT
  {msk}
FROM num, st)"""


def _sql_sparse():
    parts = [f"SELECT '{s}' AS col, round(avg(CASE WHEN {s} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_ratio, "
             f"avg(CASE WHEN {s} IS NULL THEN 1.0 ELSE 0.0 END) > 0.95 AS dropped FROM msk" for s in DIRTY_SLUGS]
    return _sql_clean_ctes() + "\n" + "\nUNION ALL ".join(parts)


@register("sparse_columns", _sql_sparse())
def sparse_columns(spark, sf_dir):
    _, model = cleaned_dirty(spark, sf_dir)
    rows = [(c, round(model.report["null_ratios"][c], 6), c in model.dropped_cols) for c in model.renamed]
    return spark.createDataFrame(rows, "col string, null_ratio double, dropped boolean")


@register("clean_table", _sql_clean_ctes() + "\nSELECT " +
          ", ".join(s for s in DIRTY_SLUGS if s not in DROPPED) + " FROM msk")
def clean_table(spark, sf_dir):
    """Fit the cleaner (two passes) and apply it (a lazy projection: the consumer's
    write of the result is its only materialisation)."""
    df, _ = cleaned_dirty(spark, sf_dir)
    return df


# ---------------------------------------------------------------- C11
RULES = {"l_quantity": (5.0, 45.0), "l_discount": (0.01, 0.09)}


@register("interval_rules", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount
FROM lineitem WHERE l_quantity BETWEEN 5.0 AND 45.0 AND l_discount BETWEEN 0.01 AND 0.09""")
def interval_rules(spark, sf_dir):
    li = load_table(spark, sf_dir, "lineitem")
    return C.interval_filter(li, RULES).select(*LI_KEY, "l_quantity", "l_discount")


@register("interval_rule_rejects", """WITH f AS (SELECT CASE
    WHEN NOT coalesce(l_quantity BETWEEN 5.0 AND 45.0, false) THEN 'l_quantity'
    WHEN NOT coalesce(l_discount BETWEEN 0.01 AND 0.09, false) THEN 'l_discount' END AS rule FROM lineitem),
r AS (SELECT * FROM (VALUES (0, 'l_quantity'), (1, 'l_discount')) t(rule_no, rule))
SELECT r.rule_no, r.rule, CAST(count(f.rule) AS BIGINT) AS n_removed
FROM r LEFT JOIN f ON r.rule = f.rule GROUP BY r.rule_no, r.rule""")
def interval_rule_rejects(spark, sf_dir):
    return C.interval_rejects(load_table(spark, sf_dir, "lineitem"), RULES)


# ---------------------------------------------------------------- C13 / C14
_NA_SUBSET = [s for s in DIRTY_SLUGS if s != "mostly_missing"]


@register("dropna_any", f"""{dirty_cte()}, tok AS (SELECT
  {", ".join(f"{sql_token_null(sql_q(h))} AS {s}" for h, s in zip(DIRTY_HEADERS, DIRTY_SLUGS))} FROM dirty)
SELECT {", ".join(_NA_SUBSET)} FROM tok WHERE {" AND ".join(f"{s} IS NOT NULL" for s in _NA_SUBSET)}""")
def dropna_any(spark, sf_dir):
    d = _dirty_tokens(spark, sf_dir)
    return C.dropna_any(d, _NA_SUBSET).select(*_NA_SUBSET)


def _sql_dtype_report():
    kept = [s for s in DIRTY_SLUGS if s not in DROPPED]
    parts = [f"SELECT '{s}' AS col, '{'double' if s in PROMOTED else 'string'}' AS dtype, "
             f"CAST(count(*) FILTER (WHERE {s} IS NULL) AS BIGINT) AS nulls, "
             f"CAST(count(DISTINCT {s}) AS BIGINT) AS uniques, "
             f"{'false' if s in PROMOTED else 'true'} AS is_categorical FROM msk" for s in kept]
    return _sql_clean_ctes() + "\n" + "\nUNION ALL ".join(parts)


@register("dtype_report", _sql_dtype_report())
def dtype_report(spark, sf_dir):
    df, _ = cleaned_dirty(spark, sf_dir)
    return C.dtype_report(df)


# ---------------------------------------------------------------- C17 / C18 / C19
@register("binarize_target", f"""{dirty_cte()}
SELECT {_sql_keys()},
  CASE WHEN coalesce({sql_strict_double(sql_token_null(sql_q(' Quantity ')))}, 0.0) > 25.0 THEN 1 ELSE 0 END AS label
FROM dirty""")
def binarize_target(spark, sf_dir):
    d = _dirty_tokens(spark, sf_dir)
    return C.binarize_target(d, "quantity", 25.0, out="label").select(*_keys_from_dirty(), "label")


_FEATS = ["quantity", "price_usd", "tax_rate", "return_flag", "line_status", "big_value"]


@register("prepare_features", _sql_clean_ctes() + "\nSELECT " + ", ".join(
    [f"CAST({k} AS BIGINT) AS {k}" for k in KEY_SLUGS] +
    [(f"coalesce({f}, 0.0) AS {f}" if f in PROMOTED else f"coalesce({sql_strict_double(f)}, 0.0) AS {f}")
     for f in _FEATS] +
    ["CASE WHEN coalesce(discount, 0.0) > 5.0 THEN 1 ELSE 0 END AS label"]) + " FROM msk")
def prepare_features(spark, sf_dir):
    df, _ = cleaned_dirty(spark, sf_dir)
    df = df.drop("ship_date").withColumns({k: F.col(k).cast("bigint") for k in KEY_SLUGS})
    out, feats, dropped = C.prepare_features(df, "discount", drop_suffixes=("_label",),
                                             positive_threshold=5.0, keep=KEY_SLUGS)
    assert feats == _FEATS and dropped == ["flag_label"], (feats, dropped)
    return out


@register("align_features", """SELECT event_id,
  coalesce(CASE WHEN regexp_matches(trim(json_extract_string(props, '$.k')), '""" + NUMERIC_PATTERN + """')
           THEN TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE) END, 0.0) AS k,
  CAST(0.0 AS DOUBLE) AS absent_feature,
  value
FROM events""")
def align_features(spark, sf_dir):
    from tessera.sources.records import records_from_json_column
    ev = load_table(spark, sf_dir, "events")
    rec = ev.select("event_id", "value", records_from_json_column("props").alias("r"))
    flat = rec.select("event_id", "value", F.col("r")["k"].alias("k"),
                      F.col("r")["extra_unused"].alias("extra_unused"))
    return C.align_features(flat, ["k", "absent_feature", "value"], fill_value=0.0, keep=["event_id"])
