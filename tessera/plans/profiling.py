"""Profiling queries (E2-E19) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import clean as C
from tessera.operators import profile as P
from tessera.operators.correlation import vif
from tessera.plans.cleaning import DIRTY_SLUGS, DROPPED, PROMOTED, _sql_clean_ctes, cleaned_dirty
from tessera.plans.common import register, sql_q, sql_token_null
from tessera.plans.standins import DIRTY_HEADERS, ORDER_FEATURES_SQL, dirty_cte, dirty_lineitem, order_features
from tessera.sources.tables import load_table


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def _union(parts):
    return "\nUNION ALL ".join(parts)


# ---------------------------------------------------------------- E2
@register("missing_ratio", f"""{dirty_cte()}
""" + _union([f"SELECT '{s}' AS col, round(avg(CASE WHEN {sql_token_null(sql_q(h))} IS NULL THEN 1.0 ELSE 0.0 END), 6) "
              f"AS missing_ratio FROM dirty" for h, s in zip(DIRTY_HEADERS, DIRTY_SLUGS)]))
def missing_ratio(spark, sf_dir):
    d = C.tokens_to_null(C.rename_columns(dirty_lineitem(spark, sf_dir)))
    return round_doubles(P.missing_ratio(d))


# ---------------------------------------------------------------- E3-E5
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("describe_numeric", _union([
    f"SELECT '{c}' AS col, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
    f"round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM lineitem" for c in LI_NUM]))
def describe_numeric(spark, sf_dir):
    return round_doubles(P.describe(load_table(spark, sf_dir, "lineitem"), LI_NUM))


EV_NUM = ["value", "user_id"]


@register("skew_kurtosis", _union([
    f"SELECT '{c}' AS col, round(CASE WHEN stddev_pop({c}) = 0 THEN 0 ELSE skewness({c}) END, 6) AS skew, "
    f"round(CASE WHEN stddev_pop({c}) = 0 THEN 0 ELSE kurtosis({c}) END, 6) AS kurt FROM events" for c in EV_NUM]))
def skew_kurtosis(spark, sf_dir):
    return round_doubles(P.skew_kurtosis(load_table(spark, sf_dir, "events"), EV_NUM))


@register("pct_zeros", _union([
    f"SELECT '{c}' AS col, round(avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END), 6) AS pct_zeros FROM lineitem"
    for c in LI_NUM]))
def pct_zeros(spark, sf_dir):
    return round_doubles(P.pct_zeros(load_table(spark, sf_dir, "lineitem"), LI_NUM))


# ---------------------------------------------------------------- E12 / E13
@register("category_freq", "SELECT event_type AS value, count(*) AS n FROM events "
                           "WHERE event_type IS NOT NULL GROUP BY event_type")
def category_freq(spark, sf_dir):
    return P.category_freq(load_table(spark, sf_dir, "events"), "event_type")


@register("top_k_category", "SELECT o_orderpriority AS value, count(*) AS n FROM orders "
                            "GROUP BY o_orderpriority ORDER BY n DESC, value LIMIT 3")
def top_k_category(spark, sf_dir):
    return P.category_freq(load_table(spark, sf_dir, "orders"), "o_orderpriority", top=3)


@register("class_balance", """SELECT o_orderstatus AS class, count(*) AS n,
  round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM orders GROUP BY o_orderstatus""")
def class_balance(spark, sf_dir):
    return P.class_balance(load_table(spark, sf_dir, "orders"), "o_orderstatus")


# ---------------------------------------------------------------- E14 / E18
@register("histogram_30", """WITH r AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 30 AS w FROM events),
b AS (SELECT least(29, greatest(0, CAST(floor((value - r.lo) / r.w) AS INTEGER))) AS bin FROM events, r),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(30))
SELECT g.bin, round(r.lo + g.bin * r.w, 6) AS lo, round(r.lo + (g.bin + 1) * r.w, 6) AS hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM g CROSS JOIN r LEFT JOIN c ON g.bin = c.bin""")
def histogram_30(spark, sf_dir):
    return round_doubles(P.histogram(load_table(spark, sf_dir, "events"), "value", bins=30))


@register("pair_bins", """WITH r AS (SELECT min(p_size) AS xl, (max(p_size) - min(p_size)) / 20 AS xw,
  min(p_retailprice) AS yl, (max(p_retailprice) - min(p_retailprice)) / 20 AS yw FROM part)
SELECT least(19, greatest(0, CAST(floor((p_size - r.xl) / r.xw) AS INTEGER))) AS xbin,
       least(19, greatest(0, CAST(floor((p_retailprice - r.yl) / r.yw) AS INTEGER))) AS ybin,
       count(*) AS n
FROM part, r GROUP BY ALL""")
def pair_bins(spark, sf_dir):
    return P.pair_bins(load_table(spark, sf_dir, "part"), "p_size", "p_retailprice", bins=20)


# ---------------------------------------------------------------- E15 / E16
@register("crosstab_row_norm", """SELECT o_orderpriority,
  round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS share_F,
  round(count(*) FILTER (WHERE o_orderstatus = 'O') / count(*), 6) AS share_O,
  round(count(*) FILTER (WHERE o_orderstatus = 'P') / count(*), 6) AS share_P
FROM orders GROUP BY o_orderpriority""")
def crosstab_row_norm(spark, sf_dir):
    return round_doubles(P.crosstab_row_norm(load_table(spark, sf_dir, "orders"), "o_orderpriority",
                                             "o_orderstatus"))


@register("target_concentration", """WITH s AS (
  SELECT 'o_orderpriority' AS col, o_orderpriority AS value, o_orderstatus AS t FROM orders
  UNION ALL SELECT 'o_year', CAST(year(o_orderdate) AS VARCHAR), o_orderstatus FROM orders
  UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), o_orderstatus FROM orders),
c AS (SELECT col, value, t, count(*) AS n FROM s GROUP BY ALL),
m AS (SELECT col, value, max(n) / sum(n) AS max_share FROM c GROUP BY col, value)
SELECT col, round(avg(max_share), 6) AS score FROM m GROUP BY col ORDER BY score DESC, col LIMIT 5""")
def target_concentration(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders").withColumn("o_year", F.year("o_orderdate").cast("string"))
    return round_doubles(P.target_concentration(o, ["o_orderpriority", "o_year", "o_custkey"],
                                                "o_orderstatus", top=5))


# ---------------------------------------------------------------- E17 / E19 / flagship
_KEPT = [s for s in DIRTY_SLUGS if s not in DROPPED]


def _sql_num_stats(s, with_describe=True):
    skew = f"round(CASE WHEN count({s}) < 3 THEN NULL WHEN stddev_pop({s}) = 0 THEN 0 ELSE skewness({s}) END, 6)"
    kurt = f"round(CASE WHEN count({s}) < 4 THEN NULL WHEN stddev_pop({s}) = 0 THEN 0 ELSE kurtosis({s}) END, 6)"
    zeros = f"round(avg(CASE WHEN {s} = 0 THEN 1.0 ELSE 0.0 END), 6)"
    return skew, kurt, zeros


def _sql_profile_flags():
    parts = []
    for s in _KEPT:
        mr = f"avg(CASE WHEN {s} IS NULL THEN 1.0 ELSE 0.0 END)"
        if s in PROMOTED:
            skew, _, zeros = _sql_num_stats(s)
            parts.append(f"SELECT '{s}' AS col, round({mr}, 6) AS missing_ratio, {skew} AS skew, {zeros} AS pct_zeros, "
                         f"{mr} >= 0.3 AS flag_missing, coalesce(abs({skew}) > 1.0, false) AS flag_skew, "
                         f"coalesce({zeros} >= 0.8, false) AS flag_zeros FROM msk")
        else:
            parts.append(f"SELECT '{s}', round({mr}, 6), NULL::DOUBLE, NULL::DOUBLE, {mr} >= 0.3, false, false FROM msk")
    return _sql_clean_ctes() + "\n" + _union(parts)


@register("profile_flags", _sql_profile_flags())
def profile_flags(spark, sf_dir):
    df, _ = cleaned_dirty(spark, sf_dir, materialize=True)
    return round_doubles(P.profile_flags(df))


def _sql_profile_compare():
    raw = _union([f"SELECT '{s}' AS col, round(avg(CASE WHEN {sql_q(h)} IS NULL OR trim({sql_q(h)}) = '' "
                  f"THEN 1.0 ELSE 0.0 END), 6) AS raw_missing FROM dirty" for h, s in zip(DIRTY_HEADERS, DIRTY_SLUGS)])
    cl = _union([f"SELECT '{s}' AS col, round(avg(CASE WHEN {s} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS clean_missing FROM msk"
                 for s in _KEPT])
    return (_sql_clean_ctes() + f",\nr AS ({raw}),\nc AS ({cl})\n"
            "SELECT coalesce(r.col, c.col) AS col, r.raw_missing, c.clean_missing FROM r FULL JOIN c ON r.col = c.col")


@register("profile_compare", _sql_profile_compare())
def profile_compare(spark, sf_dir):
    raw = dirty_lineitem(spark, sf_dir)
    df, _ = cleaned_dirty(spark, sf_dir)
    return round_doubles(P.profile_compare(raw, df))


def _sql_clean_profile():
    parts = []
    for s in _KEPT:
        mr = f"round(avg(CASE WHEN {s} IS NULL THEN 1.0 ELSE 0.0 END), 6)"
        if s in PROMOTED:
            skew, kurt, zeros = _sql_num_stats(s)
            parts.append(
                f"SELECT '{s}' AS col, 'double' AS dtype, {mr} AS missing_ratio, count({s}) AS count, "
                f"round(CAST(sum(CAST({s} AS DECIMAL(38, 6))) AS DOUBLE) / count({s}), 6) AS mean, "
                f"round(stddev_samp({s}), 6) AS std, round(min({s}), 6) AS min, "
                f"round(quantile_cont({s}, 0.25), 6) AS p25, round(quantile_cont({s}, 0.5), 6) AS p50, "
                f"round(quantile_cont({s}, 0.75), 6) AS p75, round(max({s}), 6) AS max, "
                f"{skew} AS skew, {kurt} AS kurt, {zeros} AS pct_zeros FROM msk")
        else:
            nul = "NULL::DOUBLE"
            parts.append(f"SELECT '{s}', 'string', {mr}, count({s}), {', '.join([nul] * 10)} FROM msk")
    return _sql_clean_ctes() + "\n" + _union(parts)


@register("clean_profile", _sql_clean_profile())
def clean_profile(spark, sf_dir):
    """Flagship: fit + apply the cleaner on the raw stand-in, save the clean table, then
    profile every column."""
    df, _ = cleaned_dirty(spark, sf_dir, materialize=True)
    return round_doubles(P.profile_table(df))


_FOUND = ["n_lines", "sum_qty", "sum_price", "avg_disc", "o_totalprice"]


def _sql_findings():
    stats = _union([f"SELECT '{c}' AS col, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS mr, skewness({c}) AS sk, "
                    f"avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END) AS z FROM order_features" for c in _FOUND])
    advice = _union([f"SELECT '{k}' AS finding, '{v}' AS advice" for k, v in P.ADVICE.items()])
    return f"""WITH {ORDER_FEATURES_SQL}, s AS ({stats}),
c AS (SELECT corr(n_lines, sum_qty) AS r12, corr(n_lines, sum_price) AS r13, corr(sum_qty, sum_price) AS r23 FROM order_features),
d AS (SELECT *, 1 - r12 * r12 - r13 * r13 - r23 * r23 + 2 * r12 * r13 * r23 AS det FROM c),
m AS (SELECT 'missing' AS finding, col FROM s WHERE mr >= 0.3 UNION ALL SELECT 'skew', col FROM s WHERE abs(sk) > 1
  UNION ALL SELECT 'zeros', col FROM s WHERE z >= 0.8 UNION ALL SELECT 'vif', 'n_lines' FROM d WHERE (1 - r23 * r23) / det > 3
  UNION ALL SELECT 'vif', 'sum_qty' FROM d WHERE (1 - r13 * r13) / det > 3 UNION ALL SELECT 'vif', 'sum_price' FROM d WHERE (1 - r12 * r12) / det > 3),
a AS ({advice})
SELECT a.finding, count(m.col) AS n, coalesce(string_agg(m.col, ',' ORDER BY m.col), '') AS columns, a.advice
FROM a LEFT JOIN m ON m.finding = a.finding GROUP BY a.finding, a.advice"""


@register("profile_findings", _sql_findings())
def profile_findings(spark, sf_dir):
    """Findings over the order features: which columns are sparse, skewed, mostly zero or collinear (VIF above 3 here)."""
    of = order_features(spark, sf_dir, materialize=True).select(*_FOUND)
    found = P.findings(P.profile_flags(of), vif(of, ["n_lines", "sum_qty", "sum_price"]), vif_flag=3.0)
    return found.withColumn("columns", F.array_join("columns", ","))
