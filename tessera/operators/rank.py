"""Distributed ordered prefix sums and tie-aware average ranks.

A global ``Window.orderBy`` (no partition) runs in ONE task.  Instead:

1. reduce to distinct order values with their weights (``groupBy`` with map-side
   combine: a value held by a third of all rows is still one row here);
2. cut the distinct values into ``B`` buckets of consecutive values with
   ``percentile_approx`` (B-1 cut points per group, a bounded array);
3. bucket id = number of cuts < value, found by a binary search written as a
   higher-order ``aggregate`` over log2(B) steps (JVM-side, no UDF);
4. bucket totals (groups x B rows) -> offsets with a small window per group;
5. running sum inside each (group, bucket) with a window partitioned by it.

Weight before value v = offset(bucket) + running sum before v inside the bucket.
Every step is a DataFrame operation; the only values brought to the driver are the
B-1 cut points of an ungrouped order (a bounded array).  The same helper gives
average ranks (Spearman), the Mann-Whitney AUC, and exact stratified splits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import q

DEFAULT_BUCKETS = 256


def lower_bound(cuts: Column, v: Column, max_len: int) -> Column:
    """Number of elements of the sorted array ``cuts`` strictly below ``v`` (binary search)."""
    steps = max(1, math.ceil(math.log2(max_len + 1)) + 1)
    init = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))

    def step(acc, _i):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.element_at(cuts, mid + 1) < v
        go = acc["lo"] < acc["hi"]
        return F.when(go & below, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))) \
                .when(go, F.struct(acc["lo"].alias("lo"), mid.alias("hi"))) \
                .otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step)["lo"]


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the keys of ``left`` stay."""
    names = {k: f"_right_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    on = F.lit(True)
    for k, other in names.items():
        on = on & F.col(q(k)).eqNullSafe(F.col(q(other)))
    return left.join(right, on, how).drop(*names.values())


def ordered_prefix(counts: DataFrame, order_col: str, weights: list[str], by: list[str] | None = None,
                   buckets: int | None = None, accuracy: int | None = None,
                   tiebreak: list[str] | None = None, bucket_col: str | None = None) -> DataFrame:
    """Add ``<w>_before`` = sum of ``w`` over rows of the same ``by`` group that come
    strictly before in (``order_col``, ``tiebreak``...) order.  Without ``tiebreak``,
    ``counts`` must hold one row per (by, order value).  ``bucket_col`` supplies a
    precomputed bucket that is monotone in the order (skips the quantile pass)."""
    by = list(by or [])
    spark = counts.sparkSession
    if buckets is None:
        buckets = max(DEFAULT_BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    accuracy = accuracy or max(10000, 8 * buckets)
    probs = [i / buckets for i in range(1, buckets)]
    v = F.col(order_col)

    if bucket_col is not None:
        tagged = counts.withColumn("_bucket", F.col(bucket_col))
    elif buckets > 1:
        cuts = counts.groupBy(*by).agg(
            F.array_sort(F.array_distinct(F.percentile_approx(v, probs, accuracy))).alias("_cuts"))
        if by:
            # one row per group with B-1 cut points; NULL is a group like any other
            tagged = join_null_safe(counts, cuts, by)
            tagged = tagged.withColumn("_bucket", lower_bound(F.col("_cuts"), v, buckets)).drop("_cuts")
        else:
            cut_list = cuts.first()["_cuts"] or []          # B-1 numbers: a scalar-sized result
            arr = F.array(*[F.lit(x) for x in cut_list]) if cut_list else F.array().cast("array<double>")
            tagged = counts.withColumn("_bucket", lower_bound(arr, v, buckets))
    else:
        tagged = counts.withColumn("_bucket", F.lit(0))

    tot = tagged.groupBy(*by, "_bucket").agg(*[F.sum(w).alias(f"_tot_{w}") for w in weights])
    wb = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*by, "_bucket", *[F.coalesce(F.sum(f"_tot_{w}").over(wb), F.lit(0)).alias(f"_off_{w}")
                                         for w in weights])
    wi = Window.partitionBy(*by, "_bucket").orderBy(order_col, *(tiebreak or [])).rowsBetween(Window.unboundedPreceding, -1)
    inner = tagged.select("*", *[F.coalesce(F.sum(w).over(wi), F.lit(0)).alias(f"_in_{w}") for w in weights])
    # without groups the offsets are at most B rows
    out = join_null_safe(inner, offs if by else F.broadcast(offs), [*by, "_bucket"])
    return out.select(*[c for c in counts.columns],
                      *[(F.col(f"_off_{w}") + F.col(f"_in_{w}")).alias(f"{w}_before") for w in weights])


def rank_table(df: DataFrame, col: str, by: list[str] | None = None, out: str = "rank",
               buckets: int | None = None) -> DataFrame:
    """(by..., value, rank): average rank (1-based, ties share the mean) of each
    distinct non-NULL value of ``col`` within its ``by`` group."""
    by = list(by or [])
    counts = (df.filter(F.col(col).isNotNull()).groupBy(*by, col)
              .agg(F.count(F.lit(1)).alias("_n")))
    pref = ordered_prefix(counts, col, ["_n"], by, buckets)
    return pref.select(*by, col, (F.col("_n_before") + (F.col("_n") + F.lit(1.0)) / F.lit(2.0)).alias(out))


def with_rank(df: DataFrame, col: str, out: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Attach the average rank of ``col`` (NULL stays NULL) to every row."""
    out, by = out or f"{col}_rank", list(by or [])
    return join_null_safe(df, rank_table(df, col, by, out=out), [*by, col], "left")
