"""Exact quantiles (linear interpolation, = pandas / DuckDB ``quantile_cont``) by counting.

No task holds a column's distinct values, and rows are not shuffled by value:

1. one aggregate per (group, column): the number of values and, from a sketch with a guaranteed rank
   error, two cut points around each wanted quantile;
2. one pass sorts every value into the cells between the cuts (Arrow batches) and counts
   cells; only values strictly inside a wanted stretch, about ``4 / ACCURACY`` of the rows for
   each quantile, are kept as values (equal ones as one row with a count);
3. a quantile's positions fall on a cut (then that is the value) or into a kept cell, whose values
   are ranked by the distributed prefix sum of ``rank.py``;
4. q = v_lo + (h - floor(h)) (v_hi - v_lo) with h = (n - 1) p.

Should a position fall outside its stretch (the sketch's guarantee broken), the stretches
are widened and step 2 is run again, at last over all values: the result is always exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import q
from tessera.operators.rank import join_null_safe, ordered_prefix
from tessera.session import cut_lineage

#: the sketch's rank error is 1 / ACCURACY of the values
ACCURACY = 4000
BUCKETS = 256


def _values(df: DataFrame, cols, by) -> DataFrame:
    """(by..., _values): the columns' doubles in one array, NaN as NULL; groups of NULL are groups."""
    v = [F.nanvl(F.col(q(c)).cast("double"), F.lit(None).cast("double")) for c in cols]
    return df.select(*[F.col(q(b)) for b in by], F.array(*v).alias("_values"))


def _edges(probs, slack: float) -> tuple[list[float], list[bool]]:
    """Quantiles whose approximate values are the cuts, and for each number k of cuts below a value
    whether values there (between cuts k - 1 and k) are wanted."""
    edges = sorted({min(1.0, max(0.0, p + side * slack)) for p in probs for side in (-1, 1)})
    stretches = [(edges.index(max(0.0, p - slack)), edges.index(min(1.0, p + slack))) for p in probs]
    return edges, [any(lo < k <= hi for lo, hi in stretches) for k in range(len(edges) + 1)]


def _bounds(rows: DataFrame, cols, edges, by) -> DataFrame:
    """(by..., _at): per column its number of values ``n`` and its cuts ``at``."""
    per = [F.struct(F.count(v).alias("n"), F.percentile_approx(v, edges, ACCURACY).alias("at"))
           for v in (F.col("_values")[i] for i in range(len(cols)))]
    return rows.groupBy(*[F.col(q(b)) for b in by]).agg(F.array(*per).alias("_at"))


def _count_cells(width: int, edges: int, keep: list[bool], fixed: np.ndarray | None):
    """Counts the values of each batch by (group, column, cell[, value]).  ``fixed``: the cuts
    (column x edge) where there are no groups, else each row brings its group's."""
    wanted = np.array(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                cuts = fixed if fixed is not None else \
                    batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width, edges)
                row, col = np.nonzero(~np.isnan(v))
                value = v[row, col] + 0.0                       # one zero
                own = cuts[col] if fixed is not None else cuts[row, col]
                k = (own < value[:, None]).sum(axis=1)
                on = (own == value[:, None]).any(axis=1)
                kept = wanted[k] & ~on
                lo, hi = (own[np.arange(len(k)), np.clip(i, 0, edges - 1)] for i in (k - 1, k))
                with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                    # values between two neighbouring quantiles: equal widths make fair buckets
                    share = np.nan_to_num((value - lo) / (hi - lo), nan=0.0, posinf=1.0, neginf=0.0)
                bucket = np.where(kept, np.clip((share * BUCKETS).astype(np.int64), 0, BUCKETS - 1), -1)
                # equal cells and values side by side: two plain keys sort many times faster than records
                group, g = np.unique(batch.column(0).to_numpy(), return_inverse=True)
                cell, held = 2 * k + on, np.where(kept | on, value, 0.0)
                code = ((g[row] * width + col) * (2 * edges + 2) + cell) * (BUCKETS + 1) + bucket + 1
                order = np.lexsort((held, code))
                code, held = code[order], held[order]
                new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (held[1:] != held[:-1])]))[:len(code)]
                n, first, held = np.diff(np.append(new, len(code))).astype(np.int64), order[new], held[new]
                odd, inner = cell[first] % 2 == 1, bucket[first] >= 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[g[row[first]]]), pa.array(col[first], pa.int32()), pa.array(cell[first], pa.int32()), pa.array(held, mask=~odd),
                     pa.array(bucket[first], pa.int32(), mask=~inner), pa.array(held, mask=~inner), pa.array(n)],
                    names=["_g", "_col", "_cell", "_cut", "_bucket", "_v", "_n"])
    return run


def _cells(rows: DataFrame, bounds: DataFrame, cols, by, edges: int, keep: list[bool]) -> DataFrame:
    """(_g, _col, _cell, _cut, _bucket, _v, _n): counts of the cells; ``_cut`` where the cell is a cut, ``_v``
    one row per value where the cell's values are kept.  ``bounds``: (by..., _g, _at)."""
    if by:
        cuts = F.flatten(F.transform("_at", lambda b: F.coalesce(b["at"], F.array_repeat(F.lit(None).cast("double"), edges))))
        rows, fixed = join_null_safe(rows, bounds, list(by)).select("_g", "_values", cuts.alias("_cuts")), None
    else:
        at = bounds.first()["_at"]                                  # one row
        fixed = np.array([b["at"] or [np.nan] * edges for b in at], dtype=np.float64)
        rows = rows.select(F.lit(0).cast("long").alias("_g"), "_values")
    long = rows.mapInArrow(_count_cells(len(cols), edges, keep, fixed),
                           "_g long, _col int, _cell int, _cut double, _bucket int, _v double, _n long")
    return long.groupBy("_g", "_col", "_cell", "_cut", "_bucket", "_v").agg(F.sum("_n").alias("_n"))


def _positions(bounds: DataFrame, probs) -> DataFrame:
    """(_g, _col, _p, _j, _frac, _low): the positions each quantile lies between."""
    h = (F.col("_n") - 1).cast("double") * F.col("_p")
    return bounds.select("_g", F.posexplode("_at").alias("_col", "_b")).select("_g", "_col", F.col("_b.n").alias("_n")) \
        .filter("_n > 0").select("_g", "_col", "_n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("_p")) \
        .select("_g", "_col", "_p", (h - F.floor(h)).alias("_frac"), F.floor(h).cast("long").alias("_lo"), F.ceil(h).cast("long").alias("_hi")) \
        .select("_g", "_col", "_p", "_frac", "_lo", F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("_j")) \
        .withColumn("_low", F.col("_j") == F.col("_lo")).drop("_lo")


def quantiles(df: DataFrame, cols, probs, by=()) -> DataFrame:
    """Long table (by..., col, p, value)."""
    by, cols, probs, keys = list(by), list(cols), [float(p) for p in probs], ["_g", "_col"]
    spark, rows = df.sparkSession, _values(df, cols, by)
    slack = 2.0 / ACCURACY
    while True:
        every = slack >= 1
        edges, keep = _edges(probs, slack)
        bounds = _bounds(rows, cols, edges, by).select(*[F.col(q(b)) for b in by], F.monotonically_increasing_id().alias("_g"), "_at")
        # one row without groups
        bounds = cut_lineage(bounds, "quantile_bounds") if by else spark.createDataFrame(bounds.collect(), bounds.schema)
        counted = cut_lineage(_cells(rows, bounds, cols, by, len(edges), [True] * len(keep) if every else keep), "quantile_cells")
        cells = counted.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_total"), F.max("_cut").alias("_cut"),
                                                    F.count_if(F.col("_v").isNotNull()).alias("_kept"))
        before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)    # a few cells
        cells = cells.withColumn("_first", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        at = _positions(bounds, probs).join(cells, keys) \
            .filter((F.col("_first") <= F.col("_j")) & (F.col("_j") < F.col("_first") + F.col("_total")))
        if every or at.filter("_cut is null and _kept = 0").isEmpty():
            break
        slack *= 16
    inside = ordered_prefix(counted.filter("_v is not null").withColumnRenamed("_bucket", "_place"), "_v", ["_n"], by=[*keys, "_cell"],
                            bucket_col="_place")
    hits = at.filter("_cut is null").join(inside.select(*keys, "_cell", "_v", "_n", "_n_before"), [*keys, "_cell"]) \
        .filter((F.col("_n_before") <= F.col("_j") - F.col("_first")) & (F.col("_j") - F.col("_first") < F.col("_n_before") + F.col("_n")))
    both = at.filter("_cut is not null").select(*keys, "_p", "_frac", "_low", F.col("_cut").alias("_v")) \
        .unionByName(hits.select(*keys, "_p", "_frac", "_low", "_v"))
    out = both.groupBy(*keys, "_p").agg(F.max(F.when(F.col("_low"), F.col("_v"))).alias("_vlo"), F.max("_v").alias("_vhi"),
                                        F.first("_frac").alias("_frac"))
    if by:
        out = out.join(bounds.select("_g", *[F.col(q(b)) for b in by]), "_g")
    return out.select(*[F.col(q(b)) for b in by], F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_col") + 1).alias("col"),
                      F.col("_p").alias("p"), (F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo"))).alias("value"))


def quantile_columns(df: DataFrame, cols, probs, names, by=()) -> DataFrame:
    """Wide form: (by..., col, <names[i]> for probs[i]); a column without values has NULLs."""
    by, cols = list(by), list(cols)
    long = quantiles(df, cols, probs, by)
    wide = long.groupBy(*[F.col(q(b)) for b in by], "col").agg(
        *[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("value"))).alias(n) for p, n in zip(probs, names)])
    if by:
        return wide
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "col string")
    return every.join(wide, "col", "left")
