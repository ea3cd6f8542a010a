"""Correlation family: Spearman matrix / vs target, Pearson pairs, VIF.

* Pearson coefficients and VIF come from one masked Gram pass (``gram.py``), whatever the number
  of columns.
* Spearman = Pearson on average ranks over the rows where both columns have values.  Columns with
  the same NULL pattern (known from the Gram masks) share one set of rows; for two patterns the
  ranks are taken over the rows that have both.  A column is put in order once: its values are counted in
  all their sets of rows (contexts) side by side, in one long-form job for all columns
  (``rank.py``: no single-task order).  Ranks of columns with few values are looked up where the rows
  are (``LOOKUP``); the others are joined and regrouped by row.  A Gram-like pass adds up the rank
  vectors of each context.  So the number of jobs does not depend on the number of columns.
* VIF = diag(R^-1) of the correlation matrix R; the p x p inverse runs on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import q
from tessera.functions.stats import safe_corr, t_pvalue
from tessera.operators.gram import TINY, gram
from tessera.operators.rank import ordered_prefix
from tessera.session import cut_lineage


def _long(df: DataFrame, structs, schema: str) -> DataFrame:
    if not structs:
        return df.sparkSession.createDataFrame([], schema)
    return df.agg(F.array(*structs).alias("_a")).select(F.inline("_a"))


def _contexts(n: np.ndarray, masks: np.ndarray, pairs) -> dict[tuple[int, int], list[int]]:
    """Columns ranked over the rows that have a value in both a and b, by (a, b): one context per set of rows
    that some wanted pair of columns has."""
    out: dict[tuple[int, int], set[int]] = {}
    for i, j in pairs:
        out.setdefault(_rows_of(n, masks, i, j), set()).update((i, j))
    return {c: sorted(out[c]) for c in sorted(out) if n[c] > 0}


def _rows_of(n: np.ndarray, masks: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """The first columns with the NULLs of i and j; one alone where the other has values in all its rows."""
    a, b = sorted(int(np.flatnonzero(masks[x])[0]) for x in (i, j))
    if n[a, b] == n[a, a]:
        return a, a
    return (b, b) if n[a, b] == n[b, b] else (a, b)


#: columns of few values, up to so many in all, have their ranks looked up in the tasks
LOOKUP = 100_000


def _rank_sums(contexts: dict[tuple[int, int], list[int]], places: dict[int, list[int]], tables: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Sums over rows of products of ranks (off their mean) of each context's columns.  Rows bring all their
    values, and the ranks of the columns that have no table, one for each context of the column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            has = ~np.isnan(values)
            ranks = batch.column(1)
            cell = ranks.flatten()
            col, own = cell.field(0).to_numpy(zero_copy_only=False), cell.field(1)
            row = np.repeat(np.arange(batch.num_rows), np.diff(ranks.offsets.to_numpy()))
            numbers, start = own.flatten().to_numpy(zero_copy_only=False), own.offsets.to_numpy()[:-1]
            start = start - start[:1]
            x: dict[int, np.ndarray] = {}                    # (contexts of the column, rows)
            for i, width in ((i, len(p)) for i, p in places.items()):
                x[i] = np.zeros((width, batch.num_rows))
                if i in tables:
                    known, rank = tables[i]
                    here = np.flatnonzero(has[:, i])
                    x[i][:, here] = rank[:width, np.searchsorted(known, values[here, i])]
                else:
                    mine = np.flatnonzero(col == i)
                    x[i][:, row[mine]] = numbers[start[mine] + np.arange(width)[:, None]]
            for k, ((a, b), cols) in enumerate(contexts.items()):
                here = has[:, a] & has[:, b]
                part = np.column_stack([x[i][places[i].index(k)][here] for i in cols])
                part = part.T @ part
                sums[k] = part if k not in sums else sums[k] + part
        for k, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.reshape(-1)], pa.list_(pa.float64()))],
                                             names=["ctx", "part"])
    return run


def _rank_vectors(stacked: DataFrame, rows: DataFrame, ranks: DataFrame, places, tables) -> DataFrame:
    """(v, ranks) per row: the values, and the ranks of the columns without a table."""
    wanted = [i for i in places if i not in tables]
    none = F.array().cast("array<struct<col:int,r:array<double>>>")
    if not wanted:
        return rows.select("v", none.alias("ranks"))
    found = stacked.filter(F.col("col").isin(wanted)).join(ranks, ["col", "value"]).select("row", "col", "r")
    many = found.groupBy("row").agg(F.collect_list(F.struct("col", "r")).alias("ranks"))
    return rows.join(many, "row", "left").select("v", F.coalesce("ranks", none).alias("ranks"))


def _tables(ranks: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Values in order and their ranks off the mean (context by value) of the columns with the fewest values,
    at most LOOKUP values in all.  A value that many rows hold is then no key of a join."""
    sizes = {r["col"]: r["n"] for r in ranks.groupBy("col").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken, room = [], LOOKUP
    for i, n in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
        if n > room:
            break
        taken.append(i)
        room -= n
    if not taken:
        return {}
    out: dict[int, list] = {i: [] for i in taken}
    for r in ranks.filter(F.col("col").isin(taken)).collect():
        out[r["col"]].append((r["value"], r["r"]))
    return {i: (np.array([v for v, _ in sorted(x)]), np.array([r for _, r in sorted(x)]).T) for i, x in out.items()}


def rank_correlations(df: DataFrame, cols, pairs) -> list[tuple[int, int, float | None, int]]:
    """(i, j, r, n) of each wanted pair of column positions."""
    cols, pairs = list(cols), list(pairs)
    known = gram(df, cols)
    masks = known.same_mask()
    contexts = _contexts(known.n, masks, pairs)
    found: dict[tuple[int, int, int, int], float | None] = {}
    if contexts:
        # the contexts of each column; its values are counted and ranked in all of them at once
        places = {i: [k for k, c in enumerate(contexts.values()) if i in c] for i in sorted({i for c in contexts.values() for i in c})}
        widest = max(map(len, places.values()))
        keys = list(contexts)
        values = F.array(*[F.nanvl(F.col(q(c)).cast("double"), F.lit(None).cast("double")) for c in cols])
        rows = cut_lineage(df.select(F.monotonically_increasing_id().alias("row"), values.alias("v")), "rank_rows")

        def counted(i):
            inside = [F.get("v", F.lit(keys[k][0])).isNotNull() & F.get("v", F.lit(keys[k][1])).isNotNull() for k in places[i]]
            return F.struct(F.lit(i).alias("col"), F.get("v", F.lit(i)).alias("value"),
                            F.array(*[x.cast("long") for x in inside], *[F.lit(0).cast("long")] * (widest - len(inside))).alias("inside"))
        stacked = rows.select("row", F.explode(F.array(*[counted(i) for i in places])).alias("c")).select("row", "c.*") \
            .filter(F.col("value").isNotNull())
        weights = [f"n{j}" for j in range(widest)]
        counts = stacked.groupBy("col", "value").agg(*[F.sum(F.get("inside", F.lit(j))).alias(w) for j, w in enumerate(weights)])
        middles = F.array(*[F.array(*[F.lit((float(known.n[keys[k]]) + 1) / 2) for k in places.get(i, [])], *[F.lit(0.0)] * (widest - len(places.get(i, []))))
                            for i in range(len(cols))])
        rank = [F.col(f"{w}_before") + (F.col(w) + F.lit(1.0)) / F.lit(2.0) - F.get(F.get(middles, F.col("col")), F.lit(j)) for j, w in enumerate(weights)]
        ranks = cut_lineage(ordered_prefix(counts, "value", weights, ["col"]).select("col", "value", F.array(*rank).alias("r")), "ranks")
        tables = _tables(ranks)
        vectors = _rank_vectors(stacked.select("row", "col", "value"), rows, ranks, places, tables)
        sums = vectors.select("v", "ranks").mapInArrow(_rank_sums(contexts, places, tables), "ctx int, part array<double>") \
            .groupBy("ctx").agg(Summarizer.sum(array_to_vector("part")).alias("part")).collect()
        for s in sums:
            (a, b), c = keys[s["ctx"]], contexts[keys[s["ctx"]]]
            xx = s["part"].toArray().reshape(len(c), len(c))
            own = np.diag(xx)
            for i, j in combinations(range(len(c)), 2):
                varies = min(own[i], own[j]) > TINY * known.n[a, b] ** 3
                found[a, b, c[i], c[j]] = float(np.clip(xx[i, j] / np.sqrt(own[i] * own[j]), -1, 1)) if varies else None
    return [(i, j, found.get((*_rows_of(known.n, masks, i, j), *sorted((i, j)))), int(known.n[i, j])) for i, j in pairs]


def spearman_pairs(df: DataFrame, cols, min_abs: float | None = None) -> DataFrame:
    """Long Spearman matrix, upper triangle: (a, b, r, n), NULLs left out pairwise."""
    cols = list(cols)
    rows = [(cols[i], cols[j], r, n) for i, j, r, n in rank_correlations(df, cols, list(combinations(range(len(cols)), 2)))]
    if min_abs is not None:
        rows = [x for x in rows if x[2] is not None and abs(x[2]) >= min_abs]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double, n bigint")


def strong_pairs(pairs: DataFrame, threshold: float = 0.7, top: int = 5) -> DataFrame:
    """|r| >= threshold, strongest first (ties by names), first ``top``."""
    return (pairs.filter(F.abs("r") >= threshold)
            .orderBy(F.desc(F.abs("r")), "a", "b").limit(top))


def spearman_target(df: DataFrame, features, target: str, with_pvalue: bool = False) -> DataFrame:
    """(feature, r, n, t_stat[, p_value]) of each feature against the target, NULLs
    omitted pairwise; t = r * sqrt((n-2)/(1-r^2))."""
    cols = [*features, target]
    last = len(cols) - 1
    rows = [(cols[i], r, n) for i, _, r, n in rank_correlations(df, cols, [(i, last) for i in range(last)])]
    schema = "feature string, r double, n bigint"
    if with_pvalue:
        rows, schema = [(*x, t_pvalue(x[1], x[2])) for x in rows], schema + ", p_value double"
    n = F.col("n").cast("double")
    t = F.try_divide(F.col("r") * F.sqrt(n - 2), F.sqrt(1 - F.col("r") * F.col("r")))
    out = df.sparkSession.createDataFrame(rows, schema).withColumn("t_stat", F.when(n > 2, t))
    return out.select("feature", "r", "n", "t_stat", *(["p_value"] if with_pvalue else []))


def pearson_pairs(df: DataFrame, cols, min_abs: float | None = None) -> DataFrame:
    """(a, b, r): upper-triangle Pearson r over pairwise complete rows; NULL where a column does
    not vary."""
    cols = list(cols)
    r = gram(df, cols).pearson()
    rows = [(cols[i], cols[j], None if np.isnan(r[i, j]) else float(r[i, j])) for i, j in combinations(range(len(cols)), 2)]
    if min_abs is not None:
        rows = [x for x in rows if x[2] is not None and abs(x[2]) >= min_abs]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def corr_with_target(df: DataFrame, features, target: str, min_abs: float | None = 0.1) -> DataFrame:
    s = [F.struct(F.lit(c).alias("feature"),
                  safe_corr(F.col(q(c)).cast("double"), F.col(q(target)).cast("double")).alias("r"))
         for c in features]
    out = _long(df, s, "feature string, r double")
    return out.filter(F.abs("r") > min_abs) if min_abs is not None else out


def vif(df: DataFrame, cols, corr_threshold: float = 0.999) -> DataFrame:
    """Robust VIF: rows complete and finite in all cols; constant columns go, then the later of
    each pair with |r| >= threshold (exact duplicates are pairs with r = 1); <= 1 left -> empty."""
    cols = list(cols)
    finite = F.lit(True)
    for c in cols:
        x = F.col(q(c)).cast("double")
        finite = finite & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    r = gram(df.filter(finite), cols).pearson()
    left = [i for i in range(len(cols)) if not np.isnan(r[i, i])]
    gone = {j for i, j in combinations(left, 2) if abs(r[i, j]) >= corr_threshold}
    left = [i for i in left if i not in gone]
    rows = []
    if len(left) > 1:
        try:
            values = np.diag(np.linalg.inv(r[np.ix_(left, left)]))
        except np.linalg.LinAlgError:
            values = np.full(len(left), np.inf)
        rows = sorted(((cols[i], float(v)) for i, v in zip(left, values) if np.isfinite(v)), key=lambda t: -t[1])
    return df.sparkSession.createDataFrame(rows, "variable string, vif double")
