"""Masked Gram matrices: all second moments of many columns in one pass.

With X the values (NULL and NaN as 0, taken off a pivot per column) and M the masks (1 where there is a
value), one pass adds up, per pair of column blocks,

    X'X     sums of products over rows where both have a value
    X'M     sums of the first column over rows where the second has a value
    (X*X)'M sums of its squares over those rows
    M'M     the numbers of those rows

so Pearson coefficients over pairwise complete rows, covariances and duplicates all come out of p x p
numbers.  A task holds one Arrow batch and its block sums; Spark adds the tasks' sums, one
group per pair of blocks of ``BLOCK`` columns.  Pivots are the columns' means (a pass of plain
aggregates), so the products lose no digits to a large mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import q

BLOCK = 96
#: a variance below this share of the mean square is rounding
TINY = 1e-13


@dataclass
class Gram:
    """``n[i, j]`` rows with both values; ``x[i, j]``, ``xx[i, j]`` sums of column i and its square over them
    (off its pivot); ``xy[i, j]`` sums of products."""
    columns: list[str]
    pivot: np.ndarray
    n: np.ndarray
    x: np.ndarray
    xx: np.ndarray
    xy: np.ndarray

    def spread(self) -> np.ndarray:
        """[i, j]: sum of squares of column i about its mean over the rows that j has too; 0 for
        constants."""
        with np.errstate(invalid="ignore", divide="ignore"):
            s = self.xx - self.x ** 2 / self.n
        return np.where((self.n > 0) & (s > TINY * self.xx), s, 0.0)

    def pearson(self) -> np.ndarray:
        """r over pairwise complete rows; NaN where a column does not vary there."""
        with np.errstate(invalid="ignore", divide="ignore"):
            s = self.spread()
            r = (self.xy - self.x * self.x.T / self.n) / np.sqrt(s * s.T)
        return np.where((s > 0) & (s.T > 0), np.clip(r, -1.0, 1.0), np.nan)

    def covariance(self, ddof: int = 1) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return (self.xy - self.x * self.x.T / self.n) / (self.n - ddof)

    def means(self) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.pivot + np.diag(self.x) / np.diag(self.n)

    def same_mask(self) -> np.ndarray:
        """[i, j]: columns i and j have values in the same rows."""
        own = np.diag(self.n)
        return (self.n == own[:, None]) & (self.n == own[None, :])


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]) if batch.num_rows else \
        np.zeros((0, batch.num_columns))


def _blocks(pivot: np.ndarray):
    p = len(pivot)
    cuts = list(range(0, p, BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            v = _values(batch)
            has = ~np.isnan(v)
            x, m = np.where(has, v - pivot, 0.0), has.astype(np.float64)
            for i in cuts:
                a, am = x[:, i:i + BLOCK], m[:, i:i + BLOCK]
                for j in cuts:
                    b, bm = x[:, j:j + BLOCK], m[:, j:j + BLOCK]
                    part = np.stack([a.T @ b, a.T @ bm, (a * a).T @ bm, am.T @ bm])
                    sums[i, j] = part if (i, j) not in sums else sums[i, j] + part
        for (i, j), part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()),
                                              pa.array([part.reshape(-1)], pa.list_(pa.float64()))], names=["i", "j", "part"])
    return run


def gram(df: DataFrame, cols) -> Gram:
    """Masked Gram matrices of the columns, NaN counting as no value."""
    cols = list(cols)
    value = [F.nanvl(F.col(q(c)).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)]
    rows = df.select(*value)
    row = rows.agg(*[F.avg(f"c{i}") for i in range(len(cols))]).first()
    pivot = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in row], dtype=np.float64)
    parts = rows.mapInArrow(_blocks(pivot), "i int, j int, part array<double>").groupBy("i", "j") \
        .agg(Summarizer.sum(array_to_vector("part")).alias("part")).collect()
    p = len(cols)
    out = np.zeros((4, p, p))
    for r in parts:
        i, j = r["i"], r["j"]
        block = out[:, i:i + BLOCK, j:j + BLOCK]
        block[:] = r["part"].toArray().reshape(block.shape)
    xy, x, xx, n = out
    return Gram(cols, pivot, np.rint(n), x, xx, xy)
