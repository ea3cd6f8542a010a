"""Embedding whitening (operator 12): Chebyshev-filtered subspace iteration.

Entries c become integers x = floor(1024 * c) + 100000.  Wanted are the leading eigenvectors of
the covariance V of all x (divisor n); V is never formed.  One pass multiplies it by a block Q of
a few columns: every task adds up (x - m)' ((x - m) Q) of its rows, centred before multiplying,
and the tasks' small sums are added on an executor.

1. n, exact sums S per dimension and the trace;
2. ``BOUNDS`` passes of the Lanczos recurrence from a random vector bound the spectrum;
3. cycles on a block of k + ``GUARD`` columns.  A cycle damps the unwanted part of the spectrum,
   from its lower bound to the least Ritz value, by a Chebyshev polynomial of V (one pass per
   degree, three-term recurrence scaled so that nothing overflows), then QR, one pass V Q and
   Rayleigh-Ritz on the small Q' V Q.  The polynomial raises the largest eigenvalue above the others
   by ``RANGE`` at most, or the others' digits would be lost in it: where an eigenvalue stands far
   out the degree is less until its vector is found (residual ``HELD``), which then is held as it is
   while the others are filtered at right angles to it;
4. certificate: the k residuals |V q - e q| are within ``TOLERANCE`` of the largest eigenvalue, or
   have stopped falling below ``FLOOR`` of it; then fresh random columns, filtered in the same way
   and kept orthogonal to the block, must hold no Ritz value above the k-th (a direction that the
   start had missed would be there).  If they do, the block takes them in and goes on;
5. one pass over the whitened rows gives the largest deviation of their covariance from the
   identity.

With the m-th degree the wanted part gains a factor T_m over the damped part, so passes grow with
the logarithm of the accuracy and the root of the relative gap, not with rows.  Each pass reads
one compact table in the shared folder; a lost task is run again alone.

Unusable rows: vector NULL, an entry NULL, not finite or too large for a long, or a length other
than the commonest one (of equal counts the longer).  No usable row, or vectors of no
entries: no rows.  An eigenvalue that is zero to double precision (constant tables, fewer rows than
components) has no whitened coordinate: such components are left out.  ``deviation`` is NULL
where it exceeds a long.  Repeated rows and NULL ids are rows like any others; columns other than
vec_id and embedding are ignored, whatever their names.
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

from tessera.session import cut_lineage

COMPONENTS, GUARD, PROBES = 8, 12, 4
BOUNDS, DEGREE, CYCLES = 10, 10, 40
TOLERANCE, FLOOR = 2e-14, 1e-10
RANGE, HELD = 1e8, 2e-13
PIECE = 16384
LARGEST = float(1 << 52)


def integers(table: DataFrame) -> DataFrame:
    """(vec_id, x) of the usable rows of ``table`` (vec_id, embedding)."""
    def fits(c):
        c = c.cast("double")
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) * 1024 < LARGEST)

    rows = table.select("vec_id", "embedding").filter("embedding is not null").filter(F.forall("embedding", fits))
    length = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = length["d"] if length else 0
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * 1024).cast("long") + 100000)
    return rows.filter((F.size("embedding") == d) & (F.size("embedding") > 0)).select("vec_id", x.alias("x"))


def _pieces(batches: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            piece = batch.slice(at, PIECE)
            yield piece, piece.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass
class Moments:
    """Rows, exact sums, and the mean as an integer part and a rest (so that no digit of
    x - S/n is lost to the size of x)."""
    n: int
    sums: list[int]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([(s % self.n) / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest


def moments(rows: DataFrame) -> Moments:
    """Exact sums: high and low halves of the integers are added apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, None, None
        for batch in batches:
            if batch.num_rows:
                for _, x in _pieces([batch], 0, len(batch.column(0)[0])):
                    n += len(x)
                    high = (0 if high is None else high) + (x >> 24).sum(axis=0)
                    low = (0 if low is None else low) + (x & 0xFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high))), pa.array(np.full(len(high), n)), pa.array(high), pa.array(low)],
                                             names=["dim", "n", "high", "low"])

    wide = "decimal(38,0)"
    sums = rows.select("x").mapInArrow(run, "dim long, n long, high long, low long").groupBy("dim") \
        .agg(F.sum("n").alias("n"), F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low")).collect()
    sums.sort(key=lambda r: r["dim"])
    return Moments(sums[0]["n"] if sums else 0, [(int(r["high"]) << 24) + int(r["low"]) for r in sums])


def _total(rows: DataFrame, size: int, of_piece) -> np.ndarray:
    """Sum over all rows of ``of_piece(x)``, ``size`` numbers: one array a task, added up by
    Spark, one array to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                for _, x in _pieces([batch], 0, len(batch.column(0)[0])):
                    part = of_piece(x)
                    total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1)], pa.list_(pa.float64()))], names=["part"])

    parts = rows.select("x").mapInArrow(run, "part array<double>")
    return parts.agg(Summarizer.sum(array_to_vector("part")).alias("total")).first()["total"].toArray()[:size]


def product(rows: DataFrame, at: Moments, q: np.ndarray) -> np.ndarray:
    """V Q in one pass."""
    def part(x: np.ndarray) -> np.ndarray:
        c = at.centred(x)
        return c.T @ (c @ q)
    return _total(rows, q.size, part).reshape(q.shape) / at.n


def trace(rows: DataFrame, at: Moments) -> float:
    return float(_total(rows, 1, lambda x: np.array([(at.centred(x) ** 2).sum()]))[0]) / at.n


def spectrum_bounds(times, d: int, rng: np.random.Generator) -> tuple[float, float]:
    """(lower, upper) bound by Lanczos: the extreme Ritz values, moved out by the last
    remainder, which bounds how far they are from the spectrum's ends."""
    basis = np.zeros((d, 0))
    v = rng.normal(size=d)
    diagonal, off = [], []
    for _ in range(min(BOUNDS, d)):
        v = v / np.linalg.norm(v)
        basis = np.column_stack([basis, v])
        w = times(v[:, None])[:, 0]
        diagonal.append(float(v @ w))
        for _ in range(2):
            w = w - basis @ (basis.T @ w)
        off.append(float(np.linalg.norm(w)))
        if off[-1] <= 1e-12 * max(abs(x) for x in diagonal + [1e-300]):
            off[-1] = 0.0 if len(diagonal) == d else off[-1]
            break
        v = w
    t = np.diag(diagonal) + np.diag(off[:-1], 1) + np.diag(off[:-1], -1)
    ritz = np.linalg.eigvalsh(t)
    return max(0.0, float(ritz[0]) - off[-1]), float(ritz[-1]) + off[-1]


def chebyshev(times, q: np.ndarray, first: np.ndarray, low: float, cut: float, top: float, degree: int,
              within=lambda p: p) -> np.ndarray:
    """The polynomial of the given degree of V times Q: at most 1 on [low, cut], steeply growing
    above, scaled to 1 at ``top``.  ``first`` is V Q.  ``within`` keeps the columns in their space."""
    centre, half = (low + cut) / 2, (cut - low) / 2
    scale = half / (top - centre)
    now, before = (first - centre * q) * (scale / half), q
    step = scale
    for _ in range(1, degree):
        following = 1 / (2 / scale - step)
        now, before = within((times(now) - centre * now) * (2 * following / half) - (step * following) * before), now
        step = following
    return now


def degree_for(value: float, low: float, cut: float) -> int:
    """The degree at which the polynomial is ``RANGE`` at ``value``, from 1 to ``DEGREE``."""
    far = (value - (low + cut) / 2) / ((cut - low) / 2)
    return DEGREE if far <= 1 else int(min(DEGREE, max(1, np.log(2 * RANGE) // np.arccosh(far))))


@dataclass
class Components:
    """Eigenvalues by fall, unit eigenvectors (columns), and the residuals and passes behind them."""
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int


def leading(times, d: int, k: int = COMPONENTS, guard: int = GUARD, seed: int = 12) -> Components:
    """Leading eigenpairs of the symmetric positive matrix behind ``times`` (Q to V Q)."""
    rng = np.random.default_rng(seed)
    passes = [0]

    def counted(q: np.ndarray) -> np.ndarray:
        passes[0] += 1
        return times(q)

    def ritz(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vq = counted(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        turn = turn[:, ::-1]
        return values[::-1], q @ turn, vq @ turn

    k = min(k, d)
    size = min(d, k + guard)
    low, top = spectrum_bounds(counted, d, rng) if size < d else (0.0, 0.0)
    values, q, vq = ritz(np.linalg.qr(rng.normal(size=(d, size)))[0])
    if values[0] <= 0:
        return Components(np.zeros(k), q[:, :k], np.zeros(k), passes[0])
    last, proved = np.inf, size == d
    for _ in range(CYCLES):
        residual = np.linalg.norm(vq[:, :k] - q[:, :k] * values[:k], axis=0)
        worst = residual.max() / values[0]
        if worst <= TOLERANCE or (worst <= FLOOR and worst > 0.3 * last):
            if proved:
                return Components(values[:k], q[:, :k], residual, passes[0])
            probe = rng.normal(size=(d, min(PROBES, d - size)))
            out = lambda p: p - q @ (q.T @ p)
            probe = out(out(probe))
            probe = chebyshev(lambda p: out(counted(p)), probe, out(counted(probe)), low, max(values[-1], low + 1e-9 * top), top, DEGREE, out)
            probe = np.linalg.qr(out(probe))[0]
            found = np.linalg.eigvalsh(probe.T @ counted(probe)).max()
            if found <= values[k - 1] * (1 + 1e-9):
                return Components(values[:k], q[:, :k], residual, passes[0])
            values, q, vq = ritz(np.linalg.qr(np.column_stack([q, probe]))[0])
            size, last = q.shape[1], np.inf
            proved = size == d
            continue
        last = worst
        if size == d:
            values, q, vq = ritz(np.linalg.qr(q)[0])
            continue
        cut = max(float(values[-1]), low + 1e-9 * top)
        top = max(top, float(values[0]) * (1 + 1e-9))
        held = 0
        while held < k and residual[held] <= HELD * values[0] and degree_for(values[held], low, cut) < DEGREE:
            held += 1
        known = q[:, :held]
        away = lambda p: p - known @ (known.T @ p)
        rest = chebyshev(lambda p: away(counted(p)), q[:, held:], away(vq[:, held:]), low, cut, max(float(values[held]), cut) if held else top,
                         degree_for(values[held], low, cut), away)
        values, q, vq = ritz(np.linalg.qr(np.column_stack([known, rest]))[0])
    raise ArithmeticError(f"no convergence in {CYCLES} cycles: residual {worst:.1e} of the largest eigenvalue")


def whitened(table: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable
    row and each of the k leading components (all that there are, if fewer)."""
    spark = table.sparkSession
    kind = table.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = cut_lineage(integers(table), "integers")
    at = moments(rows)
    d = len(at.sums)
    whole = trace(rows, at) if at.n else 0.0
    if whole <= 0:
        return spark.createDataFrame([], schema)
    found = leading(lambda q: product(rows, at, q), d, k)
    real = found.values > 1e-13 * whole
    values, vectors = found.values[real], found.vectors[:, real]
    m = len(values)
    scaled = vectors / np.sqrt(values)

    def gram(x: np.ndarray) -> np.ndarray:
        w = at.centred(x) @ scaled
        return np.append((w.T @ w).reshape(-1), w.sum(axis=0))

    sums = _total(rows, m * m + m, gram) / at.n
    covariance = sums[:m * m].reshape(m, m) - np.outer(sums[m * m:], sums[m * m:])
    error = float(np.abs(covariance - np.eye(m)).max())
    n, total, explained = at.n, np.array(at.sums, dtype=object), values / whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _pieces(batches, 1, d):
            w = at.centred(x) @ scaled
            far = float(np.abs(at.centred(x)).max()) * n * 1.01 + 1
            if n * 1.01 * (float(np.abs(x).max()) + 1) < 2 ** 62 and d * far ** 2 < 2 ** 62:
                gap = n * x - total.astype(np.int64)
                deviation = pa.array((gap * gap).sum(axis=1))
            else:
                exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, at.sums)) for row in x]
                deviation = pa.array([e if e < 2 ** 63 else None for e in exact], pa.int64())
            times = np.repeat(np.arange(len(x)), m)
            yield pa.RecordBatch.from_arrays([
                piece.column(0).take(pa.array(times)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(times), n)), deviation.take(pa.array(times)), pa.array(w.reshape(-1)),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(len(times), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
