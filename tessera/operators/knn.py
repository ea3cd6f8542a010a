"""Exact k-nearest neighbours (Euclidean), a vote, and a trainable model.

One plan for every size:

1. references are dealt to cells: ``ceil(rows / cell_rows)`` pivots, at most ``MAX_CELLS`` (the
   bound of what each task holds), are the references of least hash; every reference goes to its
   nearest pivot and each cell's radius is kept;
2. each query searches its nearest pivot's cell, which gives a first k-th distance r;
3. it then searches every other cell with d(query, pivot) - radius <= r: by the triangle
   inequality no other cell can hold a nearer reference;
4. inside a cell, blocks of queries meet blocks of references (``block_rows`` each), so neither a
   popular cell nor many queries of one cell land in one task; a block pair gives the k
   best per query only;
5. a window per query keeps the k best by (distance, id).

The kernel takes squared distances from matrix products in pieces of ``PIECE`` numbers, keeps what may
be among the k best with an allowance for rounding, and computes these few again directly.

Vote: weights 1/d (a neighbour at distance 0 shares all the weight) or equal weights; the class
with the largest weight wins, ties go to the smaller label.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.stored import Stored
from tessera.session import cut_lineage

MAX_CELLS, CELL_ROWS, BLOCK_ROWS = 4096, 4096, 4096
PIECE = 1 << 21
FOUND = "qid long, vec_id long, label long, d double"


def nearest(queries: np.ndarray, refs: np.ndarray, ids: np.ndarray, k: int):
    """(query position, reference position, distance) of the k best references by (distance,
    id) of each query; memory bounded by PIECE numbers."""
    k = min(k, len(refs))
    norm = (refs * refs).sum(axis=1)
    step = max(1, PIECE // max(1, len(refs)))
    for at in range(0, len(queries), step):
        q = queries[at:at + step]
        own = (q * q).sum(axis=1)
        square = own[:, None] + norm[None, :] - 2 * (q @ refs.T)
        allowance = 1e-12 * refs.shape[1] * (own + norm.max())
        kth = np.partition(square, k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero(square <= (kth + 2 * allowance)[:, None])
        d = np.sqrt(((q[row] - refs[col]) ** 2).sum(axis=1))
        order = np.lexsort((ids[col], d, row))
        row, col, d = row[order], col[order], d[order]
        first = np.searchsorted(row, np.arange(len(q)))
        best = np.arange(len(row)) - first[row] < k
        yield at + row[best], col[best], d[best]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _block(k: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, has = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if asks.empty or has.empty:
            return pd.DataFrame({"qid": [], "vec_id": [], "label": [], "d": []}).astype(
                {"qid": "int64", "vec_id": "int64", "label": "float64", "d": "float64"})
        ids, labels, qid = has["id"].to_numpy(np.int64), has["label"].to_numpy(), asks["id"].to_numpy(np.int64)
        parts = list(nearest(_matrix(asks["vec"]), _matrix(has["vec"]), ids, k))
        row, col, d = (np.concatenate(x) for x in zip(*parts))
        return pd.DataFrame({"qid": qid[row], "vec_id": ids[col], "label": labels[col], "d": d})
    return fn


def _search(requests: DataFrame, refs: DataFrame, k: int, block_rows: int) -> DataFrame:
    """FOUND for each request (qid, vec, cell) against the references (vec_id, vec, label,
    cell) of its cell, block by block."""
    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))

    shape = blocks(requests, "asking").join(blocks(refs, "having"), "cell")       # at most MAX_CELLS rows

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        return rows.join(F.broadcast(shape), "cell").withColumn(own, F.pmod(F.xxhash64(key), F.col(own)).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    asks = dealt(requests.withColumn("label", F.lit(None).cast("long")), "qid", "asking", "having") \
        .select("cell", "asking", "having", F.col("qid").alias("id"), "vec", "label", F.lit(True).alias("asks"))
    has = dealt(refs, "vec_id", "having", "asking") \
        .select("cell", "asking", "having", F.col("vec_id").alias("id"), "vec", "label", F.lit(False).alias("asks"))
    return asks.unionByName(has).groupBy("cell", "asking", "having").applyInPandas(_block(k), FOUND)


def _to_pivots(pivots: np.ndarray, vec: pd.Series) -> np.ndarray:
    x = _matrix(vec)
    out = np.empty((len(x), len(pivots)))
    for at in range(0, len(x), 512):
        part = x[at:at + 512]
        square = (part * part).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (part @ pivots.T)
        out[at:at + 512] = np.sqrt(np.maximum(square, 0))
    return out


def _own_cell(pivots: np.ndarray, columns: list[str]):
    def fn(batches):
        for pdf in batches:
            step = max(1, PIECE // len(pivots))
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at:at + step]
                far = _to_pivots(pivots, part["vec"])
                own = far.argmin(axis=1)
                yield part[columns].assign(cell=own.astype(np.int32), far=far[np.arange(len(own)), own])
    return fn


def _other_cells(pivots: np.ndarray, radius: np.ndarray):
    def fn(batches):
        for pdf in batches:
            step = max(1, PIECE // len(pivots))
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at:at + step]
                far = _to_pivots(pivots, part["vec"])
                own = part["cell"].to_numpy()
                # an allowance for the rounding of distances by matrix products
                slack = 1e-6 * (1 + far + np.where(np.isfinite(radius), radius, 0)[None, :])
                hit = far - radius[None, :] <= part["r"].to_numpy(np.float64)[:, None] + slack
                hit[np.arange(len(own)), own] = False
                row, cell = np.nonzero(hit)
                qid, vec = part["qid"].to_numpy(np.int64), part["vec"].to_numpy()
                # a query that many cells may answer has its vector once for each: handed on in pieces
                size = max(1, PIECE // (2 * pivots.shape[1]))
                for i in range(0, len(row), size):
                    one = row[i:i + size]
                    yield pd.DataFrame({"qid": qid[one], "cell": cell[i:i + size].astype(np.int32), "vec": vec[one]})
    return fn


def knn_search(queries: DataFrame, refs: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
               label_col: str = "label", cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, seed: int = 42) -> DataFrame:
    """(qid, vec_id, label, d, rank) for the k nearest references of every query."""
    r = refs.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"),
                    F.col(label_col).cast("long").alias("label"))
    q = queries.select(F.col(id_col).cast("long").alias("qid"), F.col(vec_col).cast("array<double>").alias("vec"))
    cells = max(1, min(MAX_CELLS, math.ceil(r.count() / cell_rows)))
    chosen = r.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(cells).collect()      # at most MAX_CELLS
    if not chosen:
        return q.sparkSession.createDataFrame([], FOUND + ", rank int")
    pivots = np.array([x["vec"] for x in chosen], dtype=np.float64)
    placed = cut_lineage(r.mapInPandas(_own_cell(pivots, ["vec_id", "vec", "label"]),
                                       "vec_id long, vec array<double>, label long, cell int, far double"), "knn_refs")
    radius = np.full(len(pivots), -np.inf)
    for x in placed.groupBy("cell").agg(F.max("far").alias("far")).collect():
        radius[x["cell"]] = x["far"]
    asked = cut_lineage(q.mapInPandas(_own_cell(pivots, ["qid", "vec"]), "qid long, vec array<double>, cell int, far double"),
                        "knn_queries")
    best = Window.partitionBy("qid").orderBy("d", "vec_id")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    own = _search(asked.select("qid", "vec", "cell"), placed, k, block_rows)
    if len(pivots) == 1:
        return top(own)
    own = cut_lineage(top(own).drop("rank"), "knn_own")
    reach = own.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).alias("r"))
    more = asked.join(reach, "qid", "left").withColumn("r", F.coalesce("r", F.lit(float("inf")))) \
        .mapInPandas(_other_cells(pivots, radius), "qid long, cell int, vec array<double>")
    return top(own.unionByName(_search(more, placed, k, block_rows)))


def _weights(neighbors: DataFrame, weights: str) -> DataFrame:
    if weights == "uniform":
        return neighbors.withColumn("w", F.lit(1.0))
    if weights != "distance":
        raise ValueError(f"unknown weights {weights!r}")
    zero = F.max((F.col("d") == 0).cast("int")).over(Window.partitionBy("qid"))
    return neighbors.withColumn("w", F.when(zero == 1, (F.col("d") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("d"))))


def knn_vote(neighbors: DataFrame, weights: str = "distance") -> DataFrame:
    """(qid, prediction): the class with the largest weight, ties to the smaller label."""
    scores = _weights(neighbors, weights).groupBy("qid", "label").agg(F.sum("w").alias("s"))
    return scores.groupBy("qid").agg(F.max(F.struct("s", (-F.col("label")).alias("l"))).alias("top")) \
        .select("qid", (-F.col("top.l")).alias("prediction"))


class KnnModel(Stored):
    """k-NN classifier over a stored table of references: standardised feature vectors and 0/1 labels.
    ``prob`` is the weight share of label 1 among the k nearest references."""

    def __init__(self, features=(), mean=(), std=(), k: int = 5, weights: str = "distance"):
        super().__init__()
        self.features, self.mean, self.std = list(features), list(mean), list(std)
        self.k, self.weights = int(k), weights
        self.references: DataFrame | None = None

    def state(self) -> dict:
        return {"features": self.features, "mean": self.mean, "std": self.std, "k": self.k, "weights": self.weights}

    def tables(self) -> dict[str, DataFrame]:
        return {"references": self.references}

    def attach(self, tables: dict[str, DataFrame]) -> None:
        self.references = tables["references"]

    def _vector(self):
        return F.array(*[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s)
                         for c, m, s in zip(self.features, self.mean, self.std)])

    @classmethod
    def fit(cls, train: DataFrame, features, label: str = "label", k: int = 5, weights: str = "distance",
            scale: bool = True) -> KnnModel:
        mean, std = [0.0] * len(features), [1.0] * len(features)
        if scale:
            row = train.agg(*[f(F.col(c).cast("double")) for c in features for f in (F.avg, F.stddev_samp)]).first()
            mean, std = [float(v or 0.0) for v in row[0::2]], [float(v or 0.0) or 1.0 for v in row[1::2]]
        model = cls(features, mean, std, k, weights)
        model.references = cut_lineage(train.select(F.monotonically_increasing_id().alias("vec_id"), model._vector().alias("vec"),
                                                    F.col(label).cast("long").alias("label")), "references")
        return model

    def with_vote(self, k: int, weights: str) -> KnnModel:
        """The same references with another vote."""
        other = KnnModel(self.features, self.mean, self.std, k, weights)
        other.references = self.references
        return other

    def neighbors(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows, numbered, and the k nearest references of each: both written once, and enough for
        the votes of every model of these references with k as large or smaller."""
        # rows get numbers that stay the same however often a task is run
        rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()), "knn_rows")
        near = knn_search(rows.select(F.col("_row").alias("vec_id"), self._vector().alias("vec")),
                          self.references, self.k, vec_col="vec")
        return rows, cut_lineage(near.select("qid", "label", "d", "rank"), "knn_near")

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.voted(*self.neighbors(df))

    def voted(self, rows: DataFrame, near: DataFrame) -> DataFrame:
        votes = _weights(near.filter(F.col("rank") <= self.k), self.weights).groupBy("qid") \
            .agg(F.try_divide(F.sum(F.when(F.col("label") == 1, F.col("w")).otherwise(0.0)), F.sum("w")).alias("prob")) \
            .withColumnRenamed("qid", "_row")
        return rows.join(votes, "_row").drop("_row").withColumn("prediction", (F.col("prob") > 0.5).cast("int"))


__all__ = ["knn_search", "knn_vote", "KnnModel", "nearest"]
