import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import knn as K
from tessera.operators import split as SP


def test_stratified_split_exact_counts_and_invariance(spark):
    rows = [(i, "A" if i % 10 < 7 else ("B" if i % 10 < 9 else "C")) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, c string")
    a = SP.stratified_split(df.repartition(3), "c", "k", 0.2, seed=5)
    b = SP.stratified_split(df.repartition(11), "c", "k", 0.2, seed=5, buckets=7)
    ta = {r.k for r in a.filter(F.col("split") == "test").select("k").collect()}
    tb = {r.k for r in b.filter(F.col("split") == "test").select("k").collect()}
    assert ta == tb
    counts = {r.c: r["count"] for r in a.filter(F.col("split") == "test").groupBy("c").count().collect()}
    assert counts == {"A": math.ceil(1400 * 0.2), "B": math.ceil(400 * 0.2), "C": math.ceil(200 * 0.2)}


def test_fold_ids_balanced(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(100)], "k long, y int")
    f = SP.fold_ids(df, "k", "y", k=5)
    sizes = sorted(r["count"] for r in f.groupBy("fold", "y").count().collect())
    assert sizes == [10] * 10


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(300, 8)).astype(np.float32)
    X[5] = X[6]                                  # a zero-distance neighbour
    lab = rng.integers(0, 3, 300)
    rows = [(i, X[i].tolist(), int(lab[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    q = df.filter(F.col("vec_id") < 60)
    t = df.filter(F.col("vec_id") >= 6)
    nb = K.knn_search(q, t, k=4, block_rows=50).toPandas()   # several blocks on both sides
    Q, T = X[:60].astype(np.float64), X[6:].astype(np.float64)
    D = np.sqrt(((Q[:, None, :] - T[None, :, :]) ** 2).sum(-1))
    for qi in range(60):
        order = sorted(range(T.shape[0]), key=lambda j: (D[qi, j], j + 6))[:4]
        got = nb[nb.qid == qi].sort_values("rank")
        assert list(got.vec_id) == [j + 6 for j in order]
        assert np.allclose(got.d, [D[qi, j] for j in order])
    pred = {r.qid: r.prediction for r in K.knn_vote(spark.createDataFrame(nb)).collect()}
    assert pred[5] == int(lab[6])              # the zero-distance neighbour takes all the weight


def test_knn_same_for_any_cells_and_blocks(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(scale=6.0, size=(6, 8))
    X = (centers[rng.integers(0, 6, 600)] + rng.normal(size=(600, 8))).astype(np.float32)
    lab = rng.integers(0, 4, 600)
    df = spark.createDataFrame([(i, X[i].tolist(), int(lab[i])) for i in range(600)],
                               "vec_id long, embedding array<float>, label int")
    q, t = df.filter(F.col("vec_id") % 5 == 0), df.filter(F.col("vec_id") % 5 != 0)
    a = K.knn_search(q, t, k=5).select("qid", "vec_id", "rank").toPandas()
    b = K.knn_search(q, t, k=5, cell_rows=60, block_rows=40).select("qid", "vec_id", "rank").toPandas()
    key = ["qid", "rank"]
    assert a.sort_values(key).reset_index(drop=True).equals(b.sort_values(key).reset_index(drop=True))
