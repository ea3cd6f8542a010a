"""k-NN queries (M8): embeddings split 80/20 per label (exact stratified split);
every test vector is classified by its 5 nearest training vectors (exact search in
cells, pruned by the triangle inequality)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import knn as K
from tessera.operators import split as SP
from tessera.plans.common import register
from tessera.plans.profiling import round_doubles
from tessera.sources.tables import load_table

_SQL = """WITH e AS (SELECT vec_id, embedding, label,
    row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), vec_id) AS rn,
    count(*) OVER (PARTITION BY label) AS nc FROM embeddings),
q AS (SELECT vec_id AS qid, embedding FROM e WHERE rn <= ceil(nc * 0.2)),
t AS (SELECT vec_id, embedding, label FROM e WHERE rn > ceil(nc * 0.2)),
d AS (SELECT q.qid, t.vec_id, t.label, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) AS d
      FROM q CROSS JOIN t),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM d),
nb AS (SELECT * FROM r WHERE rank <= 5)"""


def _split(spark, sf_dir):
    e = load_table(spark, sf_dir, "embeddings")
    s = SP.stratified_split(e, "label", "vec_id", test_frac=0.2, seed=42)
    return s.filter(F.col("split") == "test"), s.filter(F.col("split") == "train")


@register("knn_neighbors", _SQL + "\nSELECT qid, vec_id, label, round(d, 6) AS d, rank FROM nb")
def knn_neighbors(spark, sf_dir):
    q, t = _split(spark, sf_dir)
    nb = K.knn_search(q, t, k=5)
    return round_doubles(nb.select("qid", "vec_id", F.col("label").cast("int").alias("label"), "d",
                                   F.col("rank").cast("bigint").alias("rank")))


@register("knn_classify", _SQL + """,
z AS (SELECT qid, max(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS hz FROM nb GROUP BY qid),
s AS (SELECT nb.qid, label, sum(CASE WHEN z.hz = 1 THEN (CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 / d END) AS sc
      FROM nb JOIN z ON nb.qid = z.qid GROUP BY nb.qid, label),
w AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, label) AS rr FROM s)
SELECT qid, label AS prediction FROM w WHERE rr = 1""")
def knn_classify(spark, sf_dir):
    q, t = _split(spark, sf_dir)
    pred = K.knn_vote(K.knn_search(q, t, k=5))
    return pred.select("qid", F.col("prediction").cast("int").alias("prediction"))
