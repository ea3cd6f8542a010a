"""Deterministic train/test splits.

Row order inside each class is fixed by ``md5(key:seed)`` (then the key), so the
split does not depend on partitioning, task order or retries.

* ``stratified_split`` (exact): the first ceil(n_c * frac) rows of each class in
  hash order are test.  Rows are counted in fixed buckets floor(u * B) of the hash uniform u -
  balanced by construction whatever the key or class skew - and only the bucket in which a
  class's quota ends is put in order: neither rows nor keys are shuffled but those.
* ``hash_split`` (approximate, no shuffle): u < frac.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import q
from tessera.functions.values import md5_key, uniform01
from tessera.operators.rank import join_null_safe, ordered_prefix
from tessera.session import cut_lineage


#: buckets of the hash in which a split's rows are counted
CUT_BUCKETS = 4096


def class_counts(df: DataFrame, label: str, max_classes: int = 10000) -> dict:
    rows = df.groupBy(F.col(q(label)).alias("c")).agg(F.count(F.lit(1)).alias("n")).limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"{label} has more than {max_classes} classes")
    return {r["c"]: r["n"] for r in rows}


def stratified_split(df: DataFrame, label: str | None, key: str, test_frac: float = 0.2, seed: int = 42,
                     buckets: int | None = None, out: str = "split") -> DataFrame:
    """``df`` with ``out``: "test" for the first ceil(n_c * frac) rows of each class in hash order of
    ``key`` (a class of NULL is one too), else "train".  Only (class, hash, key) of one bucket a class is
    ordered, to find each class's cut; the rows themselves are compared with the cut where
    they are.  Rows that share a key fall on the same side."""
    if not 0 < test_frac < 1:
        raise ValueError("test_frac must be in (0, 1)")
    buckets = buckets or CUT_BUCKETS
    lab = F.col(q(label)) if label else F.lit(0)
    tagged = df.withColumns({"_lab": lab, "_at": F.struct(uniform01(F.col(q(key)), seed).alias("u"), md5_key(F.col(q(key)), seed).alias("h"),
                                                          F.col(q(key)).alias("k"))})
    slim = tagged.select("_lab", "_at", F.least(F.lit(buckets - 1), F.floor(F.col("_at.u") * buckets).cast("int")).alias("_b"))
    upto = Window.partitionBy("_lab").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)      # classes x buckets rows
    counted = slim.groupBy("_lab", "_b").agg(F.count(F.lit(1)).alias("_n")) \
        .withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy("_lab"))}) \
        .withColumn("_quota", F.ceil(F.col("_all") * F.lit(float(test_frac))))
    last = counted.filter((F.col("_quota") <= F.col("_upto")) & (F.col("_quota") > F.col("_upto") - F.col("_n"))) \
        .select("_lab", "_b", (F.col("_quota") - (F.col("_upto") - F.col("_n"))).alias("_place"))
    near = join_null_safe(slim, cut_lineage(last, "split_buckets"), ["_lab", "_b"])                 # one bucket per class
    cut = near.withColumn("_no", F.row_number().over(Window.partitionBy("_lab").orderBy("_at"))) \
        .filter(F.col("_no") == F.col("_place")).select("_lab", F.col("_at").alias("_cut"))
    split = join_null_safe(tagged, cut_lineage(cut, "split_cuts"), ["_lab"])                # one row per class
    return split.withColumn(out, F.when(F.col("_at") <= F.col("_cut"), F.lit("test")).otherwise(F.lit("train"))).drop("_lab", "_at", "_cut")


def hash_split(df: DataFrame, key: str, test_frac: float = 0.2, seed: int = 42, out: str = "split") -> DataFrame:
    return df.withColumn(out, F.when(uniform01(F.col(q(key)), seed) < test_frac, "test").otherwise("train"))


def fold_ids(df: DataFrame, key: str, label: str | None, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Stratified k-fold ids: position of the row in (class, hash) order modulo k -
    each class spread evenly over the folds."""
    spark = df.sparkSession
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    lab = F.col(q(label)) if label else F.lit(0)
    tagged = df.withColumns({"_u": uniform01(F.col(q(key)), seed), "_h": md5_key(F.col(q(key)), seed),
                             "_lab": lab, "_one": F.lit(1)})
    tagged = tagged.withColumn("_b", F.least(F.lit(buckets - 1), F.floor(F.col("_u") * buckets).cast("int")))
    pos = ordered_prefix(tagged, "_u", ["_one"], by=["_lab"], tiebreak=["_h", key], bucket_col="_b")
    return pos.withColumn(out, (F.col("_one_before") % k).cast("int")).drop("_u", "_h", "_lab", "_one", "_b",
                                                                           "_one_before")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c): (class, n, weight)."""
    c = df.groupBy(F.col(q(label)).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").cast("double").alias("_n"), F.count(F.lit(1)).cast("double").alias("_k"))
    return c.crossJoin(F.broadcast(total)).select("class", "n", (F.col("_n") / (F.col("_k") * F.col("n"))).alias("weight"))      # one row


def with_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    counts = class_counts(df, label)
    n, k = sum(counts.values()), len(counts)
    m = F.create_map(*[x for c, nc in counts.items() for x in (F.lit(c), F.lit(n / (k * nc)))])
    return df.withColumn(out, m[F.col(q(label))])
