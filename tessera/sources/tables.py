"""Loader for the parquet test tables (one file per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


SPREAD_MIN_BYTES = 4 * 1024 * 1024


def spread(df: DataFrame, min_partitions: int | None = None, min_bytes: int | None = None) -> DataFrame:
    """Guard against under-split inputs (e.g. one large row group = one task): when the
    scan has fewer partitions than the cluster has cores AND is big enough for that to
    matter (Catalyst's size estimate >= ``spark.tessera.spreadMinBytes``, 4 MiB by
    default), spread it round-robin.  Below that size one task finishes in well under a
    second and a shuffle is pure overhead; at scale the scan already has far more
    splits than cores, so this is a no-op there too."""
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    floor = min_bytes if min_bytes is not None else int(spark.conf.get("spark.tessera.spreadMinBytes",
                                                                       str(SPREAD_MIN_BYTES)))
    if df.rdd.getNumPartitions() >= target:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(target) if size >= floor else df


def load_table(spark: SparkSession, sf_dir: str, name: str, min_partitions: int | None = None,
               spread_small: bool = True) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, min_partitions) if spread_small else df


def load_tables(spark: SparkSession, sf_dir: str, names=TABLES, views: bool = False) -> dict:
    out = {n: load_table(spark, sf_dir, n) for n in names}
    if views:
        for n, df in out.items():
            df.createOrReplaceTempView(n)
    return out
