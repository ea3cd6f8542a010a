"""Session construction and lineage helpers.

Cluster rules followed here:
* the checkpoint folder is whatever the cluster names in ``spark.checkpoint.dir``;
  only when that is unset (local tests) do we create one of our own;
* lineage is cut by writing a table into the shared folder (reliable), never with
  ``localCheckpoint`` (lost with the executor).
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # keep broadcast decisions to sizes we have checked ourselves
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_session(app: str = "tessera", cpus: int | str | None = None,
                shuffle_partitions: int | None = None,
                driver_memory: str = "16g",
                extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster use the provided session."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(_DEFAULTS)
    conf["spark.driver.memory"] = driver_memory
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.  A private one is created only where the setting
    is missing AND the master is local (tests): on a cluster every executor would write to
    its own disk, so that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


_ROOTS: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A place in this application's own folder below the shared checkpoint folder; the
    folder is removed when the driver's interpreter ends."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{checkpoint_dir(spark).rstrip('/')}/tessera-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _ROOTS[app])
    return f"{_ROOTS[app]}/{name}"


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:          # stopped already: nothing of this application runs any more
        return
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back: the lineage is
    cut (survives executor loss, never recomputed), the data stay columnar and Catalyst
    keeps size statistics for join planning."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``cut_lineage`` that nothing will read any more, before the application ends."""
    for table in tables:
        _remove(table.sparkSession, table._tessera_path)


# intermediates persisted by operators whose lazy results still need them
_KEPT: list = []


def keep(df: DataFrame, level=None) -> DataFrame:
    """Persist an intermediate (memory, spilling to disk) and register it for ``release``.
    Lost blocks are recomputed from lineage, so this is safe under executor loss."""
    from pyspark import StorageLevel
    out = df.persist(level or StorageLevel.MEMORY_AND_DISK)
    _KEPT.append(out)
    return out


def release() -> int:
    """Unpersist every intermediate registered by ``keep`` (call once the results that
    depend on them have been written or collected).  Returns how many were released."""
    n = len(_KEPT)
    while _KEPT:
        _KEPT.pop().unpersist()
    return n
