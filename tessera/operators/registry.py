"""Stored model registry: run tables and saved models under one folder.

A run is published as an immutable folder ``runs/<run_id>/attempt-<random>`` that holds the run's
records (parquet) and the models it saves, and becomes visible when the marker
``runs/<run_id>/committed.json`` is created, which names the attempt.  So

* a job that dies half-way leaves an attempt that nobody sees;
* a job that is run again under the same ``run_id`` adds nothing once its run is committed;
* writers of different runs never touch the same file, and of two writers of one run the first to
  create the marker wins (the file is created only where there is none).

"Latest" and "champion" are queries over the visible records, never a file that the last writer
overwrites.  All paths go through Hadoop file systems, so the folder can be in any shared store.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.stored import load_model, save_model

RECORD = ("trial_no int, algorithm string, params string, accuracy double, precision double, recall double, f1_score double, "
          "roc_auc double, log_loss double, scoring string, score double")


class Registry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _place(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def committed(self, run_id: str) -> bool:
        fs, marker = self._place(f"{self.root}/runs/{run_id}/committed.json")
        return fs.exists(marker)

    def publish(self, run_id: str, records: DataFrame, models: dict | None = None, meta: dict | None = None) -> bool:
        """Store the run's records and models ({trial_no: model}); False if the run was there
        already.  ``meta``: values for every record (feature names, seed, data path ...)."""
        if not run_id or any(c in run_id for c in "/*?[]{}\\"):
            raise ValueError(f"not a run id: {run_id!r}")
        if self.committed(run_id):
            return False
        attempt = f"attempt-{uuid.uuid4().hex}"
        home = f"{self.root}/runs/{run_id}/{attempt}"
        paths = {n: save_model(m, f"{home}/models/{n}") for n, m in (models or {}).items()}
        path = F.lit(None).cast("string")
        for n, p in paths.items():
            path = F.when(F.col("trial_no") == n, F.lit(p)).otherwise(path)
        records.select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("registered_at"), "*", path.alias("model_path"),
                       F.lit(json.dumps(meta or {}, sort_keys=True)).alias("meta")).write.parquet(f"{home}/records")
        return self._commit(run_id, attempt)

    def _commit(self, run_id: str, attempt: str) -> bool:
        fs, marker = self._place(f"{self.root}/runs/{run_id}/committed.json")
        try:
            out = fs.create(marker, False)
        except Exception as error:
            if fs.exists(marker):          # another writer of this run was first
                return False
            raise error
        out.write(bytearray(json.dumps({"run_id": run_id, "attempt": attempt}).encode()))
        out.close()
        return True

    def runs(self) -> DataFrame | None:
        """Records of all visible runs; None before the first one."""
        try:
            marks = self.spark.read.json(f"{self.root}/runs/*/committed.json", schema="run_id string, attempt string").collect()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise
        folders = sorted(f"{self.root}/runs/{m['run_id']}/{m['attempt']}/records" for m in marks if m["attempt"])
        return self.spark.read.option("mergeSchema", "true").parquet(*folders) if folders else None

    def champions(self) -> DataFrame:
        """Best record of each algorithm: highest score, then the latest registration, then
        run and trial."""
        best = Window.partitionBy("algorithm").orderBy(F.desc("score"), F.desc("registered_at"), "run_id", "trial_no")
        return self.runs().withColumn("_r", F.row_number().over(best)).filter(F.col("_r") == 1).drop("_r")

    def champion(self) -> dict:
        """The best record that has a saved model, with its meta data."""
        row = self.runs().filter("model_path is not null").orderBy(F.desc("score"), F.desc("registered_at"), "run_id", "trial_no").first()
        if row is None:
            raise LookupError(f"no saved model in {self.root}")
        return {**row.asDict(), **json.loads(row["meta"])}

    def load(self, record: dict):
        return load_model(self.spark, record["model_path"])
