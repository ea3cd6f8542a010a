"""Structured Streaming jobs.

* ``score_stream``: continuous batch scoring - every micro-batch of new rows goes
  through the same ``score_batch`` projection (stateless, no shuffle).
* ``monitor_stream``: event-time tumbling windows of model metrics with a
  watermark bounding late data; append mode emits each window once, when the
  watermark closes it, and state for closed windows is dropped.

``run_available_now`` drives a query over everything available, then stops
(``Trigger.AvailableNow``), with the checkpoint in the shared folder so a restarted
job resumes exactly where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.metrics import binned_counts, binned_metrics
from tessera.operators.scoring import score_batch
from tessera.session import scratch_path


def source(spark: SparkSession, directory: str, file_glob: str, schema) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
            .option("maxFilesPerTrigger", 64).parquet(directory))


def run_available_now(df: DataFrame, name: str, output_mode: str = "append", partition_by=()) -> str:
    """Write the stream to parquet in the shared folder; returns the data path."""
    spark = df.sparkSession
    base = scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")
    w = (df.writeStream.format("parquet").outputMode(output_mode)
         .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.start(f"{base}/data")
    q.awaitTermination()
    return f"{base}/data"


def score_stream(stream: DataFrame, model, feature_names, keys=(), threshold: float = 0.5) -> DataFrame:
    return score_batch(stream, model, feature_names, keys=keys, threshold=threshold)


def monitor_stream(scored: DataFrame, ts: str, window: str = "1 day", watermark: str = "1 hour",
                   label: str = "label", pred: str = "prediction", prob: str = "prob") -> DataFrame:
    t = F.col(ts).cast("timestamp")
    s = scored.withColumn("_ts", t).withWatermark("_ts", watermark)
    y, yh = F.col(label).cast("int"), F.col(pred).cast("int")
    g = s.groupBy(F.window("_ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y.cast("double")).alias("pos_rate"),
        F.avg(F.col(prob)).alias("mean_prob"), F.avg((y == yh).cast("double")).alias("accuracy"))
    return g.select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "n", "pos_rate", "mean_prob",
                    "accuracy")


def drift_windows(scored: DataFrame, baseline: DataFrame, ts: str, window: str = "1 day", watermark: str = "1 hour",
                  label: str = "label", pred: str = "prediction", prob: str = "prob", bins: int = 4096, threshold: float = 0.05) -> DataFrame:
    """All six metrics per event-time window, against a static baseline: (day, n, accuracy, precision,
    recall, f1_score, log_loss, roc_auc, pos_rate, mean_prob, delta_roc_auc, alert).

    The state is one row of sums per window and score bin; when the watermark closes a window, its bins
    meet in a second aggregation, which gives the metrics, and the stream is joined to the
    one-row ``baseline`` (roc_auc).  Rows later than the watermark count nowhere.  The same
    function on a batch frame gives the same rows for all windows."""
    rows = scored.withColumn("_ts", F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("_ts", watermark)
    counts = binned_counts(rows, label, pred, prob, [F.window("_ts", window).alias("w")], bins)
    m = binned_metrics(counts, ["w"]).join(F.broadcast(baseline.select(F.col("roc_auc").alias("base_roc_auc"))))     # one row
    delta = F.col("base_roc_auc") - F.col("roc_auc")
    return m.select(F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm").alias("day"), "n", "accuracy", "precision", "recall", "f1_score",
                    "log_loss", "roc_auc", "pos_rate", "mean_prob", delta.alias("delta_roc_auc"),
                    F.coalesce(delta >= F.lit(threshold), F.lit(False)).alias("alert"))


def score_stream_reloading(stream: DataFrame, load_champion, out_path: str, keys=(), threshold: float = 0.5,
                           checkpoint: str | None = None):
    """Continuous scoring that picks up a newly registered champion: ``load_champion()``
    returns ``(model, feature_names)`` and is called once per micro-batch inside
    ``foreachBatch``; each batch is the partition ``batch_id`` of ``out_path``, overwritten
    when the batch is run again.  Returns the started query."""
    spark = stream.sparkSession
    ckpt = checkpoint or scratch_path(spark, f"streams/reload-{uuid.uuid4().hex[:12]}/_checkpoint")

    def each(batch: DataFrame, batch_id: int):
        model, names = load_champion()
        score_batch(batch, model, names, keys=keys, threshold=threshold) \
            .write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    return (stream.writeStream.foreachBatch(each).option("checkpointLocation", ckpt)
            .trigger(availableNow=True).start())
