"""Saving and loading of models that are not MLlib's own.

A ``Stored`` transformer is written in the layout of Spark ML: a ``metadata`` folder (class, uid,
Spark version, time) that also holds the model's numbers as JSON (doubles keep all digits), and
one parquet table per distributed part.  It can stand alone or as a stage of a ``PipelineModel``;
``load_model`` reads either kind from a path on any file system that Spark reaches.
"""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.util import (DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable,
                             MLWriter)
from pyspark.sql import DataFrame, SparkSession


class Stored(Transformer, MLWritable, MLReadable):
    """Subclasses give ``state()`` (JSON values, the arguments of their constructor) and, for
    distributed parts, ``tables()`` and ``attach(tables)``."""

    def state(self) -> dict:
        raise NotImplementedError

    def tables(self) -> dict[str, DataFrame]:
        return {}

    def attach(self, tables: dict[str, DataFrame]) -> None:
        if tables:
            raise ValueError(f"{type(self).__name__} has no tables")

    def write(self) -> MLWriter:
        return _StoredWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StoredReader(cls)


class _StoredWriter(MLWriter):
    def __init__(self, model: Stored):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        parts = self.model.tables()
        for name, table in parts.items():
            table.write.parquet(f"{path}/tables/{name}")
        # last: a folder with metadata is a whole model
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession,
                                         extraMetadata={"state": self.model.state(), "tables": sorted(parts)})


class _StoredReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Stored:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark, f"{self.cls.__module__}.{self.cls.__name__}")
        model = self.cls(**metadata["state"])
        model._resetUid(metadata["uid"])
        model.attach({name: spark.read.parquet(f"{path}/tables/{name}") for name in metadata["tables"]})
        return model


def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, path: str):
    """Any saved model: MLlib's, a pipeline, or a ``Stored`` one."""
    return DefaultParamsReader.loadParamsInstance(path, spark)
