"""Files that tasks write and read in a folder that all machines share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from tessera.session import scratch_path


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in this application's part of the shared folder."""
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    where, inner = fs.FileSystem.from_uri(path)
    where.create_dir(inner, recursive=True)
    return path


@contextlib.contextmanager
def created(folder: str, name: str) -> Iterator:
    """A binary file that appears under its name when it is whole: a task that is run again
    (or twice at a time) puts the same file in its place."""
    where, inner = fs.FileSystem.from_uri(folder)
    hidden = f"{inner}/.{name}-{uuid.uuid4().hex[:8]}"
    with where.open_output_stream(hidden, compression=None) as out:
        yield out
    where.move(hidden, f"{inner}/{name}")


@contextlib.contextmanager
def opened(path: str) -> Iterator:
    where, inner = fs.FileSystem.from_uri(path)
    with where.open_input_stream(inner, compression=None) as stream:
        yield stream


def paths(spark: SparkSession, folder: str, ending: str) -> DataFrame:
    """(path) of the folder's files, dealt to tasks by file size; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(folder).select("path")
