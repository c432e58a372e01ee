"""Files of tasks in the shared folder, on any store that Arrow or Spark's settings can name."""

from __future__ import annotations

from uuid import uuid4

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from waitwright.lineage import scratch_path


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, as a URI that tasks can open."""
    path = scratch_path(spark, kind)
    folder = path if "://" in path else f"file://{path.removeprefix('file:')}"
    store, inner = pafs.FileSystem.from_uri(folder)
    store.create_dir(inner, recursive=True)
    return folder


class Written:
    """A file named anew by each attempt of a task, so attempts never meet.

    Only names that a task returns are read later; files of lost attempts are never looked at.
    """

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{folder}/{uuid4().hex}{suffix}"
        store, path = pafs.FileSystem.from_uri(self.uri)
        self.stream = store.open_output_stream(path, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()


def opened(uri: str):
    """Random-access file."""
    store, path = pafs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
