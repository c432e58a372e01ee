"""Materialised cut points and size-checked broadcasts."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 << 20

_local_folders: dict[str, tempfile.TemporaryDirectory] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master, where driver and executors share one disk, may leave it unset.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.TemporaryDirectory(prefix="waitwright-")
    return _local_folders[context.applicationId].name


def scratch_path(spark: SparkSession, kind: str) -> str:
    return f"{scratch_dir(spark)}/{kind}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: a fixed result that outlives lost executors.

    A written table keeps column pruning, filter pushdown and true size statistics,
    which a checkpointed row set does not.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure ``df``: whether its rows, text included, stay within ``max_bytes``."""
    width = F.lit(16 * len(df.columns)).cast("bigint")
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):  # of numbers, or of structs of a few
            width = width + 32 * F.coalesce(F.array_size(field.name), F.lit(0))
    return (df.agg(F.sum(width).alias("size")).first()["size"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Mark ``df`` for broadcast if it is small; otherwise leave the join to Spark."""
    return F.broadcast(df) if is_small(df) else df
