"""Session for local runs; on a cluster use the session it provides."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", name: str = "waitwright", memory: str = "12g",
                  scratch: str | None = None) -> SparkSession:
    """``scratch``: folder of intermediate tables, as ``spark.checkpoint.dir`` on a cluster."""
    count = os.cpu_count() if cores == "*" else int(cores)
    builder = SparkSession.builder
    if scratch is not None:
        builder = builder.config("spark.checkpoint.dir", scratch)
    spark = (
        builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(count))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
