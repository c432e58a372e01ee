"""Live department readings as streams; column logic is shared with the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from waitwright.functions.rules import reading_alerts, status
from waitwright.lineage import cut
from waitwright.operators.allocate import allocate_with_cooldown, cooldown
from waitwright.operators.report import mean_of
from waitwright.settings import Thresholds


def stream_table(spark: SparkSession, folder: str, file: str, schema: StructType) -> DataFrame:
    """Stream over one growing parquet table of a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


def latest_readings(feed: DataFrame) -> DataFrame:
    """Newest reading per department, for update or complete mode; state is one row each."""
    rest = [c for c in feed.columns if c != "department"]
    order = [c for c in ("timestamp", "patient_id") if c in rest]
    newest = feed.groupBy("department").agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("newest"))
    return newest.select("department", "newest.*").select(*feed.columns)


def hourly_congestion(feed: DataFrame, lateness: str = "2 hours",
                      decimals: int | None = None) -> DataFrame:
    """Mean wait per department and hour.

    In append mode an hour appears once, after the watermark has passed it, and readings later
    than that are dropped. A bounded input is drained whole in complete mode.
    """
    return (
        feed.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        .withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", "1 hour").alias("span"), "department")
        .agg(mean_of("wait_time", decimals).alias("avg_wait"), F.count("*").alias("readings"))
        .select("department", F.col("span.start").alias("hour_start"), "avg_wait", "readings")
    )


def alert_stream(feed: DataFrame) -> DataFrame:
    """Status and alert text for each reading that deserves one."""
    return (reading_alerts(feed).withColumn("status", status(F.col("wait_time")))
            .select("timestamp", "department", "wait_time", "status", "level", "message"))


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append"
                 ) -> StreamingQuery:
    """Process what is available and stop; rows go to a table in a shared folder.

    Complete results replace the table with each batch.
    """
    writer = df.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        return writer.format("parquet").option("path", path).outputMode("append").start()

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return writer.foreachBatch(replace).outputMode(mode).start()


def allocate_batches(states: DataFrame, history: str, checkpoint: str, method: str = "greedy",
                     limits: Thresholds = Thresholds()) -> StreamingQuery:
    """Allocate each micro-batch of ``(site, run_time, department, ...)`` states.

    Results go to one history folder per batch, so a repeated batch replaces its own rows. The last
    kept run of each site is all the cooldown needs to go on: one small row per site, handed from
    batch to batch beside the history, which is never read back.
    """
    keys = ("site", "run_time")
    memory = f"{history.rstrip('/')}-last-kept"

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = cut(batch)
        runs = batch.select(*keys).distinct()
        if number > 0:
            before = spark.read.schema(runs.schema).parquet(f"{memory}/batch={number - 1}")
            runs = runs.unionByName(before)
        kept = cut(cooldown(runs, limits.cooldown_minutes))
        last = kept.where("kept").groupBy("site").agg(F.max("run_time").alias("run_time"))
        last.write.mode("overwrite").parquet(f"{memory}/batch={number}")
        results = allocate_with_cooldown(batch, kept, method, by=keys, limits=limits)
        results.write.mode("overwrite").parquet(f"{history}/batch={number}")

    return (states.writeStream.trigger(availableNow=True)
            .option("checkpointLocation", checkpoint).foreachBatch(handle).start())
