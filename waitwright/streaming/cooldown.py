"""The allocation cooldown as keyed state: one number per site, dropped when it no longer matters.

Each site keeps the time of its last kept run in the state store; Spark snapshots it with the
stream's checkpoint, so a restart, a lost executor or another cut into batches gives the same rows.
An event-time timer removes a site once the watermark has passed the end of its cooldown: no later
row can fall into it, so forgetting the site changes nothing.

Defined cases: rows without site or time are left out, as in the batch form; a run that returns in
a later batch is judged as before; a run older than the last kept one counts as inside its
cooldown; rows older than the watermark (``lateness`` behind the newest) are dropped by Spark. A
task holds the rows that one site has in one micro-batch: limit files or rows per trigger, or use
``allocate_batches``, which needs no task per site.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from waitwright.functions.calendar import epoch_micros
from waitwright.lineage import cut
from waitwright.operators.allocate import allocate_with_cooldown
from waitwright.settings import Thresholds

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SiteCooldown(StatefulProcessor):
    """Adds ``kept`` to the rows of a site; state: microseconds of its last kept run."""

    def __init__(self, gap_micros: int):
        self.gap = gap_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.last.get()
        last = before = None if held is None else held[0]
        for row in sorted(rows, key=lambda r: r["_us"]):
            at = row["_us"]
            if last is None or at - last >= self.gap:
                last = at
            yield Row(**row.asDict(), kept=at == last)
        if last != before:
            self.last.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(-(-(last + self.gap) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


@contextmanager
def _rocksdb(spark: SparkSession):
    """The store of the streams started inside; they keep it, other streams keep theirs."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def with_kept(states: DataFrame, minutes: int, lateness: str = "2 hours") -> DataFrame:
    """Stream of ``(site, run_time, ...)`` rows with ``kept``, and ``_us`` and ``_event`` of the run."""
    known = states.dropna(subset=["site", "run_time"])
    timed = known.withColumn("_us", epoch_micros(known, "run_time"))
    timed = timed.withColumn("_event", F.timestamp_micros("_us")).withWatermark("_event", lateness)
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in timed.schema),
                           T.StructField("kept", T.BooleanType())])
    return timed.groupBy("site").transformWithState(
        SiteCooldown(minutes * 60_000_000), schema, "append", "eventTime")


def allocate_keyed(states: DataFrame, history: str, checkpoint: str, method: str = "greedy",
                   limits: Thresholds = Thresholds(), lateness: str = "2 hours") -> StreamingQuery:
    """As ``allocate_batches``, with the cooldown in Spark's own state.

    Results go to one history folder per batch, so a repeated batch replaces its own rows.
    """
    keys = ("site", "run_time")

    def handle(batch: DataFrame, number: int) -> None:
        rows = cut(batch)
        kept = rows.select(*keys, "kept").distinct()
        results = allocate_with_cooldown(rows.drop("kept", "_us", "_event"), kept, method, by=keys,
                                         limits=limits)
        results.write.mode("overwrite").parquet(f"{history}/batch={number}")

    with _rocksdb(states.sparkSession):
        return (with_kept(states, limits.cooldown_minutes, lateness).writeStream
                .trigger(availableNow=True).option("checkpointLocation", checkpoint)
                .outputMode("append").foreachBatch(handle).start())
