"""Visit, reading and allocation tables derived from a general event log.

Everything is computed from the whole ``events`` table, so the work grows with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waitwright.lineage import cut, is_small

SALTS = 32


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def visits_without_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """One visit per event, every column that needs no other row."""
    kind, user, event = F.col("event_type"), F.col("user_id"), F.col("event_id")
    place = (F.when(kind == "signup", "Diagnostics").when(kind == "purchase", "Pharmacy")
             .when(kind == "error", "Emergency").otherwise("OPD"))
    share = F.regexp_extract("props", "([0-9]+)", 1).cast("double") / F.lit(100.0)
    grade = F.when(user % 3 == 0, "low").when(user % 3 == 1, "medium").otherwise("high")
    return _events(spark, folder).select(
        event.alias("patient_id"), F.col("ts").alias("arrival_time"), place.alias("department"),
        F.col("value").alias("waiting_time"),
        (user % 20).alias("queue_length_at_arrival"),
        (event % 6 + 2).alias("total_counters_available"),
        share.alias("system_utilization"),
        ((user % 50 + 50).cast("double") / F.lit(100.0)).alias("doctor_efficiency"),
        (kind == "error").cast("int").alias("is_emergency"),
        (event % 26 + 5).cast("double").alias("service_duration_expected"),
        grade.alias("patient_complexity"),
        (F.to_date("ts") == F.lit("2024-01-01").cast("date")).cast("int").alias("is_holiday"),
        kind.alias("_kind"), F.date_trunc("hour", "ts").alias("_hour"),
    )


def visits(spark: SparkSession, folder: str) -> DataFrame:
    """Visits with the number of arrivals of the same kind in the same hour.

    Counting is a small aggregate joined back, not a window: rows are never shuffled by hour,
    however many of them one hour holds. Events without a kind or a time count together. Counts
    too many to broadcast are joined by shuffle: each is repeated under ``SALTS`` numbers and the
    rows of a busy hour spread over them.
    """
    rows = visits_without_arrivals(spark, folder)
    counts = cut(rows.groupBy(F.col("_kind").alias("_k"), F.col("_hour").alias("_h"))
                 .agg(F.count("*").alias("arrivals_this_hour")))
    same = F.col("_kind").eqNullSafe(F.col("_k")) & F.col("_hour").eqNullSafe(F.col("_h"))
    if is_small(counts):
        joined = rows.join(F.broadcast(counts), same)
    else:
        repeated = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = rows.withColumn("_part", F.pmod(F.hash("patient_id"), F.lit(SALTS)))
        joined = spread.join(repeated, same & (F.col("_part") == F.col("_salt")))
    return joined.drop("_kind", "_hour", "_k", "_h", "_part", "_salt")


def plain_visits(spark: SparkSession, folder: str) -> DataFrame:
    """Visits for operators that do not use the arrival count."""
    return visits_without_arrivals(spark, folder).drop("_kind", "_hour")


def visits_dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Visits with gaps, negative waits and repeated rows."""
    number, wait = F.col("patient_id"), F.col("waiting_time")
    spoiled = visits(spark, folder).withColumns({
        "waiting_time": F.when(number % 17 == 0, F.lit(None)).when(number % 101 == 0, -wait)
        .otherwise(wait),
        "department": F.when(number % 23 != 0, F.col("department")),
    })
    copies = F.when(number % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return spoiled.withColumn("_copy", F.explode(copies)).drop("_copy")


def timed_visits(spark: SparkSession, folder: str) -> DataFrame:
    """Visits in the second layout: ``timestamp``, ``wait_time_minutes``, ``arrival_rate``."""
    return visits(spark, folder).select(
        "patient_id", F.col("arrival_time").alias("timestamp"), "department",
        "queue_length_at_arrival", "total_counters_available",
        (F.col("arrivals_this_hour").cast("double") / F.lit(24.0)).alias("arrival_rate"),
        "system_utilization", "doctor_efficiency",
        F.col("waiting_time").alias("wait_time_minutes"))


def department_feed(spark: SparkSession, folder: str, arrivals: bool = True) -> DataFrame:
    """Timestamped department readings."""
    source = visits(spark, folder) if arrivals else plain_visits(spark, folder)
    extra = [F.col("arrivals_this_hour").alias("arrivals_per_hour")] if arrivals else []
    return source.select(
        F.col("arrival_time").alias("timestamp"), "department",
        F.col("queue_length_at_arrival").alias("queue_length"),
        F.col("waiting_time").alias("wait_time"), *extra,
        F.col("total_counters_available").alias("active_counters"), "patient_id")


def _hundredths(column: str) -> Column:
    return F.sum(F.round(F.col(column) * F.lit(100.0)).cast("bigint")).cast("double")


def daily_departments(spark: SparkSession, folder: str) -> DataFrame:
    """One allocation input per department and day."""
    rows = F.count("*").cast("double")
    return (
        plain_visits(spark, folder)
        .groupBy(F.to_date("arrival_time").alias("snapshot"), "department")
        .agg((_hundredths("waiting_time") / (rows * F.lit(100.0))).alias("wait_time"),
             F.max("queue_length_at_arrival").cast("int").alias("queue_length"),
             (rows / F.lit(24.0)).alias("arrival_rate"),
             (_hundredths("system_utilization") / (rows * F.lit(100.0))).alias("utilization"),
             F.min("total_counters_available").cast("int").alias("current_counters"))
    )


def scoring_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One scoring request per visit; some break the allowed ranges."""
    moment, number = F.col("arrival_time"), F.col("patient_id")
    return visits(spark, folder).select(
        number.alias("request_id"), F.hour(moment).alias("hour"),
        F.weekday(moment).alias("day_of_week"), F.month(moment).alias("month"),
        (F.col("queue_length_at_arrival") - (number % 97 == 0).cast("int") * 30)
        .alias("queue_length_at_arrival"),
        F.when(number % 89 == 0, F.lit(0)).otherwise(F.col("total_counters_available"))
        .alias("total_counters_available"),
        (F.col("arrivals_this_hour").cast("double") / F.lit(24.0)).alias("arrival_rate"),
        (F.col("system_utilization") + (number % 83 == 0).cast("double"))
        .alias("system_utilization"),
        F.when(number % 7 != 0, F.col("doctor_efficiency")).alias("doctor_efficiency"),
        F.when(number % 11 != 0, F.col("department")).alias("department"))
