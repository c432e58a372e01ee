"""Reading visit tables and writing results."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waitwright.operators.clean import nan_to_null
from waitwright.operators.scale import FlagLimits, Scaler
from waitwright.settings import ARRIVAL, REQUIRED_COLUMNS, TIMESTAMP_COLUMNS, VISIT_ID

# Types of the columns a visit file may carry; others stay text.
VISIT_TYPES = {
    "waiting_time": "double", "queue_length_at_arrival": "int", "system_utilization": "double",
    "total_counters_available": "int", "doctor_efficiency": "double", "is_emergency": "int",
    "arrivals_this_hour": "int", "service_duration_expected": "double", "is_holiday": "int",
    "patient_id": "bigint", "arrival_rate": "double", "wait_time_minutes": "double", "hour": "int",
    "day_of_week": "int", "month": "int",
}


def _typed(raw: DataFrame, stamps: tuple[str, ...], parse) -> DataFrame:
    def column(name: str) -> Column:
        if name in stamps:
            return parse(F.col(name)).alias(name)
        return F.col(name).cast(VISIT_TYPES.get(name, "string")).alias(name)

    return nan_to_null(raw.select(*[column(name) for name in raw.columns]))


def read_visits_csv(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """Visit file with lenient timestamps: unreadable ones become null.

    ``ordered`` sorts by arrival, nulls last. The library's own operators do not need it.
    """
    raw = spark.read.option("header", True).csv(path)
    df = _typed(raw, TIMESTAMP_COLUMNS, F.try_to_timestamp)
    if not ordered:
        return df
    ties = [F.col(VISIT_ID)] if VISIT_ID in df.columns else []
    return df.orderBy(F.col(ARRIVAL).asc_nulls_last(), *ties)


def read_timed_csv(spark: SparkSession, path: str) -> DataFrame:
    """Visit file of the second layout; an unreadable ``timestamp`` fails the job."""
    return _typed(spark.read.option("header", True).csv(path), ("timestamp",), F.to_timestamp)


def database_reader(spark: SparkSession, query: str, url: str,
                    properties: dict[str, str] | None = None,
                    partition: tuple[str, int, int, int] | None = None):
    """Configured JDBC reader; ``partition`` is (column, lowest, highest, tasks)."""
    reader = spark.read.format("jdbc").option("url", url).options(**(properties or {}))
    if partition is None:
        return reader.option("query", query)
    column, low, high, tasks = partition
    return reader.option("dbtable", f"({query}) visits").options(
        partitionColumn=column, lowerBound=str(low), upperBound=str(high),
        numPartitions=str(tasks))


def read_database(spark: SparkSession, query: str, url: str, **options) -> DataFrame:
    """Result of a database query; give ``partition`` to read with many tasks."""
    return database_reader(spark, query, url, **options).load()


def check_schema(df: DataFrame) -> tuple[bool, list[str]]:
    """Whether all required columns exist, and the missing ones in declared order."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    return not missing, missing


def require_schema(df: DataFrame) -> None:
    valid, missing = check_schema(df)
    if not valid:
        raise ValueError(f"Invalid data schema. Missing columns: {missing}")


# --- sinks ------------------------------------------------------------------------------------
def recommendation_report(recommendations: DataFrame) -> DataFrame:
    """Fixed report layout of allocation recommendations."""
    return recommendations.select(
        F.col("department").alias("Department"),
        F.col("current_counters").alias("Current Counters"),
        F.col("recommended_counters").alias("Recommended Counters"),
        F.upper("action").alias("Action"),
        F.col("predicted_wait_time").alias("Predicted Wait (min)"))


def write_recommendations(recommendations: DataFrame | None, path: str) -> None:
    """CSV report; nothing happens when nothing has been recommended yet."""
    if recommendations is not None:
        (recommendation_report(recommendations).write.mode("overwrite").option("header", True)
         .csv(path))


def _literal(value) -> Column:
    if isinstance(value, dict):
        return F.struct(*[_literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return F.array(*[_literal(v) for v in value])
    return F.lit(value)


def summary_frame(spark: SparkSession, summary: dict) -> DataFrame:
    """Nested summary as one row."""
    return spark.range(1).select(*[_literal(v).alias(k) for k, v in summary.items()])


def write_summary(spark: SparkSession, summary: dict, path: str) -> None:
    summary_frame(spark, summary).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def write_importance(importance: DataFrame, path: str) -> None:
    """CSV with one row per feature, most important first, in a single file."""
    (importance.orderBy(F.desc("importance")).coalesce(1)
     .write.mode("overwrite").option("header", True).csv(path))


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("feature string, importance double").option("header", True).csv(path)


def read_learning_curve(spark: SparkSession, learn_path: str, test_path: str) -> DataFrame:
    """Two tab-separated training logs joined on the iteration."""
    def log(path: str, name: str) -> DataFrame:
        return (spark.read.schema("iter int, RMSE double").option("header", True)
                .option("sep", "\t").csv(path).withColumnRenamed("RMSE", name))

    return log(learn_path, "learn_rmse").join(log(test_path, "test_rmse"), "iter")


def read_timing_log(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema("iter int, passed_ms bigint, remaining_ms bigint")
            .option("header", True).option("sep", "\t").csv(path))


# --- fitted state -----------------------------------------------------------------------------
def save_state(spark: SparkSession, path: str, **state: dict) -> None:
    """Named dictionaries of scalars (fill values, bounds, scaler moments, feature names)."""
    rows = [F.struct(F.lit(name).alias("name"), F.lit(json.dumps(value)).alias("value"))
            for name, value in state.items()]
    spark.range(1).select(F.inline(F.array(*rows))).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> dict[str, dict]:
    return {row["name"]: json.loads(row["value"]) for row in spark.read.parquet(path).collect()}


def save_encoder(encoder: DataFrame, path: str) -> None:
    encoder.write.mode("overwrite").partitionBy("column").parquet(path)


def load_encoder(spark: SparkSession, path: str) -> DataFrame:
    schema = "value string, code int, column string"
    return spark.read.schema(schema).parquet(path).select("column", "value", "code")




@dataclass
class SavedRun:
    """Everything that scoring needs from a training run."""

    model: PipelineModel
    features: list[str]
    encoder: DataFrame
    scaler: Scaler
    flags: FlagLimits


def save_run(spark: SparkSession, path: str, model: PipelineModel, features: list[str],
             encoder: DataFrame, scaler: Scaler, flags: FlagLimits) -> None:
    """Best model, feature order, encoder, scaler and flag limits, side by side in one folder."""
    model.write().overwrite().save(f"{path}/model")
    save_encoder(encoder, f"{path}/encoder")
    save_state(spark, f"{path}/state", features={"names": features}, scaler=scaler.moments,
               flags=flags.limits)


def load_run(spark: SparkSession, path: str) -> SavedRun:
    state = load_state(spark, f"{path}/state")
    moments = {name: tuple(pair) for name, pair in state["scaler"].items()}
    return SavedRun(PipelineModel.load(f"{path}/model"), state["features"]["names"],
                    load_encoder(spark, f"{path}/encoder"), Scaler(moments),
                    FlagLimits(state["flags"]))
