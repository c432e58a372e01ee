"""Accuracy over time from mergeable daily moments: when a model has to be trained again.

A day of a model is count and sums of errors and labels in whole units of 10^-digits, so moments of
any span, file or batch add up exactly, in any order, without reading scored rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waitwright.settings import TARGET

SUMS = ("error", "absolute", "squared", "label", "label_squared")
# fixed: share of lost accuracy, rows that a verdict needs
ACCURACY_DROP = 0.05
LEAST_ROWS = 1000
# fixed: days between looks of the three schedules
SCHEDULES = {"daily": 1, "weekly": 7, "monthly": 30}


def daily_moments(scored: DataFrame, by: tuple[str, ...], ts: str, label: str = TARGET,
                  prediction: str = "prediction", digits: int = 2) -> DataFrame:
    """(by, day, n, sums): one row per model and day; rows without label or prediction are left out."""
    unit = F.lit(10.0 ** digits)
    whole = lambda c: F.round(c * unit).cast("decimal(18,0)")
    y, error = whole(F.col(label)), whole(F.col(label)) - whole(F.col(prediction))
    parts = {"error": error, "absolute": F.abs(error), "squared": error * error, "label": y,
             "label_squared": y * y}
    known = scored.where(F.col(label).isNotNull() & F.col(prediction).isNotNull()
                         & F.col(ts).isNotNull())
    return known.groupBy(*by, F.to_date(ts).alias("day")).agg(
        F.count("*").alias("n"),
        *[F.sum(parts[c]).cast("decimal(38,0)").alias(c) for c in SUMS])


def merge(moments: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Moments of the same keys added up: days of several runs, or a whole span."""
    return moments.groupBy(*by).agg(
        F.sum("n").alias("n"), *[F.sum(c).cast("decimal(38,0)").alias(c) for c in SUMS])


def measures(digits: int = 2) -> dict[str, Column]:
    """RMSE, MAE, mean error and R2 of a row of moments."""
    n, unit = F.col("n").cast("double"), F.lit(10.0 ** digits)
    value = {c: F.col(c).cast("double") for c in SUMS}
    spread = value["label_squared"] - value["label"] * value["label"] / n
    return {"rmse": F.sqrt(value["squared"] / n) / unit, "mae": value["absolute"] / n / unit,
            "bias": value["error"] / n / unit,
            "r2": F.lit(1.0) - F.try_divide(value["squared"], spread)}


def retrain_days(moments: DataFrame, by: tuple[str, ...], *, base_days: int = 7,
                 schedule: str = "weekly", drop: float = ACCURACY_DROP,
                 least: int = LEAST_ROWS, digits: int = 2) -> DataFrame:
    """Per model and day: rows and RMSE of the days up to it, base RMSE, whether to train again.

    The base are a model's first ``base_days`` days; a look covers as many days as the schedule
    has between looks. A span with fewer than ``least`` rows gives no verdict.
    """
    models = Window.partitionBy(*by)
    day = F.datediff("day", F.lit("1970-01-01").cast("date"))
    placed = moments.withColumn("_day", day).withColumn("_first", F.min("_day").over(models))
    base = merge(placed.where(F.col("_day") < F.col("_first") + F.lit(base_days)), by)
    base = base.select(*by, measures(digits)["rmse"].alias("base_rmse"))
    span = models.orderBy("_day").rangeBetween(1 - SCHEDULES[schedule], 0)
    looked = placed.select(
        *by, "day", F.sum("n").over(span).alias("n"),
        *[F.sum(c).over(span).cast("decimal(38,0)").alias(c) for c in SUMS])
    judged = looked.select(*by, "day", "n", measures(digits)["rmse"].alias("rmse"))
    return judged.join(base, list(by)).withColumn(
        "retrain", (F.col("n") >= F.lit(least))
        & (F.col("rmse") > F.lit(1.0 + drop) * F.col("base_rmse")))
