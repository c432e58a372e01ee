"""Calendar, bucket and cyclical column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waitwright.settings import ARRIVAL

PERIODS = {"hour": 24, "day_of_week": 7, "month": 12}


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def time_period(hour: Column) -> Column:
    # fixed: first hour (inclusive), last hour (exclusive), label
    bands = ((6, 9, "early_morning"), (9, 12, "peak_morning"), (12, 17, "afternoon"),
             (17, 20, "evening"))
    first, last, label = bands[0]
    chain = F.when((hour >= first) & (hour < last), label)
    for first, last, label in bands[1:]:
        chain = chain.when((hour >= first) & (hour < last), label)
    return chain.otherwise("night")


def calendar_columns(ts: Column) -> dict[str, Column]:
    """Parts of a timestamp; Monday is day 0, weeks are ISO weeks."""
    day = F.weekday(ts)
    return {
        "hour": F.hour(ts), "day_of_week": day, "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts), "week_of_year": F.weekofyear(ts),
        "is_weekend": _flag(day >= 5), "is_monday": _flag(day == 0),
    }


def with_calendar(df: DataFrame, ts: str = ARRIVAL) -> DataFrame:
    parts = calendar_columns(F.col(ts))
    return df.withColumns({**parts, "time_period": time_period(F.hour(ts))})


def peak_columns(hour: Column) -> dict[str, Column]:
    """Busy-hour flags, both ends inclusive."""
    return {"is_peak_hours": _flag(hour.between(9, 12)), "is_evening": _flag(hour.between(16, 19))}


def epoch_micros(df: DataFrame, column: str) -> Column:
    """Order-preserving microseconds of a timestamp; zone-free ones ignore the session zone."""
    value = F.col(column)
    if not isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.unix_micros(value.cast("timestamp"))
    day = F.unix_date(F.to_date(value)).cast("bigint") * F.lit(86_400_000_000)
    clock = F.hour(value).cast("bigint") * F.lit(3_600_000_000) + (
        F.minute(value).cast("bigint") * F.lit(60_000_000))
    return day + clock + (F.extract(F.lit("SECOND"), value) * F.lit(1_000_000)).cast("bigint")


def cyclical(value: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def with_cyclical(df: DataFrame, day_prefix: str = "day") -> DataFrame:
    """Sine and cosine of hour, weekday and month, for those columns that exist."""
    added = {}
    for column, period in PERIODS.items():
        if column in df.columns:
            prefix = day_prefix if column == "day_of_week" else column
            added[f"{prefix}_sin"], added[f"{prefix}_cos"] = cyclical(F.col(column), period)
    return df.withColumns(added) if added else df


def with_calendar_flags(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Second feature set: calendar parts, weekend, cyclical (``dow_``) and busy-hour flags."""
    if ts in df.columns:
        parts = calendar_columns(F.col(ts))
        wanted = ("hour", "day_of_week", "month", "day_of_month", "is_weekend")
        df = df.withColumns({name: parts[name] for name in wanted})
    df = with_cyclical(df, day_prefix="dow")
    return df.withColumns(peak_columns(F.col("hour"))) if "hour" in df.columns else df
