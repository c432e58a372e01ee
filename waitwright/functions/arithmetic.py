"""Interaction, transform, binning and serving column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitwright.functions.calendar import calendar_columns, cyclical, peak_columns

QUEUE, COUNTERS = "queue_length_at_arrival", "total_counters_available"
UTILIZATION, EFFICIENCY = "system_utilization", "doctor_efficiency"
ARRIVALS = "arrivals_this_hour"


def _double(name: str) -> Column:
    return F.col(name).cast("double")


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields null on a zero divisor instead of failing the job."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def with_interactions(df: DataFrame) -> DataFrame:
    """Load features of the training matrix; counters are offset by one."""
    queue, used, arrivals = _double(QUEUE), _double(UTILIZATION), _double(ARRIVALS)
    counters = _double(COUNTERS) + F.lit(1.0)
    return df.withColumns({
        "workload_index": ratio(queue * used, counters),
        "arrival_pressure": ratio(arrivals, counters),
        "efficiency_gap": _double(EFFICIENCY) - used,
        "capacity_ratio": ratio(queue, counters),
        "utilization_load": used * arrivals,
    })


def with_optional_interactions(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Load features of the second set; each appears only when its inputs do."""
    if not enabled:
        return df
    queue, used, counters = _double(QUEUE), _double(UTILIZATION), _double(COUNTERS)
    recipes = {
        "queue_pressure": ((QUEUE, UTILIZATION), lambda: queue * used),
        "counters_per_patient": ((QUEUE, COUNTERS), lambda: ratio(counters, queue + F.lit(1.0))),
        "workload_index": ((QUEUE, UTILIZATION, COUNTERS),
                           lambda: ratio(queue * used, counters + F.lit(1.0))),
        "hour_queue_interaction": (("hour", QUEUE), lambda: F.col("hour") * F.col(QUEUE)),
        "efficiency_gap": ((EFFICIENCY, UTILIZATION), lambda: _double(EFFICIENCY) - used),
    }
    added = {name: build() for name, (needs, build) in recipes.items()
             if set(needs) <= set(df.columns)}
    return df.withColumns(added) if added else df


def with_transforms(df: DataFrame) -> DataFrame:
    """Log and root of skewed columns."""
    added = {"log_queue": F.log1p(_double(QUEUE)), "sqrt_arrivals": F.sqrt(_double(ARRIVALS))}
    if "service_duration_expected" in df.columns:
        added["log_service_time"] = F.log1p(_double("service_duration_expected"))
    return df.withColumns(added)


# fixed: upper edge (inclusive) of each utilisation band, lowest edge 0 excluded
UTILIZATION_BANDS = (("low", 0.5), ("medium", 0.75), ("high", 0.9), ("critical", 1.0))


def with_utilization_bands(df: DataFrame, column: str = UTILIZATION) -> DataFrame:
    """One boolean per right-closed utilisation band; outside (0, 1] all are false."""
    value, lower, added = _double(column), 0.0, {}
    for label, upper in UTILIZATION_BANDS:
        inside = (value > F.lit(lower)) & (value <= F.lit(upper))
        added[f"util_{label}"] = F.coalesce(inside, F.lit(False))
        lower = upper
    return df.withColumns(added)


def with_one_hot(df: DataFrame, column: str, values: list[str], prefix: str) -> DataFrame:
    """One boolean per listed value, source column kept; null matches none."""
    return df.withColumns({
        f"{prefix}_{value}": F.coalesce(F.col(column) == F.lit(value), F.lit(False))
        for value in values
    })


# fixed: what a live reading lacks is taken to be
READING_DEFAULTS = {
    "queue_length": 10, "arrivals_per_hour": 20, "system_utilization": 0.75,
    "active_counters": 4, "doctor_efficiency": 0.95, "is_emergency": 0,
}


def with_reading_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Model inputs of a live department reading, gaps filled with defaults."""
    def reading(name: str) -> Column:
        default = F.lit(READING_DEFAULTS[name])
        return F.coalesce(F.col(name), default) if name in df.columns else default

    base = {
        QUEUE: reading("queue_length"), ARRIVALS: reading("arrivals_per_hour"),
        UTILIZATION: reading("system_utilization"), COUNTERS: reading("active_counters"),
        EFFICIENCY: reading("doctor_efficiency"), "is_emergency": reading("is_emergency"),
    }
    df = df.withColumns({**calendar_columns(F.col(ts)), **base})
    hour_sin, hour_cos = cyclical(F.col("hour"), 24)
    day_sin, day_cos = cyclical(F.col("day_of_week"), 7)
    arrivals = _double(ARRIVALS)
    return df.withColumns({
        "hour_sin": hour_sin, "hour_cos": hour_cos, "day_sin": day_sin, "day_cos": day_cos,
        "queue_per_counter": ratio(F.col(QUEUE), F.greatest(F.col(COUNTERS), F.lit(1))),
        "efficiency_load": _double(EFFICIENCY) * arrivals,
        "utilization_load": _double(UTILIZATION) * arrivals,
        "log_queue": F.log1p(_double(QUEUE)), "sqrt_arrivals": F.sqrt(arrivals),
    })


def with_request_features(df: DataFrame) -> DataFrame:
    """Derived inputs of a scoring request as the service computes them.

    The workload here divides by the counters themselves, not by one more.
    """
    hour_sin, hour_cos = cyclical(F.col("hour"), 24)
    return df.withColumns({
        "hour_sin": hour_sin, "hour_cos": hour_cos,
        "workload_index": ratio(_double(QUEUE) * _double(UTILIZATION), F.col(COUNTERS)),
        "log_queue": F.log1p(_double(QUEUE)),
    })


def with_command_features(df: DataFrame) -> DataFrame:
    """Derived inputs of a scoring request in the form the trained second set expects."""
    df = df.withColumns(peak_columns(F.col("hour")))
    df = df.withColumn("is_weekend", (F.col("day_of_week") >= 5).cast("int"))
    for column, prefix, period in (("hour", "hour", 24), ("day_of_week", "dow", 7),
                                   ("month", "month", 12)):
        sine, cosine = cyclical(F.col(column), period)
        df = df.withColumns({f"{prefix}_sin": sine, f"{prefix}_cos": cosine})
    df = with_optional_interactions(df.withColumn("log_queue", F.log1p(_double(QUEUE))))
    return df.drop("hour_queue_interaction")


# fixed: field -> (lowest, highest or None, default or None)
REQUEST_RANGES = {
    "hour": (0, 23, None), "day_of_week": (0, 6, None), "month": (1, 12, None),
    QUEUE: (0, None, None), COUNTERS: (1, None, None), "arrival_rate": (0, None, None),
    UTILIZATION: (0, 1, None), EFFICIENCY: (0, 1, 0.75),
}
DEFAULT_DEPARTMENT = "OPD"


def with_request_check(df: DataFrame) -> DataFrame:
    """Fill defaults and list the fields of each request that break their range."""
    added, checks = {}, []
    for field, (low, high, default) in REQUEST_RANGES.items():
        if default is not None:
            given = F.col(field) if field in df.columns else F.lit(None).cast("double")
            added[field] = F.coalesce(given, F.lit(default))
        elif field not in df.columns:
            raise ValueError(f"scoring request lacks {field}")
        value = F.col(field)
        bad = value.isNull() | (value < low)
        if high is not None:
            bad = bad | (value > high)
        checks.append(F.when(bad, F.lit(field)))
    place = F.col("department") if "department" in df.columns else F.lit(None).cast("string")
    added["department"] = F.coalesce(place, F.lit(DEFAULT_DEPARTMENT))
    df = df.withColumns(added)
    return df.withColumn("violations", F.array_compact(F.array(*checks)))


def aligned(df: DataFrame, features: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Trained feature order; absent features become 0, others are dropped."""
    return df.select(*keep, *[F.col(name) if name in df.columns else F.lit(0).alias(name)
                              for name in features])


def present(df: DataFrame, features: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """Listed features in order, skipping those the table does not have."""
    return df.select(*keep, *[name for name in features if name in df.columns])


def without(df: DataFrame, *columns: str) -> DataFrame:
    """Every column but the listed ones."""
    return df.drop(*columns)
