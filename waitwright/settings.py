"""Fixed values and tunable defaults.

Values under a "fixed" comment must stay as they are for results to agree with
existing deployments. Everything else is a default that callers may override.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed: column names --------------------------------------------------------------------
ARRIVAL = "arrival_time"
TARGET = "waiting_time"
VISIT_ID = "patient_id"

# fixed: columns a visit table must have, in reporting order
REQUIRED_COLUMNS = (
    "arrival_time", "waiting_time", "queue_length_at_arrival", "department",
    "system_utilization", "total_counters_available", "doctor_efficiency", "is_emergency",
)
# fixed: columns parsed as timestamps when they are present
TIMESTAMP_COLUMNS = ("arrival_time", "service_start_time", "service_end_time")
# fixed: columns filled from their neighbours in time when they are present
CARRIED_COLUMNS = ("hour", "day_of_week", "month")
# fixed: columns that get an ordinal code
CATEGORICAL_COLUMNS = ("department", "patient_complexity", "time_period")

# fixed: the ordered feature list of the training matrix
FEATURES = (
    "hour", "day_of_week", "day_of_month", "month", "week_of_year", "is_weekend", "is_monday",
    "is_holiday",
    "queue_length_at_arrival", "arrivals_this_hour", "system_utilization",
    "total_counters_available", "doctor_efficiency", "is_emergency", "service_duration_expected",
    "prev_wait_1", "prev_wait_2", "rolling_wait_5", "rolling_wait_10", "rolling_queue_3",
    "rolling_queue_5",
    "workload_index", "arrival_pressure", "efficiency_gap", "capacity_ratio", "utilization_load",
    "log_queue", "sqrt_arrivals", "log_service_time",
    "hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos",
    "department_enc", "patient_complexity_enc", "time_period_enc",
)


@dataclass(frozen=True)
class Department:
    """Staffing bounds of one department."""

    department: str
    min_counters: int
    max_counters: int
    avg_service_time: int
    priority_weight: float


# fixed: shipped department settings; Emergency's service time is our own default
DEPARTMENTS = (
    Department("OPD", 2, 8, 15, 1.0),
    Department("Diagnostics", 2, 6, 20, 1.2),
    Department("Pharmacy", 2, 5, 8, 0.8),
    Department("Emergency", 3, 10, 10, 2.0),
)


@dataclass(frozen=True)
class Thresholds:
    """Allocation and alert parameters; change with ``dataclasses.replace``."""

    ideal_wait: float = 15.0
    acceptable_wait: float = 30.0
    critical_wait: float = 45.0
    queue_alert: float = 15.0
    max_utilization: float = 0.85
    min_utilization: float = 0.60
    total_staff: int = 15
    cooldown_minutes: int = 15
    # fixed: what an unlisted department gets
    default_min: int = 1
    default_max: int = 5
    default_service_time: float = 8.0
    default_weight: float = 1.0
    default_current: int = 2


# fixed: fractions of the quantile filter, the fence factor of the quartile filter
QUANTILE_RANGE = (0.01, 0.99)
FENCE_FACTOR = 1.5
# z-score bound of the deviation filter
Z_LIMIT = 3.0
# row offsets and row windows of the second feature set
LAGS = (1, 2)
WINDOWS = (5, 10)
