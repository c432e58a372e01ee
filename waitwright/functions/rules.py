"""Classification, alert, advice and interval expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitwright.functions.arithmetic import ratio
from waitwright.functions.rounding import fixed_text, round_scaled
from waitwright.lineage import cut
from waitwright.settings import Thresholds

# Fixed texts, reproduced so that downstream consumers can match on them.
ADVICE_CRITICAL = ("⚠️  CRITICAL: Wait time exceeds 45 minutes. "
                   "Immediate counter increase required.")
ADVICE_WARNING = ("⚠️  WARNING: Wait time above acceptable threshold. "
                  "Consider adding counters.")
ADVICE_FINE = "✓  Wait time within acceptable range."
ADVICE_OVERLOAD = "⚠️  System utilization critical. Staff are overloaded."
ADVICE_BUSY = "⚠️  High utilization. Monitor closely."
ADVICE_QUEUE = "⚠️  Long queue detected. Consider capacity expansion."
HINT_HIGH_WAIT = "High wait time detected. Consider adding more counters."
HINT_UTILIZATION = "System utilization is critical. Immediate action recommended."
HINT_FINE = "Wait time is within acceptable range. System running smoothly."
ACTION_ADD = "Action recommended: Consider adding counters or optimizing workflow"
ACTION_NONE = "Operating normally"
ALL_NORMAL = "All systems normal"


def _three_way(value: Column, labels: tuple[str, str, str]) -> Column:
    return F.when(value < 15, labels[0]).when(value < 30, labels[1]).otherwise(labels[2])


def status(wait: Column) -> Column:
    return _three_way(wait, ("Normal", "Busy", "Critical"))


def urgency(wait: Column) -> Column:
    return _three_way(wait, ("Low", "Medium", "High"))


def action_hint(wait: Column) -> Column:
    return F.when(wait > 25, ACTION_ADD).otherwise(ACTION_NONE)


def wait_advice(wait: Column, utilization: Column, queue: Column) -> Column:
    """Array of advice texts for one reading, most urgent first."""
    return F.array_compact(F.array(
        F.when(wait > 45, ADVICE_CRITICAL).when(wait > 30, ADVICE_WARNING).otherwise(ADVICE_FINE),
        F.when(utilization > 0.90, ADVICE_OVERLOAD).when(utilization > 0.85, ADVICE_BUSY),
        F.when(queue > 15, ADVICE_QUEUE),
    ))


def screen_hints(wait: Column, utilization: Column) -> Column:
    """Array of short hints, each tested on its own."""
    return F.array_compact(F.array(
        F.when(wait > 30, HINT_HIGH_WAIT),
        F.when(utilization > 0.85, HINT_UTILIZATION),
        F.when(wait <= 15, HINT_FINE),
    ))


def alert_level(wait: Column, queue: Column, limits: Thresholds = Thresholds()) -> Column:
    critical = (wait > limits.critical_wait) | (queue > 1.5 * limits.queue_alert)
    warning = (wait > limits.acceptable_wait) | (queue > limits.queue_alert)
    return F.when(critical, "critical").when(warning, "warning").otherwise("normal")


def reading_alerts(df: DataFrame, wait: str = "wait_time", place: str = "department") -> DataFrame:
    """Keep readings whose wait passes 20 minutes and word an alert for each."""
    value = F.col(wait)
    severe = value > 30
    return (
        df.where(value > 20)
        .withColumn("level", F.when(severe, "error").otherwise("warning"))
        .withColumn("message", F.format_string(
            "%s: %s - %s min wait",
            F.when(severe, "Critical").otherwise("Warning"), F.col(place), fixed_text(value, 1)))
    )


def threshold_alerts(latest: DataFrame, wait: str = "wait_time",
                     place: str = "department") -> DataFrame:
    """Alerts over the newest readings; a single all-clear row when none is due."""
    latest = cut(latest)  # read by both branches
    alerts = reading_alerts(latest, wait, place).select(place, "level", "message")
    clear = (
        latest.agg(F.count_if(F.col(wait) > 20).alias("due")).where("due = 0")
        .select(F.lit(None).cast("string").alias(place), F.lit("success").alias("level"),
                F.lit(ALL_NORMAL).alias("message"))
    )
    return alerts.unionByName(clear)


def recommendation_alerts(recommendations: DataFrame) -> DataFrame:
    """Alerts worth raising from allocation recommendations."""
    wait, action = F.col("predicted_wait_time"), F.col("action")
    high = (action == "increase") & (wait > 25)
    low = (action == "decrease") & (wait < 10)
    # fixed: sentences of both alerts
    text = F.when(high, F.format_string(
        "[HIGH WAIT ALERT] %s: Predicted wait %s min. Immediate counter increase recommended.",
        F.col("department"), fixed_text(wait, 1),
    )).otherwise(F.format_string(
        "[LOW LOAD ALERT] %s: Low demand detected. Staff can be reallocated.", F.col("department"),
    ))
    kind = F.when(high, "HIGH WAIT").otherwise("LOW LOAD")
    return recommendations.where(high | low).withColumns({"alert": kind, "message": text})


def queueing_estimate(queue: Column, counters: Column, observed: Column | None = None) -> Column:
    """Wait implied by queue per counter; the observed wait where that is undefined."""
    estimate = ratio(queue, counters) * F.lit(3.5)
    return estimate if observed is None else F.coalesce(estimate, observed)


def non_negative(prediction: Column) -> Column:
    return F.when(prediction < 0, F.lit(0.0)).otherwise(prediction)


def relative_interval(prediction: Column, digits: int | None = None) -> dict[str, Column]:
    """Band of 15 percent either side, optionally rounded for display."""
    bounds = {"lower": non_negative(prediction * F.lit(0.85)),
              "upper": prediction * F.lit(1.15)}
    if digits is None:
        return bounds
    return {name: round_scaled(bound, digits) for name, bound in bounds.items()}


def normal_interval(prediction: Column) -> dict[str, Column]:
    """Band of 1.96 standard errors, the error taken as 15 percent."""
    error = prediction * F.lit(0.15)
    return {"std_error": error,
            "confidence_lower": non_negative(prediction - F.lit(1.96) * error),
            "confidence_upper": prediction + F.lit(1.96) * error}
