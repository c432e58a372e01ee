"""Fitted thresholds and standardisation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitwright.operators.quantiles import quantile_values
from waitwright.operators.sketches import approximate_values

# fixed: column, quantile, flag name, whether the flag marks values above it
FLAG_RULES = (("arrival_rate", 0.75, "high_arrival_rate", True),
              ("total_counters_available", 0.25, "low_capacity", False))


@dataclass(frozen=True)
class FlagLimits:
    """Fitted quantile per flagged column."""

    limits: dict[str, float]


def fit_flags(df: DataFrame, sketch: int | None = None) -> FlagLimits:
    """Exact limits, or approximate ones from sketches of the size asked for."""
    rules = [(column, prob) for column, prob, _, _ in FLAG_RULES if column in df.columns]
    if not rules:
        return FlagLimits({})
    columns, probs = [column for column, _ in rules], sorted({prob for _, prob in rules})
    marks = (quantile_values(df, columns, probs) if sketch is None
             else approximate_values(df, columns, probs, sketch))
    limits = {column: marks[(column, prob)] for column, prob in rules if (column, prob) in marks}
    return FlagLimits(limits)


def apply_flags(df: DataFrame, fitted: FlagLimits) -> DataFrame:
    """High-arrival and low-capacity flags against limits fitted on the training rows."""
    added = {}
    for column, _, flag, above in FLAG_RULES:
        if column in df.columns and column in fitted.limits:
            limit = F.lit(fitted.limits[column])
            hit = F.col(column) > limit if above else F.col(column) <= limit
            added[flag] = F.coalesce(hit, F.lit(False)).cast("int")
    return df.withColumns(added) if added else df


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per column."""

    moments: dict[str, tuple[float, float]]


def fit_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    moments = df.agg(*[
        F.struct(F.avg(F.col(c).cast("double")).alias("mean"),
                 F.stddev_pop(F.col(c).cast("double")).alias("std")).alias(c)
        for c in columns]).first()
    return Scaler({c: (moments[c]["mean"], moments[c]["std"]) for c in columns})


def apply_scaler(df: DataFrame, scaler: Scaler) -> DataFrame:
    """Centre and scale; a column without spread is only centred."""
    return df.withColumns({
        c: (F.col(c).cast("double") - F.lit(mean)) / F.lit(std or 1.0)
        for c, (mean, std) in scaler.moments.items() if mean is not None})
