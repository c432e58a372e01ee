"""Cross-validation in time: expanding training windows, a gap, and the rows that follow.

Fold i (from 1) of k tests the rows between the exact time quantiles i/(k+1) and (i+1)/(k+1) and
trains on all rows older than the gap before its first one. The gap should be as long as the
longest lag, so that no feature of a test row looks into the training rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitwright.functions.calendar import epoch_micros
from waitwright.operators.quantiles import quantile_values

# fixed: number of folds
FOLDS = 5


def fold_bounds(df: DataFrame, ts: str, folds: int = FOLDS) -> list[int]:
    """Microseconds of the first test row of each fold, then of the newest row."""
    probs = [round(i / (folds + 1), 10) for i in range(1, folds + 1)] + [1.0]
    micros = df.select(epoch_micros(df, ts).alias("us"))
    found = quantile_values(micros, ["us"], probs, method="lower")
    return [int(found[("us", p)]) for p in probs] if found else []


def test_fold(micros: Column, bounds: list[int]) -> Column:
    """Fold that tests a row; 0 for the oldest rows, which none tests."""
    return sum(((micros >= F.lit(b)).cast("int") for b in bounds[:-1]), F.lit(0))


def with_folds(df: DataFrame, ts: str, gap_minutes: float = 0.0, folds: int = FOLDS
               ) -> tuple[DataFrame, list[int]]:
    """Adds ``fold`` (which tests the row) and ``trains_from`` (first fold it may train).

    Rows of the gap before a fold train from the fold after it on; rows without a time have neither.
    """
    bounds = fold_bounds(df, ts, folds)
    micros = epoch_micros(df, ts)
    gap = F.lit(int(gap_minutes * 60_000_000))
    first = F.lit(1) + sum(((micros >= F.lit(b) - gap).cast("int") for b in bounds[:-1]), F.lit(0))
    return df.withColumns({"fold": test_fold(micros, bounds), "trains_from": first}), bounds


def ridge_by_fold(placed: DataFrame, features: list[str], label: str, folds: int = FOLDS,
                  alpha: float = 1.0) -> dict[int, tuple[float, list[float]]]:
    """Intercept and coefficients per fold, all from one aggregate over the rows.

    Each row is read once: its moments are summed by the first fold it trains, and a fold's normal
    equations are the sums up to it. The penalty leaves the intercept out. Incomplete rows are
    left out.
    """
    names = [*features, label]
    values = {c: F.col(c).cast("double") for c in names}
    whole = placed.where(F.col("trains_from").isNotNull()).dropna(subset=names)
    sums = [F.count("*").alias("n"), *[F.sum(values[c]).alias(f"s_{c}") for c in names]]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums += [F.sum(values[a] * values[b]).alias(f"s_{a}_{b}") for a, b in pairs]
    # As many rows as folds, of (features + 1)^2 numbers.
    rows = whole.groupBy("trains_from").agg(*sums).collect()
    fitted, size = {}, len(features)
    for fold in range(1, folds + 1):
        mine = [r for r in rows if r["trains_from"] <= fold]
        n = sum(r["n"] for r in mine)
        if not n:
            continue
        total = lambda name: sum(r[name] for r in mine)
        mean = np.array([total(f"s_{c}") for c in names]) / n
        cross = np.zeros((size + 1, size + 1))
        for a, b in pairs:
            i, j = names.index(a), names.index(b)
            cross[i, j] = cross[j, i] = total(f"s_{a}_{b}") - n * mean[i] * mean[j]
        weights = np.linalg.lstsq(cross[:size, :size] + alpha * np.eye(size), cross[:size, size],
                                  rcond=None)[0]
        fitted[fold] = (float(mean[size] - mean[:size] @ weights), [float(w) for w in weights])
    return fitted


def predictions_by_fold(placed: DataFrame, features: list[str],
                        fitted: dict[int, tuple[float, list[float]]]) -> DataFrame:
    """Test rows with the prediction of their own fold's model."""
    value = F.lit(None).cast("double")
    for fold, (constant, weights) in fitted.items():
        linear = sum((F.lit(w) * F.col(c) for w, c in zip(weights, features)), F.lit(constant))
        value = F.when(F.col("fold") == fold, linear).otherwise(value)
    return placed.where("fold > 0").withColumn("prediction", value)


def fold_metrics(scored: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Rows, RMSE, MAE and R2 of all folds in one aggregate."""
    y, p = F.col(label).cast("double"), F.col(prediction)
    squared = F.avg((y - p) * (y - p))
    return scored.where(y.isNotNull() & p.isNotNull()).groupBy("fold").agg(
        F.count("*").alias("rows"), F.sqrt(squared).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"),
        (F.lit(1.0) - F.try_divide(squared, F.var_pop(y))).alias("r2"))


def cross_validate(df: DataFrame, ts: str, features: list[str], label: str, *,
                   gap_minutes: float = 0.0, folds: int = FOLDS, alpha: float = 1.0) -> DataFrame:
    """Metrics per fold of a ridge model: two passes over the rows, however many folds."""
    placed, _ = with_folds(df, ts, gap_minutes, folds)
    fitted = ridge_by_fold(placed, features, label, folds, alpha)
    return fold_metrics(predictions_by_fold(placed, features, fitted), label)
