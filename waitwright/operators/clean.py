"""Duplicate removal, imputation, outlier filters and data-quality reports.

Every ``fit_*`` returns a handful of scalars per column, so applying one is a plain
projection or filter with literals: no join, and filters can reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waitwright.operators.ordering import arrange, fill_both_ways
from waitwright.operators.quantiles import quantile_values
from waitwright.operators.sketches import approximate_values
from waitwright.settings import (
    ARRIVAL, CARRIED_COLUMNS, FENCE_FACTOR, QUANTILE_RANGE, TARGET, VISIT_ID, Z_LIMIT,
)


def _of_type(df: DataFrame, kind: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kind)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark keeps NaN and null apart; here both mean missing."""
    floats = [*_of_type(df, T.DoubleType), *_of_type(df, T.FloatType)]
    fixed = {c: F.when(~F.isnan(c), F.col(c)) for c in floats}
    return df.withColumns(fixed) if fixed else df


def remove_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_missing_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.dropna(subset=[target])


def _missing(columns: list[str]) -> Column:
    """Missing cells of one row."""
    return reduce(add, [F.col(c).isNull().cast("bigint") for c in columns])


def missing_cells(df: DataFrame) -> DataFrame:
    """One row: missing cells over all columns."""
    return df.agg(F.coalesce(F.sum(_missing(df.columns)), F.lit(0)).alias("missing_values"))


# --- imputation -----------------------------------------------------------------------------
@dataclass(frozen=True)
class FillValues:
    """Fitted replacement per column, and how many cells of the fitted rows they fill."""

    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    filled: int = 0


def _modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest on ties; ``Unknown`` when there is none."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]))
    counts = (
        df.select(pairs.alias("pair")).select("pair.*").where("value is not null")
        .groupBy("column", "value").agg(F.count("*").alias("cnt"))
    )
    best = counts.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("value"))
    found = {row["column"]: row["value"] for row in best.collect()}
    return {c: found.get(c, "Unknown") for c in columns}


def count_gaps(df: DataFrame) -> dict[str, int]:
    """Missing cells per column that has both missing and known cells, or only missing text."""
    counts = df.agg(F.count("*").alias("_rows"), *[
        F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    texts = _of_type(df, T.StringType)
    return {c: counts[c] for c in df.columns
            if counts[c] and (c in texts or counts[c] < counts["_rows"])}


def fit_fill(df: DataFrame, gaps: dict[str, int] | None = None) -> FillValues:
    """Median of every numeric and mode of every string column that has a gap."""
    gaps = count_gaps(df) if gaps is None else gaps
    numeric = [c for c in _of_type(df, T.NumericType) if c in gaps]
    texts = [c for c in _of_type(df, T.StringType) if c in gaps]
    medians = quantile_values(df, numeric, [0.5]) if numeric else {}
    return FillValues(
        medians={column: value for (column, _), value in medians.items()},
        modes=_modes(df, texts) if texts else {},
        filled=sum(gaps[c] for c in (*numeric, *texts)),
    )


def apply_fill(df: DataFrame, fill: FillValues) -> DataFrame:
    """Fill gaps; a filled integer column becomes double, since its median may be fractional."""
    replaced: dict[str, Column] = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fill.medians.items()}
    replaced |= {c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.modes.items()}
    return df.withColumns(replaced) if replaced else df


def carry_over_time(df: DataFrame, order: tuple[str, ...] = (ARRIVAL, VISIT_ID),
                    columns: tuple[str, ...] = CARRIED_COLUMNS,
                    gaps: dict[str, int] | None = None) -> DataFrame:
    """Fill given calendar columns from the previous, else the next, row in time."""
    given = [c for c in columns if c in df.columns]
    if not given:
        return df
    gaps = count_gaps(df.select(*given)) if gaps is None else gaps
    broken = [c for c in given if c in gaps]
    return fill_both_ways(arrange(df, order), broken).df.drop("ord") if broken else df


def impute(df: DataFrame, order: tuple[str, ...] = (ARRIVAL, VISIT_ID)
           ) -> tuple[DataFrame, FillValues]:
    """Carry calendar columns over time, then fill by median and mode."""
    gaps = count_gaps(df)
    carried = sum(n for c, n in gaps.items() if c in CARRIED_COLUMNS)
    df = carry_over_time(df, order, gaps=gaps)
    fill = fit_fill(df, {c: n for c, n in gaps.items() if c not in CARRIED_COLUMNS})
    return apply_fill(df, fill), replace(fill, filled=fill.filled + carried)


# --- outlier filters ------------------------------------------------------------------------
@dataclass(frozen=True)
class Bounds:
    """Inclusive range kept by an outlier filter."""

    column: str
    lower: float | None
    upper: float | None


def _marks(df: DataFrame, columns: list[str], probs: list[float], sketch: int | None):
    if sketch is None:
        return quantile_values(df, columns, probs)
    return approximate_values(df, columns, probs, sketch)


def fit_fences(df: DataFrame, columns: list[str], sketch: int | None = None) -> list[Bounds]:
    """Quartiles widened by 1.5 interquartile ranges; ``sketch``: approximate, of that size."""
    marks = _marks(df, columns, [0.25, 0.75], sketch)
    bounds = []
    for c in columns:
        first, third = marks.get((c, 0.25)), marks.get((c, 0.75))
        if first is None:
            bounds.append(Bounds(c, None, None))
            continue
        reach = FENCE_FACTOR * (third - first)
        bounds.append(Bounds(c, first - reach, third + reach))
    return bounds


def fit_quantile_range(df: DataFrame, columns: list[str],
                       span: tuple[float, float] = QUANTILE_RANGE,
                       sketch: int | None = None) -> list[Bounds]:
    marks = _marks(df, columns, list(span), sketch)
    return [Bounds(c, marks.get((c, span[0])), marks.get((c, span[1]))) for c in columns]


def within(df: DataFrame, bounds: list[Bounds]) -> DataFrame:
    """Rows inside every range; rows with a null in a tested column are dropped."""
    tests = [F.col(b.column).between(F.lit(b.lower), F.lit(b.upper)) for b in bounds]
    return df.where(reduce(and_, tests))


def filter_outliers(df: DataFrame, column: str, method: str = "iqr",
                    sketch: int | None = None) -> DataFrame:
    """``iqr`` or ``quantile``; any other method keeps the table as it is.

    Quantiles are exact unless ``sketch`` asks for approximate ones, of that size.
    """
    fits = {"iqr": fit_fences, "quantile": fit_quantile_range}
    return within(df, fits[method](df, [column], sketch=sketch)) if method in fits else df


def filter_deviation(df: DataFrame, column: str, limit: float = Z_LIMIT,
                     enabled: bool = True) -> DataFrame:
    """Rows strictly less than ``limit`` sample deviations from the mean.

    A constant column has no deviation to measure by and loses every row.
    """
    if not enabled or column not in df.columns:
        return df
    value = F.col(column).cast("double")
    fitted = df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).first()
    if not fitted["std"]:
        return df.where(F.lit(False))
    score = F.abs((value - F.lit(fitted["mean"])) / F.lit(fitted["std"]))
    return df.where(score < F.lit(limit))


# --- reports --------------------------------------------------------------------------------
def quality_report(df: DataFrame, as_of: datetime, target: str = TARGET,
                   arrival: str = ARRIVAL) -> DataFrame:
    """One row of quality counts and a score from 0 to 100.

    Grouping identical rows yields the duplicates, and every other count is weighted by the
    group sizes, so one shuffle serves all of them and many copies shrink before it.
    """
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    weight = F.col("_copies")

    def rows_where(column: str, condition: Column) -> Column:
        hits = F.sum(F.when(condition, weight).otherwise(0)) if column in df.columns else F.lit(0)
        return F.coalesce(hits, F.lit(0)).cast("bigint")

    moment = F.lit(as_of)
    if arrival in df.columns:
        moment = moment.cast(df.schema[arrival].dataType)
    # fixed: field names of the report
    report = copies.agg(
        F.coalesce(F.sum(weight), F.lit(0)).alias("total_records"),
        F.coalesce(F.sum(weight * _missing(df.columns)), F.lit(0)).alias("missing_values"),
        F.coalesce(F.sum(weight - 1), F.lit(0)).alias("duplicate_rows"),
        rows_where(target, F.col(target) < 0).alias("negative_waiting_times"),
        rows_where(arrival, F.col(arrival) > moment).alias("future_dates"),
        F.lit(0).cast("bigint").alias("invalid_departments"),
    )
    issues = (F.col("missing_values") + F.col("duplicate_rows")
              + F.col("negative_waiting_times") + F.col("future_dates"))
    share = F.try_divide(issues.cast("double"), F.col("total_records").cast("double"))
    return report.withColumn(
        "data_quality_score", F.greatest(F.lit(0.0), F.lit(100.0) - share * F.lit(100.0)))


@dataclass
class StepStats:
    """Row counts gathered along a cleaning run."""

    values: dict[str, int] = field(default_factory=dict)

    def put(self, name: str, value: int) -> None:
        self.values[name] = int(value)

    def to_frame(self, spark) -> DataFrame:
        entries = [F.struct(F.lit(k).alias("metric"), F.lit(v).cast("bigint").alias("value"))
                   for k, v in self.values.items()]
        return spark.range(1).select(F.inline(F.array(*entries)))


def cleaning_stats(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows, duplicates and their percentage, missing cells left."""
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    counted = copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("original_size"),
        F.count("*").alias("distinct_size"),
        F.coalesce(F.sum(_missing(df.columns)), F.lit(0)).alias("missing_after_dedupe"),
    )
    removed = F.col("original_size") - F.col("distinct_size")
    percent = F.try_divide(removed.cast("double"), F.col("original_size").cast("double"))
    return counted.withColumns({"duplicates_removed": removed,
                                "duplicate_percent": percent * F.lit(100.0)})
