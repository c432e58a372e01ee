"""Seasonal forecast per key: a trend that bends at changepoints, daily and weekly waves.

Every regressor is a function of the hour, so rows are first added up per key and hour (in whole
units: any order gives the same sums); the normal equations of all keys come from these cells in one
aggregate and are solved by elimination in column expressions. Nothing is collected, no Python runs
on the executors, and the number of keys is not bounded.

The fit is ridge regression on values divided by the key's largest absolute value, times 0..1 over
its span. A term of prior scale s is penalised by 1/s^2, which also keeps every system positive
definite: no pivot is ever zero, however few hours a key has. With ``multiplicative`` the model is
fitted on ln(1 + value), so trend and waves multiply.

Defined cases: rows without key, time or value (NaN too, values of -1 or less in a multiplicative
model) are left out; a key of one hour has a flat trend; a key whose values are all 0 forecasts 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitwright.functions.calendar import epoch_micros
from waitwright.lineage import cut
from waitwright.skew import join_unique

HOUR_MICROS = 3_600_000_000
# fixed: width of the 95 % interval in standard deviations
Z = 1.96


@dataclass(frozen=True)
class Season:
    # fixed: prior scales of changepoints and waves; both waves on, no yearly one
    changepoint_scale: float = 0.05
    season_scale: float = 10.0
    daily: int = 4
    weekly: int = 3
    # number of changepoints, evenly over the first part of a key's span
    changepoints: int = 25
    changepoint_share: float = 0.8
    trend_scale: float = 5.0
    multiplicative: bool = False
    digits: int = 6

    @property
    def terms(self) -> list[str]:
        waves = [f"{name}_{part}_{k}" for name, order in (("daily", self.daily),
                                                          ("weekly", self.weekly))
                 for k in range(1, order + 1) for part in ("sin", "cos")]
        return ["level", "slope", *(f"bend_{j}" for j in range(1, self.changepoints + 1)), *waves]

    @property
    def penalties(self) -> list[float]:
        waves = 2 * (self.daily + self.weekly)
        scales = ([self.trend_scale] * 2 + [self.changepoint_scale] * self.changepoints
                  + [self.season_scale] * waves)
        return [1.0 / (s * s) for s in scales]

    def bends(self) -> list[float]:
        return [self.changepoint_share * j / self.changepoints
                for j in range(1, self.changepoints + 1)]


def hourly_cells(df: DataFrame, by: tuple[str, ...], ts: str, value: str,
                 season: Season = Season()) -> DataFrame:
    """(by, hour, n, total, squared, largest): what the fit needs of a table, one row per key and hour.

    ``hour`` counts from 1970. Sums are whole units of 10^-digits, so cells of several files add up.
    """
    y = F.col(value).cast("double")
    shown = F.log1p(y) if season.multiplicative else y
    unit = F.lit(10.0 ** season.digits)
    rows = df.select(*by, F.floor(epoch_micros(df, ts) / F.lit(HOUR_MICROS)).alias("hour"),
                     F.round(shown * unit).cast("decimal(18,0)").alias("_u"), y.alias("_y"))
    known = rows.where(F.col("hour").isNotNull() & F.col("_u").isNotNull() & ~F.isnan("_y"))
    return known.dropna(subset=list(by)).groupBy(*by, "hour").agg(
        F.count("*").alias("n"), F.sum("_u").cast("decimal(38,0)").alias("total"),
        F.sum(F.col("_u") * F.col("_u")).cast("decimal(38,0)").alias("squared"),
        F.max(F.abs("_u")).alias("largest"))


def _spans(cells: DataFrame, by: tuple[str, ...], season: Season) -> DataFrame:
    unit = F.lit(10.0 ** season.digits)
    top = F.max("largest").cast("double") / unit
    return cells.groupBy(*by).agg(
        F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"),
        F.sum("n").alias("n"), F.when(top > 0, top).otherwise(1.0).alias("scale"))


def regressors(season: Season) -> Column:
    """Values of all terms at ``hour`` of a key with ``first_hour`` and ``last_hour``."""
    hour = F.col("hour")
    length = F.greatest(F.col("last_hour") - F.col("first_hour"), F.lit(1)).cast("double")
    t = (hour - F.col("first_hour")).cast("double") / length
    waves = [wave(F.lit(2.0 * math.pi * k) * (hour % period).cast("double") / F.lit(float(period)))
             for period, order in ((24, season.daily), (168, season.weekly))
             for k in range(1, order + 1) for wave in (F.sin, F.cos)]
    bends = [F.greatest(t - F.lit(s), F.lit(0.0)) for s in season.bends()]
    return F.array(F.lit(1.0), t, *bends, *waves)


def _solved(matrix: Column, size: int) -> Column:
    """Solution of a positive definite system, from its rows with the right side as last column."""
    def step(rows: Column, k: Column) -> Column:
        pivot = F.element_at(rows, k)
        scaled = F.transform(pivot, lambda v: v / F.element_at(pivot, k))
        less = lambda row: F.zip_with(row, scaled, lambda a, b: a - F.element_at(row, k) * b)
        return F.transform(rows, lambda row, i: F.when(i + 1 == k, scaled).otherwise(less(row)))

    reduced = F.aggregate(F.sequence(F.lit(1), F.lit(size)), matrix, step)
    return F.transform(reduced, lambda row: F.element_at(row, -1))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def fit_cells(cells: DataFrame, by: tuple[str, ...], season: Season = Season()) -> DataFrame:
    """(by, first_hour, last_hour, n, scale, deviation, weights) of each key, from hourly cells."""
    by, size = tuple(by), len(season.terms)
    cells = cut(cells)
    spans = cut(_spans(cells, by, season))
    unit = F.lit(10.0 ** season.digits) * F.col("scale")
    placed = join_unique(cells, spans.withColumnRenamed("n", "_all"), list(by), "inner").select(
        *by, F.col("n").cast("double").alias("w"), (F.col("total").cast("double") / unit).alias("y"),
        (F.col("squared").cast("double") / (unit * unit)).alias("yy"), regressors(season).alias("x"))
    # One row per term and cell; a task sums all it has of a key before the shuffle.
    long = placed.select(*by, "w", "y", "yy", "x", F.posexplode("x").alias("i", "xi"))
    right = F.sum(F.col("xi") * F.col("y"))
    rows = long.groupBy(*by, "i").agg(
        F.array(*(F.sum(F.col("w") * F.col("xi") * F.get("x", F.lit(j))) for j in range(size)),
                right).alias("row"), F.sum("yy").alias("yy"))
    penalties = F.array(*(F.lit(p) for p in season.penalties))
    ridged = F.transform("row", lambda v, j: F.when(
        j == F.col("i"), v + F.get(penalties, F.col("i"))).otherwise(v))
    # As many rows as terms for each key.
    systems = rows.select(*by, "i", "row", ridged.alias("ridged"), "yy").groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("i", "row", "ridged"))).alias("rows"),
        F.max("yy").alias("yy"))
    solved = cut(systems.withColumn("weights", _solved(F.col("rows.ridged"), size)))
    weights = F.col("weights")
    fitted = F.transform(F.col("rows.row"), lambda r: _dot(F.slice(r, 1, size), weights))
    rest = (F.col("yy") - F.lit(2.0) * _dot(weights, F.transform(
        F.col("rows.row"), lambda r: F.element_at(r, -1))) + _dot(weights, fitted))
    found = solved.select(*by, "weights", rest.alias("_rest"))
    return spans.join(found, list(by)).select(
        *by, "first_hour", "last_hour", "n", "scale",
        (F.sqrt(F.greatest(F.col("_rest"), F.lit(0.0)) / F.col("n")) * F.col("scale"))
        .alias("deviation"), "weights")


def fit(df: DataFrame, by: tuple[str, ...], ts: str, value: str,
        season: Season = Season()) -> DataFrame:
    """One fitted row per key; see ``fit_cells``."""
    return fit_cells(hourly_cells(df, by, ts, value, season), by, season)


def terms(fitted: DataFrame, by: tuple[str, ...], season: Season = Season()) -> DataFrame:
    """Long form of the weights: (by, term, weight)."""
    names = F.array(*(F.lit(t) for t in season.terms))
    return fitted.select(*by, F.posexplode("weights").alias("_at", "weight")).select(
        *by, F.get(names, F.col("_at")).alias("term"), "weight")


def predict(rows: DataFrame, fitted: DataFrame, by: tuple[str, ...],
            season: Season = Season()) -> DataFrame:
    """Adds ``forecast``, ``lower`` and ``upper`` to rows with the keys and ``hour``."""
    names = [*rows.columns]
    joined = join_unique(rows, fitted.select(*by, "first_hour", "last_hour", "scale", "deviation",
                                             "weights"), list(by), "left")
    value = _dot(regressors(season), F.col("weights")) * F.col("scale")
    wide = F.lit(Z) * F.col("deviation")
    back = F.expm1 if season.multiplicative else (lambda c: c)
    return joined.select(*names, back(value).alias("forecast"), back(value - wide).alias("lower"),
                         back(value + wide).alias("upper"))


def ahead(fitted: DataFrame, by: tuple[str, ...], hours: int,
          season: Season = Season()) -> DataFrame:
    """The ``hours`` that follow each key's last one, with ``hour_start`` as a UTC timestamp_ntz."""
    value = _dot(regressors(season), F.col("weights")) * F.col("scale")
    wide = F.lit(Z) * F.col("deviation")
    back = F.expm1 if season.multiplicative else (lambda c: c)
    coming = fitted.withColumn("hour", F.explode(F.sequence(
        F.col("last_hour") + 1, F.col("last_hour") + hours)))
    start = (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
             + F.make_dt_interval(hours=F.col("hour").cast("int")))
    return coming.select(*by, "hour", start.alias("hour_start"), back(value).alias("forecast"),
                         back(value - wide).alias("lower"), back(value + wide).alias("upper"))
