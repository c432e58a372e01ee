"""Dashboards as tables: KPIs, pivots, correlations, distributions, summaries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitwright.functions.rounding import round_scaled
from waitwright.operators.quantiles import exact_quantiles
from waitwright.operators.sketches import approximate_quantiles

# Fixed verdict texts.
VERDICTS = {
    "queue_verdict": ("✓ Normal", "⚠ High"),
    "wait_verdict": ("✓ Good", "⚠ Above Target"),
    "efficiency_verdict": ("✓ Optimal", "⚠ Below Target"),
}


def mean_of(column: str, decimals: int | None = None) -> Column:
    """Mean; with ``decimals`` added up in whole units, so that it never depends on row order."""
    if decimals is None:
        return F.avg(column)
    scale = F.lit(float(10 ** decimals))
    units = F.sum(F.round(F.col(column) * scale).cast("bigint")).cast("double")
    return F.try_divide(units, scale * F.count(column).cast("double"))


def efficiency(avg_wait: Column) -> Column:
    """Percentage of an hour not spent waiting, at least 0."""
    share = (F.lit(1.0) - avg_wait / F.lit(60.0)) * F.lit(100.0)
    return F.when(share < 0, F.lit(0.0)).otherwise(share)


def live_kpis(latest: DataFrame, decimals: int | None = None) -> DataFrame:
    """One row over the newest reading of each department, with verdicts."""
    totals = latest.agg(
        F.sum("queue_length").alias("total_queue"), mean_of("wait_time", decimals).alias("avg_wait"),
        F.sum("active_counters").alias("total_counters"),
    ).withColumn("efficiency", efficiency(F.col("avg_wait")))
    tests = {"queue_verdict": F.col("total_queue") < 50, "wait_verdict": F.col("avg_wait") < 20,
             "efficiency_verdict": F.col("efficiency") > 70}
    return totals.withColumns({
        name: F.when(test, VERDICTS[name][0]).otherwise(VERDICTS[name][1])
        for name, test in tests.items()})


def department_efficiency(feed: DataFrame, decimals: int | None = None) -> DataFrame:
    per = feed.groupBy("department").agg(mean_of("wait_time", decimals).alias("avg_wait"),
                                         mean_of("queue_length", 0 if decimals else None)
                                         .alias("avg_queue"))
    return per.withColumn("efficiency", efficiency(F.col("avg_wait")))


def congestion_pivot(feed: DataFrame, decimals: int | None = None) -> DataFrame:
    """Mean wait per department and hour of day, one column per hour."""
    hours = list(range(24))
    wide = (
        feed.groupBy("department").pivot("hour", hours).agg(mean_of("wait_time", decimals))
        if "hour" in feed.columns else
        feed.withColumn("hour", F.hour("timestamp")).groupBy("department").pivot("hour", hours)
        .agg(mean_of("wait_time", decimals))
    )
    return wide.withColumnsRenamed({str(h): f"hour_{h}" for h in hours})


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair over the rows where both are known, in long form.

    A column without spread has no correlation: null rather than a failed division.
    """
    aggregates, values = [], {}
    for a, b in combinations(columns, 2):
        left, right = F.col(a).cast("double"), F.col(b).cast("double")
        both = left.isNotNull() & right.isNotNull()
        spread = (F.stddev_pop(F.when(both, left)) * F.stddev_pop(F.when(both, right)))
        aggregates.append(F.try_divide(F.covar_pop(left, right), spread).alias(f"{a}|{b}"))
    for a in columns:
        spread = F.stddev_pop(F.col(a).cast("double"))
        aggregates.append(F.when(spread > 0, F.lit(1.0)).alias(f"{a}|{a}"))
    for a in columns:
        for b in columns:
            values[(a, b)] = f"{a}|{b}" if (columns.index(a) <= columns.index(b)) else f"{b}|{a}"
    cells = [F.struct(F.lit(a).alias("row"), F.lit(b).alias("column"),
                      F.col(f"`{name}`").alias("correlation"))
             for (a, b), name in values.items()]
    return df.agg(*aggregates).select(F.inline(F.array(*cells)))


def wait_distribution(feed: DataFrame, value: str = "wait_time",
                      sketch: int | None = None) -> DataFrame:
    """Minimum, quartiles and maximum per department; ``sketch``: approximate quartiles."""
    names = {0.0: "min", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "max"}
    by = ("department",)
    marks = (exact_quantiles(feed, [value], list(names), by=by) if sketch is None
             else approximate_quantiles(feed, [value], list(names), by, sketch).where("n > 0"))
    return marks.groupBy("department").agg(*[
        F.max(F.when(F.col("prob") == F.lit(prob), F.col("value"))).alias(name)
        for prob, name in names.items()])


def trend_series(feed: DataFrame, ordered: bool = False) -> DataFrame:
    """Wait and queue of every department over time, in long form; sorted if asked for."""
    points = feed.select("timestamp", "department", F.col("wait_time").cast("double"),
                         F.col("queue_length").cast("double"))
    long = points.unpivot(["timestamp", "department"], ["wait_time", "queue_length"],
                          "series", "value")
    return long.orderBy("department", "series", "timestamp") if ordered else long


def target_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, sample deviation, minimum, quartiles, maximum."""
    moments = df.agg(F.count(column).alias("count"), F.avg(column).alias("mean"),
                     F.stddev_samp(column).alias("std"), F.min(column).alias("min"),
                     F.max(column).alias("max"))
    marks = exact_quantiles(df, [column], [0.25, 0.5, 0.75]).agg(*[
        F.max(F.when(F.col("prob") == F.lit(p), F.col("value"))).alias(name)
        for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]).first()
    return moments.withColumns({name: F.lit(marks[name]).cast("double")
                                for name in ("q1", "median", "q3")})


def departments(df: DataFrame) -> DataFrame:
    return df.select("department").distinct()


def allocation_summary(results: DataFrame, by: tuple[str, ...] = ("snapshot",),
                       decimals: int | None = None) -> DataFrame:
    """Totals and department lists of each allocation run."""
    change = F.col("recommended_counters") - F.col("current_counters")

    def names(condition: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(condition, F.col("department"))))

    return results.groupBy(*by).agg(
        F.sum("current_counters").alias("total_staff_current"),
        F.sum("recommended_counters").alias("total_staff_recommended"),
        F.sum(change).alias("staff_change"),
        round_scaled(mean_of("predicted_wait_time", decimals), 2).alias("average_wait_time"),
        names(change > 0).alias("departments_needing_increase"),
        names(change < 0).alias("departments_can_decrease"),
        *[names(F.col("alert_level") == level).alias(f"alerts_{level}")
          for level in ("critical", "warning", "normal")],
    )


def allocation_long(results: DataFrame, by: tuple[str, ...] = ("snapshot",)) -> DataFrame:
    """Current and recommended counters as two series."""
    renamed = results.select(*by, "department", F.col("current_counters").alias("Current"),
                             F.col("recommended_counters").alias("Recommended"))
    return renamed.unpivot([*by, "department"], ["Current", "Recommended"], "series", "counters")
