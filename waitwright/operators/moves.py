"""Allocation when moving staff costs minutes: ranked gains of single counters per snapshot.

With k counters a department waits ``wait * current / k``, so counter k saves
``weight * wait * current / (k * (k - 1))`` weighted minutes, less than the one before. A counter
beyond those that stand there now costs ``move_cost`` minutes on top. Gains thus fall along a
department, with a step at its current count, and the best plan takes the largest positive gains
over all departments that the staff allows: no search, one ranking per snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waitwright.operators.allocate import BY, _settled
from waitwright.settings import DEPARTMENTS, Department, Thresholds

# fixed: minutes that moving one member of staff costs
MOVE_COST = 5.0


def expected_wait(wait: Column, current: Column, counters: Column) -> Column:
    """Wait after changing the number of counters, if the work stays the same."""
    return wait * F.greatest(current, F.lit(1)).cast("double") / counters.cast("double")


def bounded_by_use(df: DataFrame, by: tuple[str, ...], staff: int, limits: Thresholds) -> DataFrame:
    """Adds low and high: bounds that also keep utilisation within its limits.

    Counters above the lower limit of use are not staffed beyond it; the upper limit raises the
    minimum where the staff suffices for all raised minimums, otherwise the minimums stand.
    """
    used = F.col("utilization") * F.col("current_counters")
    least, most = F.greatest(F.col("min_counters"), F.lit(1)), F.col("max_counters")
    needed = F.coalesce(F.ceil(F.round(used / F.lit(limits.max_utilization), 9)), least)
    enough = F.coalesce(F.floor(F.round(used / F.lit(limits.min_utilization), 9)), most)
    raised = F.greatest(least, F.least(most, needed)).cast("int")
    group = Window.partitionBy(*by)
    fits = F.sum(raised).over(group) <= F.lit(staff)
    low = F.when(fits, raised).otherwise(least).cast("int")
    return df.withColumn("low", low).withColumn(
        "high", F.greatest("low", F.least(most, enough)).cast("int"))


def reallocate(states: DataFrame, *, by: tuple[str, ...] = BY, staff: int = Thresholds().total_staff,
               move_cost: float = MOVE_COST, departments: tuple[Department, ...] = DEPARTMENTS,
               limits: Thresholds = Thresholds(), position: str = "department") -> DataFrame:
    """Best counters per department with ``predicted_wait``, ``current_counters``, ``utilization``.

    Columns: by, department, current_counters, recommended_counters, moved (counters taken in),
    move_minutes, wait_before, wait_after, feasible (whether the minimums fit the staff). A null
    wait gains nothing; null counters count as none; ties go to the first position.
    """
    df = _settled(states, departments, False, limits).drop("listed_min").withColumns({
        "current_counters": F.coalesce(F.col("current_counters"), F.lit(0)).cast("int"),
        "predicted_wait": F.col("predicted_wait").cast("double")})
    df = bounded_by_use(df, by, staff, limits)
    group = Window.partitionBy(*by)
    df = df.withColumns({"spare": F.lit(staff) - F.sum("low").over(group),
                         "feasible": F.sum("low").over(group) <= F.lit(staff)})
    value = F.col("priority_weight") * F.col("predicted_wait") * F.greatest(
        F.col("current_counters"), F.lit(1)).cast("double")
    step = F.col("unit").cast("double")
    gain = value / (step * (step - 1.0)) - F.when(
        F.col("unit") > F.col("current_counters"), F.lit(float(move_cost))).otherwise(0.0)
    # One row per counter: bounded by the department list, not by the rows.
    units = (
        df.where("high > low").withColumn("unit", F.explode(F.sequence(F.col("low") + 1, "high")))
        .withColumn("gain", gain).where("gain > 0"))
    ranked = units.withColumn("rank", F.row_number().over(
        Window.partitionBy(*by).orderBy(F.desc("gain"), position, "unit")))
    taken = ranked.where("rank <= spare").groupBy(*by, "department").agg(
        F.count("*").cast("int").alias("more"))
    return (
        df.join(taken, [*by, "department"], "left")
        .withColumn("recommended_counters", F.col("low") + F.coalesce("more", F.lit(0)))
        .withColumn("moved", F.greatest(
            F.lit(0), F.col("recommended_counters") - F.col("current_counters")))
        .select(*by, "department", "current_counters", "recommended_counters", "moved",
                (F.col("moved") * F.lit(float(move_cost))).alias("move_minutes"),
                F.col("predicted_wait").alias("wait_before"),
                expected_wait(F.col("predicted_wait"), F.col("current_counters"),
                              F.col("recommended_counters")).alias("wait_after"), "feasible"))
