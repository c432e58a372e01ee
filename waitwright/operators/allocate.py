"""Staff allocation per snapshot as column arithmetic and one running sum.

With unit staff cost, handing out counters one at a time, the integer program and the
equality-constrained program all fill departments to their maximum in descending key
order; they differ in the key and in what counts as feasible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waitwright.functions.calendar import epoch_micros
from waitwright.functions.rounding import fixed_text, round_exact
from waitwright.functions.rules import alert_level
from waitwright.lineage import cut
from waitwright.operators.ordering import arrange, fill_backward
from waitwright.settings import DEPARTMENTS, Department, Thresholds

BY = ("snapshot",)
COOLING = "Cooldown period active"  # fixed text


def settings_frame(spark: SparkSession,
                   departments: tuple[Department, ...] = DEPARTMENTS) -> DataFrame:
    """The department dimension; it comes from the driver's own list, so it is small."""
    rows = [F.struct(
        F.lit(d.department).alias("department"), F.lit(d.min_counters).alias("min_counters"),
        F.lit(d.max_counters).alias("max_counters"),
        F.lit(float(d.avg_service_time)).alias("avg_service_time"),
        F.lit(float(d.priority_weight)).alias("priority_weight")) for d in departments]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _settled(df: DataFrame, departments: tuple[Department, ...], strict: bool,
             limits: Thresholds) -> DataFrame:
    """Attach staffing bounds; unlisted departments fail (strict) or take the defaults."""
    joined = df.join(F.broadcast(settings_frame(df.sparkSession, departments)),
                     "department", "left")
    if strict:
        known = F.col("min_counters").isNotNull()
        error = F.raise_error(F.concat(F.lit("no settings for department "),
                                       F.coalesce("department", F.lit("null")))).cast("int")
        return joined.withColumn("min_counters", F.when(known, F.col("min_counters"))
                                 .otherwise(error))
    defaults = {"min_counters": limits.default_min, "max_counters": limits.default_max,
                "avg_service_time": limits.default_service_time,
                "priority_weight": limits.default_weight}
    return joined.withColumns({
        "listed_min": F.col("min_counters"),
        **{c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}})


def _filled(key: Column, eligible: Column, by: tuple[str, ...], staff: Column,
            position: str) -> Column:
    """Counters after filling departments to their maximum in descending key order.

    A snapshot holds each department once, so a window never exceeds the department list.
    """
    low, high = F.col("min_counters"), F.col("max_counters")
    room = F.when(eligible, F.greatest(high - low, F.lit(0))).otherwise(0)
    group = Window.partitionBy(*by)
    ahead = (group.orderBy(key.desc(), F.col(position).asc())
             .rowsBetween(Window.unboundedPreceding, -1))
    spare = staff - F.sum(low).over(group)
    left = spare - F.coalesce(F.sum(room).over(ahead), F.lit(0))
    return (low + F.greatest(F.lit(0), F.least(room, left))).cast("int")


# --- first generation: predictions and weights ------------------------------------------------
def recommend(predictions: DataFrame, method: str = "linear_programming", *,
              by: tuple[str, ...] = BY, staff: int = Thresholds().total_staff,
              departments: tuple[Department, ...] = DEPARTMENTS,
              position: str = "department", ordered: bool = False) -> DataFrame:
    """Recommendations from ``predicted_wait`` and ``current_counters`` per department.

    ``linear_programming`` fills by weight, any other method by wait times weight. When the
    minimums alone exceed the staff every department keeps its minimum and ``feasible`` is
    false. Departments without settings or current counters fail the job.
    """
    df = _settled(predictions, departments, True, Thresholds())
    wait, weight = F.col("predicted_wait").cast("double"), F.col("priority_weight")
    total = F.lit(staff)
    priority = wait * weight
    if method == "linear_programming":
        counters = _filled(weight, weight > 0, by, total, position)
    else:
        counters = _filled(priority, F.lit(True), by, total, position)
    feasible = F.sum("min_counters").over(Window.partitionBy(*by)) <= total
    missing = F.raise_error(F.concat(F.lit("no current counters for department "),
                                     F.col("department"))).cast("int")
    current = F.coalesce(F.col("current_counters").cast("int"), missing)
    df = df.withColumns({"recommended_counters": counters, "feasible": feasible,
                         "current_counters": current, "predicted_wait_time": wait,
                         "priority_score": priority})
    change = F.col("recommended_counters") - F.col("current_counters")
    share = (-change).cast("double") / (F.col("current_counters") + 1).cast("double")
    df = df.withColumns({
        "action": F.when(change > 0, "increase").when(change < 0, "decrease")
        .otherwise("maintain"),
        "expected_wait_reduction": F.abs(wait * share),
    })
    df = df.withColumn("justification", justification())
    advice = df.select(*by, "department", "current_counters", "recommended_counters",
                       "predicted_wait_time", "expected_wait_reduction", "priority_score",
                       "action", "justification", "feasible")
    return advice.orderBy(*by, F.desc("priority_score")) if ordered else advice


def justification() -> Column:
    """Fixed sentence for each action."""
    wait = fixed_text(F.col("predicted_wait_time"), 1)
    now, then = F.col("current_counters"), F.col("recommended_counters")
    raised = F.format_string(
        "High predicted wait time (%s min). Increase counters from %d to %d to reduce congestion.",
        wait, now, then)
    lowered = F.format_string(
        "Low predicted wait time (%s min). Reduce counters from %d to %d "
        "to optimize staff utilization.", wait, now, then)
    kept = F.format_string(
        "Current allocation (%d counters) is optimal for predicted wait time (%s min).", now, wait)
    return (F.when(F.col("action") == "increase", raised)
            .when(F.col("action") == "decrease", lowered).otherwise(kept))


# --- second generation: department states -----------------------------------------------------
def department_states(predictions: DataFrame, current: DataFrame | None = None, *,
                      by: tuple[str, ...] = BY,
                      departments: tuple[Department, ...] = DEPARTMENTS,
                      limits: Thresholds = Thresholds()) -> DataFrame:
    """Readings with every gap filled, ready for allocation.

    ``current`` may hold the counters separately, keyed by ``by`` and department.
    """
    df = predictions
    if current is not None:
        df = df.drop("current_counters").join(current, [*by, "department"], "left")

    def reading(name: str, default: float, kind: str) -> Column:
        given = F.col(name) if name in df.columns else F.lit(None)
        return F.coalesce(given.cast(kind), F.lit(default).cast(kind))

    readings = {"queue_length": reading("queue_length", 0, "int"),
                "predicted_wait_time": reading("wait_time", 0.0, "double"),
                "arrival_rate": reading("arrival_rate", 1.0, "double"),
                "utilization": reading("utilization", 0.5, "double")}
    counters = (F.col("current_counters") if "current_counters" in df.columns
                else F.lit(None)).cast("int")
    df = _settled(df.withColumns({**readings, "reported_counters": counters}),
                  departments, False, limits)
    fallback = F.coalesce(F.col("listed_min"), F.lit(limits.default_current))
    return df.withColumns({
        "current_counters": F.coalesce(F.col("reported_counters"), fallback),
        "service_rate": F.lit(60.0) / F.col("avg_service_time"),
    }).drop("listed_min")


def _score(limits: Thresholds) -> Column:
    wait = F.col("predicted_wait_time") / F.lit(limits.ideal_wait) * F.lit(0.4)
    queue = F.col("queue_length") / F.lit(10.0) * F.lit(0.3)
    used = F.col("utilization") * F.lit(0.3)
    return (wait + queue + used) * F.col("priority_weight")


# fixed: sentences of the reasoning field, here and in ``allocate``
def change_reasoning() -> Column:
    change = F.col("recommended_counters") - F.col("current_counters")
    return (
        F.when(change > 0, F.format_string("Increase by %d counter(s) to reduce wait time", change))
        .when(change < 0, F.format_string("Decrease by %d counter(s) due to low utilization",
                                          F.abs(change)))
        .otherwise("Maintain current allocation")
    )


def allocate(states: DataFrame, method: str = "greedy", *, by: tuple[str, ...] = BY,
             limits: Thresholds = Thresholds(), position: str = "department",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Allocate ``total_staff`` within each snapshot.

    ``greedy`` fills by need score; ``linear_programming`` uses all staff exactly, filling by
    weight, and falls back to greedy where that cannot work; ``hybrid`` picks the latter only
    for snapshots with a critical department. Unknown methods mean greedy.
    """
    group, total = Window.partitionBy(*by), F.lit(limits.total_staff)
    score = _score(limits)
    greedy = _filled(score, score > F.lit(-1.0), by, total, position)
    if method in ("linear_programming", "hybrid"):
        exact = _filled(F.col("priority_weight"), F.lit(True), by, total, position)
        usable = ((F.sum("min_counters").over(group) <= total)
                  & (F.sum("max_counters").over(group) >= total))
        if method == "hybrid":
            critical = ((F.col("predicted_wait_time") > limits.critical_wait)
                        | (F.col("queue_length") > limits.queue_alert))
            usable = usable & F.max(critical).over(group)
        chosen = F.when(F.col("_exact"), F.col("_by_weight")).otherwise(F.col("_by_score"))
        df = states.withColumns({"_by_score": greedy, "_by_weight": exact, "_exact": usable})
        df = df.withColumn("recommended_counters", chosen)
        reasoning = F.when(F.col("_exact"), "Optimal LP allocation").otherwise(change_reasoning())
    else:
        df = states.withColumn("recommended_counters", greedy)
        reasoning = change_reasoning()
    df = df.withColumns({"reasoning": reasoning, "priority": F.col("priority_weight")})
    return _result(df, (*by, *keep), limits)


def _result(df: DataFrame, by: tuple[str, ...], limits: Thresholds) -> DataFrame:
    level = alert_level(F.col("predicted_wait_time"), F.col("queue_length"), limits)
    return df.withColumn("alert_level", level).select(
        *by, "department", "current_counters", "recommended_counters", "predicted_wait_time",
        F.col("queue_length").alias("predicted_queue_length"), "utilization", "priority",
        "reasoning", "alert_level")


def staff_needed(limits: Thresholds = Thresholds()) -> Column:
    """Counters one department needs on its own, from its state columns."""
    low, high, current = F.col("min_counters"), F.col("max_counters"), F.col("current_counters")
    rate, capacity = F.col("arrival_rate"), F.lit(60.0) / F.col("avg_service_time")
    staffed = F.coalesce(current > 0, F.lit(False))
    demand = rate + F.col("queue_length") / F.lit(limits.ideal_wait / 60)
    need = (F.when(F.col("predicted_wait_time") <= limits.ideal_wait,
                   F.when(staffed, current).otherwise(low))
            .otherwise(F.ceil(demand / capacity)))
    load = F.try_divide(rate, current * capacity)
    raised = F.greatest(need, F.ceil(current * (load / F.lit(limits.max_utilization))))
    lowered = F.least(need, F.greatest(low, current - 1))
    adjusted = (F.when(staffed & (load > limits.max_utilization), raised)
                .when(staffed & (load < limits.min_utilization) & (current > low), lowered)
                .otherwise(need))
    return F.greatest(low, F.least(high, adjusted)).cast("int")


def shaped(results: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Per-department response fields, rounded for display."""
    return results.select(
        *by, "department", "current_counters", "recommended_counters",
        round_exact(F.col("predicted_wait_time"), 2).alias("predicted_wait_time"),
        F.col("predicted_queue_length").alias("queue_length"),
        round_exact(F.col("utilization"), 3).alias("utilization"), "alert_level", "reasoning")


# --- cooldown ---------------------------------------------------------------------------------
COOLDOWN_BLOCK = 2048


def _successors(distinct: DataFrame, gap_us: int, site: str) -> DataFrame:
    """Runs numbered by site and time, each with the number of the first run a gap later."""
    numbered = arrange(distinct, (site, "_us")).df.select(
        F.col(site).alias("_site"), "_us", F.col("ord").alias("_n"))
    runs = numbered.select(
        "_site", F.col("_us").alias("_at"), F.lit(1).alias("_is_run"), "_n",
        F.struct(F.col("_site").alias("site"), F.col("_n").alias("n")).alias("_next"))
    due = numbered.select(
        "_site", (F.col("_us") + F.lit(gap_us)).alias("_at"), F.lit(0).alias("_is_run"), "_n",
        F.lit(None).cast(runs.schema["_next"].dataType).alias("_next"))
    timeline = arrange(runs.unionByName(due), ("_site", "_at", "_is_run", "_n"))
    found = fill_backward(timeline, ["_next"]).df.where("_is_run = 0").select(
        "_n", F.when(F.col("_next.site").eqNullSafe(F.col("_site")), F.col("_next.n"))
        .alias("_next"))
    return cut(numbered.join(found, "_n"))


def _exits(block: Column) -> Column:
    """For each run of a block (n, next), the first run of its chain beyond the block."""
    last = F.element_at(block, -1)["n"]
    walked = F.aggregate(
        F.reverse(block), F.array().cast("array<bigint>"),
        lambda acc, run: F.concat(F.array(F.when(
            run["next"] <= last, F.get(acc, (run["next"] - run["n"] - 1).cast("int")))
            .otherwise(run["next"])), acc))
    return F.zip_with(block, walked, lambda run, out: F.struct(
        run["n"].alias("entry"), out.alias("exit")))


def _marks(block: Column, entries: Column) -> Column:
    """(n, kept) of each run of a block that chains enter at ``entries``."""
    start = F.struct(F.lit(-1).cast("bigint").alias("due"),
                     F.array().cast("array<boolean>").alias("kept"))

    def step(state: Column, run: Column) -> Column:
        hit = (run["n"] == state["due"]) | F.array_contains(entries, run["n"])
        return F.struct(
            F.when(hit, F.coalesce(run["next"], F.lit(-1))).otherwise(state["due"]).alias("due"),
            F.concat(state["kept"], F.array(hit)).alias("kept"))

    return F.zip_with(block, F.aggregate(block, start, step)["kept"],
                      lambda run, kept: F.struct(run["n"].alias("n"), kept.alias("kept")))


def cooldown(runs: DataFrame, minutes: int = Thresholds().cooldown_minutes, *,
             ts: str = "run_time", site: str = "site", block_rows: int = COOLDOWN_BLOCK
             ) -> DataFrame:
    """Distinct runs per site with ``kept``: false while an earlier kept run cools down.

    A site's first run is kept, then always the first run a whole cooldown after the last kept
    one. Runs are numbered and lie in blocks of a fixed number of rows, whatever their site. Each
    block tells where a chain that enters at a run leaves it; these exits are few, as chains merge.
    Which of them the first runs reach is found by doubling the jumps; then every block marks the
    chain from its entry. No task ever holds more than a block.
    """
    distinct = runs.select(site, ts).distinct()
    distinct = cut(distinct.withColumn("_us", epoch_micros(distinct, ts)))
    linked = _successors(distinct, minutes * 60_000_000, site)
    number = F.floor(F.col("_n") / block_rows)
    blocks = cut(linked.groupBy(number.alias("_block")).agg(F.sort_array(F.collect_list(
        F.struct(F.col("_n").alias("n"), F.col("_next").alias("next")))).alias("_rows")))
    firsts = linked.groupBy("_site").agg(F.min("_n").alias("entry")).select("entry")
    exits = cut(blocks.select(F.inline(_exits(F.col("_rows")))))
    reached = cut(firsts)
    entries = exits.select(F.col("exit").alias("entry")).where("exit is not null").distinct()
    jumps = cut(exits.join(entries.unionByName(reached).distinct(), "entry")
                .where("exit is not null"))
    while True:
        more = cut(reached.join(jumps, "entry").select(F.col("exit").alias("entry")).distinct()
                   .join(reached, "entry", "left_anti"))
        if more.isEmpty():
            break
        reached = cut(reached.unionByName(more))
        onward = jumps.select(F.col("entry").alias("exit"), F.col("exit").alias("_far"))
        jumps = cut(jumps.join(onward, "exit").select("entry", F.col("_far").alias("exit")))
    entered = reached.groupBy(F.floor(F.col("entry") / block_rows).alias("_block")).agg(
        F.collect_list("entry").alias("_entries"))
    marked = blocks.join(entered, "_block", "left").select(F.inline(_marks(
        F.col("_rows"), F.coalesce("_entries", F.array().cast("array<bigint>"))))).select(
        F.col("n").alias("_n"), "kept")
    back = linked.join(marked, "_n").select("_site", F.col("_us").alias("_at"), "kept")
    same = F.col(site).eqNullSafe(F.col("_site")) & (F.col("_us") == F.col("_at"))
    return distinct.join(back, same).select(site, ts, "kept")


def allocate_with_cooldown(states: DataFrame, runs: DataFrame, method: str = "greedy", *,
                           by: tuple[str, ...] = ("site", "run_time"),
                           limits: Thresholds = Thresholds(),
                           position: str = "department") -> DataFrame:
    """Allocate kept runs; runs inside a cooldown report the current state instead."""
    flagged = states.join(runs.select(*by, "kept"), list(by))
    results = allocate(flagged, method, by=by, limits=limits, position=position,
                       keep=("kept", "reported_counters"))
    held = F.coalesce(F.col("reported_counters"), F.lit(limits.default_current))
    current = F.when(F.col("kept"), F.col("current_counters")).otherwise(held)
    return results.withColumns({
        "recommended_counters": F.when(F.col("kept"), F.col("recommended_counters"))
        .otherwise(held),
        "current_counters": current,
        "reasoning": F.when(F.col("kept"), F.col("reasoning"))
        .otherwise(COOLING),
    }).drop("kept", "reported_counters")


def append_history(results: DataFrame, path: str, ts: str = "run_time", run: str | None = None
                   ) -> None:
    """Keep every result, one folder per day and run.

    ``run`` names the column that tells runs apart (default: the run time). A run that is written
    again replaces itself; other runs and days are untouched.
    """
    named = results.withColumns({
        "run_date": F.to_date(ts), "run_id": F.col(run or ts).cast("string")})
    (named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_date", "run_id").parquet(path))
