"""Named queries over the event and line-item tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waitwright.functions import arithmetic as af
from waitwright.functions import calendar as cal
from waitwright.functions import rules
from waitwright.lineage import cut, scratch_path
from waitwright.operators import allocate as al
from waitwright.operators import (
    boost, clean, drift, encode, explain, extra_trees, folds, forecast, model, moves, report, scale,
    score, sketches, split,
)
from waitwright.operators.lags import latest_per, with_history, with_history_stats
from waitwright.operators.ordering import arrange
from waitwright.plans.preprocess import (
    apply_prepared, fit_one_hot, load_prepared, prepare_splits, preprocess, save_prepared,
)
from waitwright.plans.training import train
from waitwright.settings import TARGET
from waitwright.sources import adapters as ad
from waitwright.sources import tables
from waitwright.streaming import cooldown as keyed
from waitwright.streaming import readings

AS_OF = datetime(2024, 1, 20)
ID = "patient_id"
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def _line(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/lineitem.parquet")


# --- cleaning ---------------------------------------------------------------------------------
@query
def dedupe_visits(spark, folder):
    return clean.remove_duplicates(ad.visits_dirty(spark, folder))


@query
def impute_visits(spark, folder):
    distinct = cut(clean.remove_duplicates(ad.visits_dirty(spark, folder)))
    return _rounded(clean.impute(distinct)[0], TARGET)


@query
def carry_calendar(spark, folder):
    number = F.col(ID)
    rows = ad.plain_visits(spark, folder).select(
        ID, "arrival_time",
        F.when(number % 5 != 0, F.hour("arrival_time")).alias("hour"),
        F.when((number % 7 != 0) & (number > 300), F.weekday("arrival_time")).alias("day_of_week"))
    return clean.carry_over_time(rows)


@query
def missing_cells(spark, folder):
    dirty = ad.visits_dirty(spark, folder)
    filled, _ = clean.impute(cut(dirty))
    before = clean.missing_cells(dirty).select(F.lit("before").alias("step"), "missing_values")
    after = clean.missing_cells(filled).select(F.lit("after").alias("step"), "missing_values")
    return before.unionByName(after)


@query
def quality_report(spark, folder):
    return clean.quality_report(ad.visits_dirty(spark, folder), AS_OF)


@query
def cleaning_stats(spark, folder):
    return clean.cleaning_stats(ad.visits_dirty(spark, folder))


@query
def outlier_iqr(spark, folder):
    return clean.filter_outliers(ad.plain_visits(spark, folder).select(ID, TARGET), TARGET)


@query
def outlier_quantile(spark, folder):
    return clean.filter_outliers(ad.plain_visits(spark, folder).select(ID, TARGET), TARGET,
                                 "quantile")


@query
def outlier_zscore(spark, folder):
    rows = clean.drop_missing_target(ad.visits_dirty(spark, folder).select(ID, TARGET))
    return clean.filter_deviation(rows, TARGET)


@query
def lineitem_distinct_prices(spark, folder):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return clean.cleaning_stats(_line(spark, folder).select(*columns))


@query
def lineitem_fences(spark, folder):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = _line(spark, folder).select("l_orderkey", "l_linenumber", *columns)
    return clean.within(rows, clean.fit_fences(rows, columns))


@query
def lineitem_quantile_range(spark, folder):
    rows = _line(spark, folder).select("l_orderkey", "l_linenumber", "l_extendedprice")
    return clean.filter_outliers(rows, "l_extendedprice", "quantile")


@query
def lineitem_deviation(spark, folder):
    rows = _line(spark, folder).select("l_orderkey", "l_linenumber", "l_extendedprice")
    return clean.filter_deviation(rows, "l_extendedprice", 1.5)


@query
def lineitem_correlation(spark, folder):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return _rounded(report.correlation_matrix(_line(spark, folder), columns), "correlation")


# --- features ---------------------------------------------------------------------------------
@query
def feat_temporal(spark, folder):
    return cal.with_calendar(ad.plain_visits(spark, folder).select(ID, "arrival_time"))


@query
def feat_cyclical(spark, folder):
    df = cal.with_calendar(ad.plain_visits(spark, folder).select(ID, "arrival_time"))
    names = ["hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos"]
    return _rounded(cal.with_cyclical(df).select(ID, *names), *names)


@query
def feat_interaction_a(spark, folder):
    df = af.with_interactions(ad.visits(spark, folder))
    return df.select(ID, "workload_index", "arrival_pressure", "efficiency_gap", "capacity_ratio",
                     "utilization_load")


@query
def feat_interaction_b(spark, folder):
    df = ad.plain_visits(spark, folder).withColumn("hour", F.hour("arrival_time"))
    return af.with_optional_interactions(df).select(
        ID, "queue_pressure", "counters_per_patient", "workload_index", "hour_queue_interaction",
        "efficiency_gap")


@query
def feat_transform(spark, folder):
    names = ["log_queue", "sqrt_arrivals", "log_service_time"]
    return _rounded(af.with_transforms(ad.visits(spark, folder)).select(ID, *names), *names)


@query
def feat_peak_flags(spark, folder):
    df = ad.plain_visits(spark, folder).select(ID, F.hour("arrival_time").alias("hour"))
    return df.withColumns(cal.peak_columns(F.col("hour")))


@query
def feat_threshold_flags(spark, folder):
    df = ad.timed_visits(spark, folder).select(ID, "arrival_rate", "total_counters_available")
    return scale.apply_flags(df, scale.fit_flags(df)).select(ID, "high_arrival_rate",
                                                             "low_capacity")


@query
def feat_util_onehot(spark, folder):
    df = ad.plain_visits(spark, folder).select(ID, "system_utilization")
    return af.with_utilization_bands(df)


@query
def feat_dept_onehot(spark, folder):
    df = ad.plain_visits(spark, folder).select(ID, "department")
    return fit_one_hot(df).apply(df)


@query
def encode_ordinal(spark, folder):
    df = cal.with_calendar(ad.plain_visits(spark, folder).select(
        ID, "arrival_time", "department", "patient_complexity"))
    return encode.encode_categories(df)[0].select(
        ID, "department_enc", "patient_complexity_enc", "time_period_enc")


@query
def encode_unseen(spark, folder):
    df = ad.plain_visits(spark, folder).select(ID, "department")
    known = encode.fit_encoder(df.where("department <> 'Emergency'"), ["department"])
    marked = encode.apply_encoder(df, known, ["department"], suffix="_marked")
    return encode.apply_encoder(marked, known, ["department"], unseen=0, suffix="_first").select(
        ID, "department_marked", "department_first")


@query
def encode_text_columns(spark, folder):
    df = ad.plain_visits(spark, folder).select(ID, "department", "patient_complexity")
    return encode.encode_in_place(df)[0]


@query
def standardize(spark, folder):
    columns = ["queue_length_at_arrival", "system_utilization", "doctor_efficiency"]
    df = ad.plain_visits(spark, folder).select(ID, *columns)
    return _rounded(scale.apply_scaler(df, scale.fit_scaler(df, columns)), *columns)


@query
def align_features(spark, folder):
    wanted = ["system_utilization", "not_recorded", "queue_length_at_arrival"]
    return af.aligned(ad.plain_visits(spark, folder), wanted, (ID,))


@query
def drop_identifiers(spark, folder):
    df = ad.timed_visits(spark, folder).drop("department")
    return af.without(df, "wait_time_minutes", "timestamp", ID)


def _history(spark, folder, *columns):
    rows = ad.plain_visits(spark, folder).select(ID, "arrival_time", TARGET,
                                                 "queue_length_at_arrival")
    built = with_history(arrange(rows, ("arrival_time", ID)), decimals=2).df
    return built.select(ID, *columns)


@query
def feat_lag(spark, folder):
    return _history(spark, folder, "prev_wait_1", "prev_wait_2")


@query
def feat_rolling_shifted(spark, folder):
    return _history(spark, folder, "rolling_wait_5", "rolling_wait_10")


@query
def feat_rolling_current(spark, folder):
    return _history(spark, folder, "rolling_queue_3", "rolling_queue_5")


@query
def feat_lag_median(spark, folder):
    rows = ad.plain_visits(spark, folder).select(
        ID, "arrival_time", F.col(TARGET).alias("wait_time_minutes"), "queue_length_at_arrival")
    built = with_history_stats(arrange(rows, ("arrival_time", ID)), decimals=2).df
    names = ["prev_wait_1", "prev_wait_2", "prev_queue_1", "prev_queue_2", "rolling_wait_5",
             "rolling_wait_10", "rolling_wait_std_5", "rolling_wait_std_10", "rolling_queue_5",
             "rolling_queue_10"]
    return _rounded(built.select(ID, *names), *names)


@query
def feature_matrix(spark, folder):
    prepared = preprocess(ad.visits_dirty(spark, folder), AS_OF, decimals=3)
    floats = [c for c, kind in prepared.matrix.dtypes if kind == "double"]
    return _rounded(prepared.matrix, *floats)


@query
def step_stats(spark, folder):
    return preprocess(ad.visits_dirty(spark, folder), AS_OF).stats.to_frame(spark)


@query
def command_features(spark, folder):
    df = af.with_command_features(ad.scoring_requests(spark, folder))
    irrational = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos",
                  "log_queue"]
    names = ["is_peak_hours", "is_evening", "is_weekend", "workload_index", "queue_pressure",
             "counters_per_patient", "efficiency_gap"]
    return _rounded(df.select("request_id", *names, *irrational), *irrational)


# --- files ------------------------------------------------------------------------------------
@query
def csv_visits(spark, folder):
    path = scratch_path(spark, "csv")
    rows = ad.plain_visits(spark, folder).select(
        ID, F.when(F.col(ID) % 10 == 0, F.lit("unknown")).otherwise(
            F.date_format("arrival_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("arrival_time"),
        "department", F.when(F.col(ID) % 9 != 0, F.col(TARGET)).alias(TARGET),
        "queue_length_at_arrival")
    rows.write.option("header", True).csv(path)
    return tables.read_visits_csv(spark, path, ordered=True).withColumn(
        "arrival_time", F.col("arrival_time").cast("timestamp_ntz"))


@query
def recommendation_csv(spark, folder):
    path = scratch_path(spark, "csv")
    tables.write_recommendations(al.recommend(_predictions(spark, folder)), path)
    written = spark.read.option("header", True).csv(path)
    return written.withColumn("Predicted Wait (min)",
                              F.round(F.col("`Predicted Wait (min)`").cast("double"), 6))


@query
def encoder_reload(spark, folder):
    path = scratch_path(spark, "encoder")
    df = ad.plain_visits(spark, folder).select(ID, "department", "patient_complexity")
    columns = ["department", "patient_complexity"]
    tables.save_encoder(encode.fit_encoder(df, columns), path)
    return encode.apply_encoder(df, tables.load_encoder(spark, path), columns, suffix="").select(
        ID, *columns)


# --- reports ----------------------------------------------------------------------------------
def _latest(spark, folder):
    return latest_per(ad.department_feed(spark, folder, arrivals=False), tie=ID)


@query
def latest_by_department(spark, folder):
    return latest_per(ad.department_feed(spark, folder), tie=ID)


@query
def live_kpis(spark, folder):
    return report.live_kpis(_latest(spark, folder), decimals=2)


@query
def dept_efficiency(spark, folder):
    return report.department_efficiency(ad.department_feed(spark, folder, False), decimals=2)


@query
def congestion_pivot(spark, folder):
    return report.congestion_pivot(ad.department_feed(spark, folder, False), decimals=2)


@query
def wait_correlation(spark, folder):
    columns = ["wait_time", "queue_length", "active_counters", "arrivals_per_hour"]
    return _rounded(report.correlation_matrix(ad.department_feed(spark, folder), columns),
                    "correlation")


@query
def wait_distribution(spark, folder):
    marks = report.wait_distribution(ad.department_feed(spark, folder, False))
    return _rounded(marks, "min", "q1", "median", "q3", "max")


@query
def trend_series(spark, folder):
    return report.trend_series(ad.department_feed(spark, folder, False))


@query
def target_summary(spark, folder):
    summary = report.target_summary(ad.plain_visits(spark, folder), TARGET)
    return _rounded(summary, "mean", "std", "min", "q1", "median", "q3", "max")


@query
def distinct_departments(spark, folder):
    return report.departments(ad.plain_visits(spark, folder))


# --- rules ------------------------------------------------------------------------------------
@query
def dept_status(spark, folder):
    wait = F.col("wait_time")
    return ad.department_feed(spark, folder, False).select(
        ID, "department", rules.status(wait).alias("status"), rules.urgency(wait).alias("urgency"),
        rules.action_hint(wait).alias("action_hint"))


@query
def threshold_alerts(spark, folder):
    return rules.threshold_alerts(_latest(spark, folder))


@query
def reading_alerts(spark, folder):
    return rules.reading_alerts(ad.department_feed(spark, folder, False)).select(
        ID, "level", "message")


@query
def wait_advice(spark, folder):
    wait, used = F.col(TARGET), F.col("system_utilization")
    return ad.plain_visits(spark, folder).select(
        ID,
        F.concat_ws(" | ", rules.wait_advice(wait, used, F.col("queue_length_at_arrival")))
        .alias("advice"),
        F.concat_ws(" | ", rules.screen_hints(wait, used)).alias("hints"))


@query
def alert_level(spark, folder):
    return ad.plain_visits(spark, folder).select(
        ID, rules.alert_level(F.col(TARGET), F.col("queue_length_at_arrival"))
        .alias("alert_level"))


# --- allocation -------------------------------------------------------------------------------
def _predictions(spark, folder):
    return ad.daily_departments(spark, folder).select(
        "snapshot", "department", F.col("wait_time").alias("predicted_wait"), "current_counters")


def _states(spark, folder):
    return al.department_states(ad.daily_departments(spark, folder))


def _counters(results: DataFrame, *more: str) -> DataFrame:
    return results.select("snapshot", "department", "current_counters", "recommended_counters",
                          *more)


@query
def alloc_greedy(spark, folder):
    return _counters(al.recommend(_predictions(spark, folder), "greedy"), "feasible")


@query
def alloc_weighted(spark, folder):
    return _counters(al.recommend(_predictions(spark, folder)), "feasible")


@query
def alloc_score_greedy(spark, folder):
    return _counters(al.allocate(_states(spark, folder)), "reasoning")


@query
def alloc_equality(spark, folder):
    return _counters(al.allocate(_states(spark, folder), "linear_programming"), "reasoning")


@query
def alloc_hybrid(spark, folder):
    return _counters(al.allocate(_states(spark, folder), "hybrid"), "reasoning", "alert_level")


@query
def alloc_states(spark, folder):
    partial = ad.daily_departments(spark, folder).withColumns({
        "utilization": F.when(F.col("department") != "OPD", F.col("utilization")),
        "current_counters": F.when(F.col("department") != "Emergency", F.col("current_counters")),
        "department": F.when(F.col("department") == "Pharmacy", "Annex")
        .otherwise(F.col("department"))})
    return al.department_states(partial).select(
        "snapshot", "department", "queue_length", "current_counters", "predicted_wait_time",
        "arrival_rate", "service_rate", "utilization")


@query
def alloc_staff_needed(spark, folder):
    return _states(spark, folder).select(
        "snapshot", "department", "current_counters", al.staff_needed().alias("needed"))


@query
def alloc_recommendations(spark, folder):
    return _rounded(al.recommend(_predictions(spark, folder)).drop("feasible"),
                    "predicted_wait_time", "expected_wait_reduction", "priority_score")


@query
def alloc_alerts(spark, folder):
    return rules.recommendation_alerts(al.recommend(_predictions(spark, folder))).select(
        "snapshot", "department", "alert", "message")


@query
def alloc_summary(spark, folder):
    summary = report.allocation_summary(al.allocate(_states(spark, folder), "hybrid"),
                                        decimals=6)
    lists = ["departments_needing_increase", "departments_can_decrease", "alerts_critical",
             "alerts_warning", "alerts_normal"]
    return summary.withColumns({c: F.array_join(c, ",") for c in lists})


@query
def alloc_long(spark, folder):
    return report.allocation_long(al.allocate(_states(spark, folder)))


@query
def alloc_response(spark, folder):
    return al.shaped(al.allocate(_states(spark, folder)))


def _runs(spark, folder):
    return ad.plain_visits(spark, folder).select(
        F.col("department").alias("site"), F.date_trunc("minute", "arrival_time")
        .cast("timestamp_ntz").alias("run_time"))


@query
def alloc_cooldown(spark, folder):
    return al.cooldown(_runs(spark, folder))


def _minute_states(spark, folder):
    return (
        ad.plain_visits(spark, folder).groupBy(
            F.lit("main").alias("site"), F.date_trunc("minute", "arrival_time")
            .cast("timestamp_ntz").alias("run_time"), "department")
        .agg(F.max(TARGET).alias("wait_time"),
             F.max("queue_length_at_arrival").cast("int").alias("queue_length"),
             F.max("system_utilization").alias("utilization"),
             F.min("total_counters_available").cast("int").alias("current_counters")))


def _response(results):
    return results.select("site", "run_time", "department", "current_counters",
                          "recommended_counters", "reasoning", "alert_level")


@query
def alloc_with_cooldown(spark, folder):
    states = al.department_states(_minute_states(spark, folder), by=("site", "run_time"))
    return _response(al.allocate_with_cooldown(states, al.cooldown(states)))


# --- scoring ----------------------------------------------------------------------------------
@query
def score_fallback(spark, folder):
    df = ad.plain_visits(spark, folder)
    counters = F.when(F.col(ID) % 13 == 0, F.lit(0)).otherwise(F.col("total_counters_available"))
    return df.select(ID, rules.queueing_estimate(
        F.col("queue_length_at_arrival"), counters, F.col(TARGET)).alias("prediction"))


@query
def score_intervals(spark, folder):
    df = ad.plain_visits(spark, folder).select(
        ID, (F.col(TARGET) - F.lit(10.0)).alias("raw"))
    clamped = df.withColumn("prediction", rules.non_negative(F.col("raw")))
    plain = rules.relative_interval(F.col("prediction"))
    shown = rules.relative_interval(F.col("prediction"), 2)
    return clamped.withColumns({
        **plain, "shown_lower": shown["lower"], "shown_upper": shown["upper"],
        **rules.normal_interval(F.col("prediction"))}).drop("raw")


@query
def score_contract(spark, folder):
    checked = af.with_request_check(ad.scoring_requests(spark, folder))
    return checked.select("request_id", "doctor_efficiency", "department",
                          F.array_join("violations", ",").alias("violations"))


@query
def serving_features(spark, folder):
    feed = ad.department_feed(spark, folder).withColumn(
        "active_counters", F.when(F.col(ID) % 19 != 0, F.col("active_counters")))
    df = af.with_reading_features(feed)
    irrational = ["hour_sin", "hour_cos", "day_sin", "day_cos", "log_queue", "sqrt_arrivals"]
    names = ["hour", "day_of_week", "is_weekend", "queue_length_at_arrival", "arrivals_this_hour",
             "system_utilization", "total_counters_available", "doctor_efficiency",
             "is_emergency", "queue_per_counter", "efficiency_load", "utilization_load"]
    return _rounded(df.select(ID, *names, *irrational), *irrational)


@query
def request_features(spark, folder):
    df = af.with_request_features(ad.scoring_requests(spark, folder))
    names = ["hour_sin", "hour_cos", "workload_index", "log_queue"]
    return _rounded(df.select("request_id", *names), *names)


@query
def department_predictions(spark, folder):
    return score.predict_departments(ad.department_feed(spark, folder), tie=ID)


# --- models -----------------------------------------------------------------------------------
@query
def split_hash(spark, folder):
    df = ad.plain_visits(spark, folder).select(ID)
    return split.split_in_two_steps(split.split_by_hash(df, ID).withColumnRenamed(
        "split", "banded"), ID).withColumnRenamed("split", "stepped")


@query
def split_time(spark, folder):
    df = ad.plain_visits(spark, folder).select(ID, "arrival_time")
    return split.split_by_time(df, "arrival_time").drop("arrival_time")


@query
def regression_metrics(spark, folder):
    df = ad.plain_visits(spark, folder).withColumn("prediction", rules.queueing_estimate(
        F.col("queue_length_at_arrival"), F.col("total_counters_available")))
    return _rounded(model.regression_metrics(df), "rmse", "mae", "r2", "mape")


_ORDER_INPUTS = ["lines", "quantity", "largest", "discount"]
_ORDER_VALUE = "price"


def _split_orders(spark, folder):
    """Value and shape of every order: a target that its inputs explain in part."""
    cents = lambda c: (F.sum(F.round(F.col(c) * 100).cast("bigint")) / 100).cast("double")
    orders = _line(spark, folder).groupBy(F.col("l_orderkey").alias("order")).agg(
        F.count("*").alias("lines"), cents("l_quantity").alias("quantity"),
        F.max("l_quantity").cast("double").alias("largest"),
        (cents("l_discount") / F.count("*")).alias("discount"),
        cents("l_extendedprice").alias(_ORDER_VALUE))
    return cut(split.split_by_hash(orders, "order"))


def _one_row(spark, **facts):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in facts.items()))


def _mean_rmse(data):
    return model.baseline_metrics(data, _ORDER_VALUE).first()["rmse"]


@query
def model_compare(spark, folder):
    """Facts of a comparison on whole orders, with all rounds of both boosters."""
    data = _split_orders(spark, folder)
    candidates = {"leafwise": model.boosted_leafwise(_ORDER_VALUE),
                  "symmetric": model.boosted_symmetric(_ORDER_VALUE)}
    run = model.train_and_compare(data, _ORDER_INPUTS, candidates, _ORDER_VALUE)
    rows = {r["model"]: r for r in run.metrics.collect()}
    mean_rmse = _mean_rmse(data)
    test = data.where("split = 'test'")
    scored = run.models[run.best].transform(test).where("prediction is not null")
    return _one_row(
        spark, candidates=len(rows), scored_rows=scored.count(),
        best_has_least_rmse=rows[run.best]["rmse"] == min(r["rmse"] for r in rows.values()),
        all_beat_mean=all(r["rmse"] < mean_rmse for r in rows.values()),
        rounds_within_limits=all(1 <= run.rounds[name] <= estimator.getMaxIter()
                                 for name, estimator in candidates.items()))


@query
def boost_tree(spark, folder):
    """First tree of the histogram booster on all training orders: cuts, rows and values."""
    train_rows = _split_orders(spark, folder).where("split = 'train'")
    fitted = boost.fit(train_rows, _ORDER_INPUTS, _ORDER_VALUE,
                       settings=boost.leafwise(rounds=1, leaves=4, depth=2))
    names = F.array(*(F.lit(n) for n in _ORDER_INPUTS))
    return fitted.nodes(spark).select(
        "node", F.when(F.col("feature") >= 0, F.get(names, F.col("feature"))).alias("feature"),
        "threshold", "n", F.round("value", 4).alias("value"))


@query
def boost_contributions(spark, folder):
    """What each input adds to the prediction of each test order, by the tree of ``boost_tree``."""
    data = _split_orders(spark, folder)
    fitted = boost.fit(data.where("split = 'train'"), _ORDER_INPUTS, _ORDER_VALUE,
                       settings=boost.leafwise(rounds=1, leaves=4, depth=2))
    long = explain.contributions(data.where("split = 'test'"), fitted, ("order",))
    return _rounded(long, "contribution", digits=3)


@query
def extra_trees_orders(spark, folder):
    """Predicted value of every test order by trees of hashed cuts."""
    data = _split_orders(spark, folder)
    forest = extra_trees.fit(data.where("split = 'train'"), _ORDER_INPUTS, _ORDER_VALUE,
                             extra_trees.Settings(trees=10, depth=6))
    return _rounded(forest.transform(data.where("split = 'test'")).select("order", "prediction"),
                    "prediction", digits=3)


def _bases(**rounds):
    return {"leafwise": model.boosted_leafwise(_ORDER_VALUE, **rounds),
            "symmetric": model.boosted_symmetric(_ORDER_VALUE, **rounds),
            "trees": model.randomised_trees(_ORDER_VALUE),
            "shallow": model.randomised_trees(_ORDER_VALUE, depth=4)}


@query
def model_stack(spark, folder):
    """Five folds, four bases, ridge over log predictions; tested on all test orders."""
    data = _split_orders(spark, folder)
    stack = model.fit_stack(data.where("split = 'train'"), _ORDER_INPUTS, _bases(),
                            label=_ORDER_VALUE, key="order")
    scored = cut(stack.transform(data.where("split = 'test'")))
    row = model.regression_metrics(scored, _ORDER_VALUE).first()
    return _one_row(spark, scored_rows=row["rows"], bases=len(stack.bases),
                    weights=len(stack.meta.stages[-1].coefficients),
                    beats_mean=row["rmse"] < _mean_rmse(data),
                    never_negative=scored.where("prediction < 0").isEmpty())


@query
def feature_importance(spark, folder):
    train_rows = model.assembled_rows(_split_orders(spark, folder).where("split = 'train'"),
                                      _ORDER_INPUTS)
    fitted = {name: model.fit_one(estimator, _ORDER_INPUTS, train_rows)
              for name, estimator in _bases(rounds=4).items()}
    table = cut(model.feature_importance(fitted, _ORDER_INPUTS, spark))
    path = scratch_path(spark, "importance")
    tables.write_importance(table, path)
    return tables.read_importance(spark, path).agg(
        F.count("*").alias("features"), F.round(F.sum("importance"), 6).alias("total"),
        F.max_by("feature", "importance").isin("lines", "quantity").alias("size_is_first"))


@query
def learning_curve(spark, folder):
    """Learn and test errors of a booster, written as training logs and read back."""
    data = _split_orders(spark, folder)
    fitted = model.fit_one(model.boosted_leafwise(_ORDER_VALUE, 15), _ORDER_INPUTS,
                           data.where("split = 'train'"))
    curve = cut(model.learning_curve(fitted, data.where("split = 'train'"),
                                     data.where("split = 'test'")))
    paths = {name: scratch_path(spark, name) for name in ("learn", "test")}
    for name, path in paths.items():
        (curve.select("iter", F.col(f"{name}_rmse").alias("RMSE")).write
         .option("header", True).option("sep", "\t").csv(path))
    logs = cut(tables.read_learning_curve(spark, paths["learn"], paths["test"]))
    errors = [r["test_rmse"] for r in logs.orderBy("iter").collect()]
    drop = F.min_by("learn_rmse", "iter") > F.max_by("learn_rmse", "iter")
    best = model.best_iteration(logs).first()
    return logs.agg(F.count("*").alias("rounds"), drop.alias("learn_error_falls")).withColumn(
        "best_agrees", F.lit(best["best_iteration"] == model.best_round(errors, len(errors))))


@query
def score_batch(spark, folder):
    """Every request scored by a model trained on all visits: what came back for it."""
    requests = ad.scoring_requests(spark, folder)
    names = ["queue_length_at_arrival", "total_counters_available", "system_utilization",
             "doctor_efficiency", "hour_sin", "hour_cos", "workload_index", "log_queue"]
    visits = ad.plain_visits(spark, folder).withColumns(
        {"hour": F.hour("arrival_time"), "day_of_week": F.weekday("arrival_time"),
         "month": F.month("arrival_time")})
    train_rows = cut(af.aligned(af.with_request_features(visits), names, (TARGET,)))
    scaler = scale.fit_scaler(train_rows, names)
    fitted = model.fit_one(model.randomised_trees(trees=20, depth=6), names,
                           scale.apply_scaler(train_rows, scaler))
    scored = score.score_requests(requests, fitted, names, scaler, ("request_id",),
                                  form="service")
    return _scored_facts(scored)


def _scored_facts(scored):
    """Per request: its violations, and whether a sound prediction with its interval came back."""
    wait = F.col("predicted_wait_time")
    sound = (wait >= 0) & (F.col("confidence_lower") <= wait) & (wait <= F.col("confidence_upper"))
    return scored.select("request_id", F.array_join("violations", ",").alias("violations"),
                         F.coalesce(sound, F.lit(False)).alias("predicted"))


@query
def score_prepared(spark, folder):
    """Requests scored by a linear model of the second layout, from its fitted state alone."""
    fitted = prepare_splits(ad.timed_visits(spark, folder))
    names = fitted.features
    trained = model.fit_one(LinearRegression(labelCol="wait_time_minutes"), names,
                            fitted.rows.where("split = 'train'"))
    checked = af.with_request_check(ad.scoring_requests(spark, folder))
    inputs = apply_prepared(checked, fitted, ("request_id", "department", "violations"))
    return _scored_facts(score.scored_requests(trained.transform(inputs), ("request_id",)))


@query
def prepared_requests(spark, folder):
    """Inputs of new requests under the state fitted by the second layout."""
    fitted = prepare_splits(ad.timed_visits(spark, folder))
    checked = af.with_request_check(ad.scoring_requests(spark, folder))
    names = ["department", "dept_OPD", "util_high", "low_capacity", "is_weekend", "log_queue",
             "workload_index", "hour_sin", "is_peak_hours"]
    inputs = apply_prepared(checked, fitted, ("request_id",))
    return _rounded(inputs.select(F.col("_kept_request_id").alias("request_id"), *names), *names,
                    digits=5)


@query
def prepared_reload(spark, folder):
    """The same inputs as ``prepared_requests`` from a saved and loaded preparation."""
    path = scratch_path(spark, "prepared")
    save_prepared(spark, path, prepare_splits(ad.timed_visits(spark, folder)))
    fitted = load_prepared(spark, path)
    names = ["department", "dept_OPD", "util_high", "low_capacity", "is_weekend", "log_queue",
             "workload_index", "hour_sin", "is_peak_hours"]
    checked = af.with_request_check(ad.scoring_requests(spark, folder))
    inputs = apply_prepared(checked, fitted, ("request_id",))
    return _rounded(inputs.select(F.col("_kept_request_id").alias("request_id"), *names), *names,
                    digits=5)


@query
def run_reload(spark, folder):
    """A saved run scores new rows as the run itself does, for every department."""
    feed = ad.department_feed(spark, folder)
    rows = cut(score.department_features(feed).withColumn(
        TARGET, F.col("wait_time").cast("double")))
    names = ["queue_length_at_arrival", "arrivals_this_hour", "total_counters_available"]
    encoder = encode.fit_encoder(feed.select("department"), ["department"])
    fitted = model.fit_one(model.randomised_trees(trees=5, depth=4), names, rows)
    path = scratch_path(spark, "run")
    tables.save_run(spark, path, fitted, names, encoder, scale.fit_scaler(rows, names),
                    scale.FlagLimits({}))
    loaded = tables.load_run(spark, path)
    ours = score.predict_departments(feed, fitted, names, encoder, ID)
    again = score.predict_departments(feed, loaded.model, loaded.features, loaded.encoder, ID)
    same = ours.join(again.withColumnRenamed("prediction", "_again"), "department")
    return same.select("department", (F.col("prediction") == F.col("_again")).alias("same"),
                       (F.col("prediction") >= 0).alias("predicted"))


@query
def training_summary(spark, folder):
    path = scratch_path(spark, "summary")
    run = train(ad.visits_dirty(spark, folder), _predictions(spark, folder), AS_OF,
                {"trees": model.randomised_trees(trees=20, depth=6)})
    tables.write_summary(spark, run.summary, path)
    return tables.read_metrics(spark, path).select(
        "status", "data.samples", "data.features", "model.name",
        (F.col("model.rmse") > 0).alias("has_error"),
        "allocation.recommendations_generated", "allocation.alerts_generated")


@query
def csv_strict(spark, folder):
    """Visits of the second layout, written as CSV and read strictly."""
    path = scratch_path(spark, "csv")
    stamp = F.date_format("arrival_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp")
    ad.plain_visits(spark, folder).select(ID, stamp, "department").write.option(
        "header", True).csv(path)
    return tables.read_timed_csv(spark, path).select(
        F.col(ID).cast("bigint").alias(ID),
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "department")


@query
def required_columns(spark, folder):
    """Which required columns the visits lack, with and without two of them."""
    visits = ad.visits(spark, folder)
    rows = visits.count()
    found = [("whole", tables.check_schema(visits)),
             ("reduced", tables.check_schema(visits.drop("department", TARGET)))]
    facts = [F.struct(F.lit(name).alias("name"), F.lit(valid).alias("valid"),
                      F.lit(",".join(sorted(missing))).alias("missing"), F.lit(rows).alias("rows"))
             for name, (valid, missing) in found]
    return spark.range(1).select(F.inline(F.array(*facts)))


@query
def allocation_history(spark, folder):
    """Results appended day by day and read back with their day."""
    path = scratch_path(spark, "history")
    results = cut(al.allocate(_states(spark, folder)).withColumn(
        "run_time", F.col("snapshot").cast("timestamp_ntz")))
    for odd in (0, 1, 0):  # a repeated run replaces itself
        al.append_history(results.where(F.dayofmonth("snapshot") % 2 == odd), path)
    return spark.read.parquet(path).select(
        "snapshot", "department", "current_counters", "recommended_counters",
        F.col("run_date").cast("date").alias("run_date"))


@query
def alloc_moves(spark, folder):
    states = ad.daily_departments(spark, folder).withColumnRenamed("wait_time", "predicted_wait")
    return _rounded(moves.reallocate(states), "wait_before", "wait_after")


@query
def drift_retrain(spark, folder):
    """Days on which the queueing estimate of a department has lost too much accuracy."""
    scored = ad.plain_visits(spark, folder).withColumn("prediction", rules.queueing_estimate(
        F.col("queue_length_at_arrival"), F.col("total_counters_available")))
    days = cut(drift.daily_moments(scored, ("department",), "arrival_time"))
    return _rounded(drift.retrain_days(days, ("department",)), "rmse", "base_rmse")


@query
def drift_span(spark, folder):
    """Accuracy per department over the whole span, from daily moments alone."""
    scored = ad.plain_visits(spark, folder).withColumn("prediction", rules.queueing_estimate(
        F.col("queue_length_at_arrival"), F.col("total_counters_available")))
    whole = drift.merge(drift.daily_moments(scored, ("department",), "arrival_time"),
                        ("department",))
    found = whole.select("department", "n", *[v.alias(k) for k, v in drift.measures().items()])
    return _rounded(found, "rmse", "mae", "bias", "r2")


_CV_GAP = 60.0


@query
def cv_folds(spark, folder):
    placed, _ = folds.with_folds(ad.plain_visits(spark, folder), "arrival_time", _CV_GAP)
    return placed.select(ID, "fold", "trains_from")


@query
def cv_metrics(spark, folder):
    rows = ad.plain_visits(spark, folder).select(
        "arrival_time", "queue_length_at_arrival", TARGET)
    return _rounded(folds.cross_validate(rows, "arrival_time", ["queue_length_at_arrival"], TARGET,
                                         gap_minutes=_CV_GAP), "rmse", "mae", "r2")


@query
def sketched_months(spark, folder):
    """Price quantiles of each month from daily sketches, held against their true ranks."""
    rows = _line(spark, folder).select(
        F.to_date("l_shipdate").alias("day"), F.trunc("l_shipdate", "month").alias("month"),
        "l_extendedprice")
    price, by = ["l_extendedprice"], ("month",)
    days = cut(sketches.sketch(rows, price, ("day",)))
    months = sketches.merge(days, price, (F.trunc("day", "month").alias("month"),))
    asked = cut(sketches.answer(months, price, [0.01, 0.25, 0.5, 0.75, 0.99], by))
    errors = sketches.rank_errors(rows, "l_extendedprice", asked, by)
    # Hundreds of answers: each within twice the bound that holds for 99 % of them.
    return errors.join(asked, ["month", "prob"]).select(
        "month", "prob", "rows", "n", (F.col("error") <= 2 * sketches.rank_bound()).alias("close"))


_WHERE = ("department",)


@query
def forecast_terms(spark, folder):
    """Trend, changepoints and waves of the waits of each department."""
    fitted = forecast.fit(ad.plain_visits(spark, folder), _WHERE, "arrival_time", TARGET)
    return _rounded(forecast.terms(fitted, _WHERE), "weight")


@query
def forecast_ahead(spark, folder):
    """The two days after the last reading of each department, with bounds."""
    fitted = forecast.fit(ad.plain_visits(spark, folder), _WHERE, "arrival_time", TARGET)
    return _rounded(forecast.ahead(fitted, _WHERE, 48), "forecast", "lower", "upper", digits=4)


@query
def prepared_splits(spark, folder):
    prepared = prepare_splits(ad.timed_visits(spark, folder), decimals=2)
    return _rounded(prepared.rows.select(ID, "split", "wait_time_minutes", *prepared.features),
                    *prepared.features, digits=5)


# --- streams ----------------------------------------------------------------------------------
def _feed_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    events = readings.stream_table(spark, folder, "events.parquet", schema)
    kind = F.col("event_type")
    place = (F.when(kind == "signup", "Diagnostics").when(kind == "purchase", "Pharmacy")
             .when(kind == "error", "Emergency").otherwise("OPD"))
    return events.select(
        F.col("ts").alias("timestamp"), place.alias("department"),
        (F.col("user_id") % 20).alias("queue_length"), F.col("value").alias("wait_time"),
        (F.col("event_id") % 6 + 2).alias("active_counters"), F.col("event_id").alias(ID))


def _drain(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    path, state = scratch_path(spark, "stream"), scratch_path(spark, "state")
    readings.write_stream(df, path, state, mode).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@query
def stream_latest(spark, folder):
    return _drain(spark, readings.latest_readings(_feed_stream(spark, folder)), "complete")


@query
def stream_congestion(spark, folder):
    drained = _drain(spark, readings.hourly_congestion(_feed_stream(spark, folder), decimals=2),
                     "complete")
    return drained.withColumn("hour_start", F.col("hour_start").cast("timestamp_ntz"))


@query
def stream_alerts(spark, folder):
    return _drain(spark, readings.alert_stream(_feed_stream(spark, folder)))


@query
def stream_allocation(spark, folder):
    path, history = scratch_path(spark, "states"), scratch_path(spark, "history")
    _minute_states(spark, folder).write.parquet(path)
    schema = spark.read.parquet(path).schema
    states = al.department_states(spark.readStream.schema(schema).parquet(path),
                                  by=("site", "run_time"))
    readings.allocate_batches(states, history, scratch_path(spark, "state")).awaitTermination()
    return _response(spark.read.parquet(history))


@query
def stream_allocation_keyed(spark, folder):
    """As ``stream_allocation``, with the last kept run of each site in the state store."""
    path, history = scratch_path(spark, "states"), scratch_path(spark, "history")
    _minute_states(spark, folder).write.parquet(path)
    schema = spark.read.parquet(path).schema
    states = al.department_states(spark.readStream.schema(schema).parquet(path),
                                  by=("site", "run_time"))
    keyed.allocate_keyed(states, history, scratch_path(spark, "state")).awaitTermination()
    return _response(spark.read.parquet(history))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Dirty visits to per-department efficiency: dedupe, quantile filter, calendar, report."""
    distinct = cut(clean.remove_duplicates(ad.visits_dirty(spark, folder)))
    kept = clean.filter_outliers(distinct, TARGET, "quantile")
    busy = cal.with_calendar(kept).withColumnsRenamed(
        {TARGET: "wait_time", "queue_length_at_arrival": "queue_length"})
    return report.department_efficiency(busy, decimals=2)


@query
def cleaned_efficiency(spark, folder):
    return flagship(spark, folder)


