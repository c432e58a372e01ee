import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waitwright.functions import arithmetic as af
from waitwright.functions import calendar as cal
from waitwright.functions import rules
from waitwright.functions.rounding import fixed_text, round_exact, round_scaled


def column(df, expression):
    return [row[0] for row in df.select(expression).collect()]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(
    st.floats(0, 1e6), st.integers(0, 10 ** 6).map(lambda n: n / 100),
    st.integers(0, 10 ** 6).map(lambda n: n / 1000)), min_size=50, max_size=200))
def test_rounding_equals_python(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert column(df, fixed_text(F.col("v"), 1)) == [f"{v:.1f}" for v in values]
    assert column(df, round_exact(F.col("v"), 2)) == [round(v, 2) for v in values]
    np.testing.assert_array_equal(column(df, round_scaled(F.col("v"), 2)), np.round(values, 2))


def test_negative_text(table):
    df = table("v double", [(-2.25,), (None,)])
    assert column(df, fixed_text(F.col("v"), 1)) == ["-2.2", None]


def test_time_periods(table):
    hours = [5, 6, 8, 9, 11, 12, 16, 17, 19, 20]
    df = table("h int", [(h,) for h in hours])
    assert column(df, cal.time_period(F.col("h"))) == [
        "night", "early_morning", "early_morning", "peak_morning", "peak_morning", "afternoon",
        "afternoon", "evening", "evening", "night"]


def test_utilization_bands_equal_pandas(table):
    values = [0.0, 0.5, 0.75, 0.76, 0.9, 1.0, 1.1, None]
    df = af.with_utilization_bands(table("system_utilization double", [(v,) for v in values]))
    names = ["low", "medium", "high", "critical"]
    cut = pd.cut(pd.Series(values, dtype=float), [0, 0.5, 0.75, 0.9, 1.0], labels=names)
    expected = pd.get_dummies(cut, prefix="util")
    got = df.toPandas()
    for name in names:
        assert got[f"util_{name}"].tolist() == expected[f"util_{name}"].tolist()


def test_calendar_equals_pandas(spark):
    stamps = pd.date_range("2020-12-25", "2021-01-10", freq="7h")
    df = spark.createDataFrame([(t.to_pydatetime(),) for t in stamps], "t timestamp_ntz")
    got = cal.with_calendar(df, "t").toPandas()
    assert got["week_of_year"].tolist() == stamps.isocalendar().week.tolist()
    assert got["day_of_week"].tolist() == stamps.dayofweek.tolist()
    assert got["is_weekend"].tolist() == (stamps.dayofweek >= 5).astype(int).tolist()


def test_epoch_micros_ignore_the_session_zone(spark):
    stamps = [pd.Timestamp("2024-03-31 02:30:00.123456"), pd.Timestamp("1969-12-31 23:59:59.5")]
    df = spark.createDataFrame([(t.to_pydatetime(),) for t in stamps], "t timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert column(df, cal.epoch_micros(df, "t")) == [t.value // 1000 for t in stamps]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_optional_columns_stay_optional(table):
    df = af.with_optional_interactions(table("queue_length_at_arrival int, hour int", [(4, 3)]))
    assert df.columns == ["queue_length_at_arrival", "hour", "hour_queue_interaction"]
    assert af.with_optional_interactions(df, enabled=False) is df
    assert cal.with_cyclical(table("x int", [(1,)])).columns == ["x"]
    only_hour = cal.with_calendar_flags(table("hour int", [(12,)])).first()
    assert only_hour["is_peak_hours"] == 1 and only_hour["is_evening"] == 0


def test_calendar_flags_of_the_second_layout(spark):
    df = spark.sql("select timestamp_ntz '2024-01-06 16:00:00' as timestamp")
    row = cal.with_calendar_flags(df).first()
    assert (row["day_of_week"], row["is_weekend"], row["is_evening"]) == (5, 1, 1)
    assert {"dow_sin", "dow_cos", "hour_sin", "month_cos"} <= set(row.asDict())


def test_no_counters_give_no_ratio(table):
    df = table("q int, n int, w double", [(4, 0, 9.0), (4, 2, 9.0)])
    estimate = rules.queueing_estimate(F.col("q"), F.col("n"))
    assert column(df, estimate) == [None, 7.0]
    assert column(df, rules.queueing_estimate(F.col("q"), F.col("n"), F.col("w"))) == [9.0, 7.0]


def test_reading_defaults(spark):
    df = spark.sql("select timestamp_ntz '2024-01-01 00:00:00' as timestamp")
    row = af.with_reading_features(df).first()
    assert (row["queue_length_at_arrival"], row["arrivals_this_hour"],
            row["total_counters_available"], row["is_emergency"]) == (10, 20, 4, 0)
    assert row["queue_per_counter"] == 2.5 and row["efficiency_load"] == 19.0


def test_request_check(table):
    schema = ("hour int, day_of_week int, month int, queue_length_at_arrival int, "
              "total_counters_available int, arrival_rate double, system_utilization double")
    df = af.with_request_check(table(schema, [(24, 0, 1, -1, 1, 0.0, 1.0),
                                              (23, 6, 12, 0, 1, 0.0, None)]))
    first, second = df.collect()
    assert first["violations"] == ["hour", "queue_length_at_arrival"]
    assert second["violations"] == ["system_utilization"]
    assert first["doctor_efficiency"] == 0.75 and first["department"] == "OPD"


def test_all_clear_row(table):
    calm = table("department string, wait_time double", [("A", 3.0), ("B", 20.0)])
    assert [tuple(r) for r in rules.threshold_alerts(calm).collect()] == [
        (None, "success", "All systems normal")]
    busy = table("department string, wait_time double", [("A", 30.05), ("B", 21.0)])
    assert {r["message"] for r in rules.threshold_alerts(busy).collect()} == {
        "Critical: A - 30.1 min wait", "Warning: B - 21.0 min wait"}


def test_intervals(table):
    df = table("p double", [(20.0,), (-1.0,), (None,)])
    assert column(df, rules.non_negative(F.col("p"))) == [20.0, 0.0, None]
    low = column(df, rules.normal_interval(F.col("p"))["confidence_lower"])
    assert low[0] == 20 - 1.96 * 3.0 and low[2] is None


def test_expressions_stay_in_generated_code(spark, data):
    import __spark_entry__ as entry
    for name in ("wait_advice", "feat_temporal", "score_fallback"):
        plan = entry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Exchange" not in plan
