from datetime import datetime

import numpy as np
import pytest

from waitwright.operators import clean


def test_mode_takes_the_smallest_on_ties(table):
    df = table("s string", [("b",), ("a",), ("a",), ("b",), (None,)])
    assert clean.fit_fill(df).modes == {"s": "a"}


def test_fill_rules(table):
    df = table("n int, d double, s string, none string, gone double, t timestamp",
               [(1, 1.0, "x", None, None, None), (None, None, None, None, None, None),
                (4, 2.0, "x", None, None, datetime(2024, 1, 1))])
    before = clean.missing_cells(df).first()[0]
    filled, fill = clean.impute(df)
    assert fill.filled == before - clean.missing_cells(filled).first()[0]
    middle = filled.where("n = 2.5").first()
    assert (middle["d"], middle["s"], middle["none"]) == (1.5, "x", "Unknown")
    assert middle["gone"] is None and middle["t"] is None
    assert fill.medians == {"n": 2.5, "d": 1.5}


def test_nan_counts_as_missing(table):
    df = clean.nan_to_null(table("d double", [(float("nan"),), (1.0,)]))
    assert clean.missing_cells(df).first()[0] == 1


def test_outlier_filters_equal_numpy(table):
    values = np.random.default_rng(2).standard_t(2, 500)
    df = table("v double", [(float(v),) for v in values] + [(None,)])
    q1, q3 = np.quantile(values, [0.25, 0.75])
    fence = (values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))
    assert clean.filter_outliers(df, "v").count() == fence.sum()
    low, high = np.quantile(values, [0.01, 0.99])
    assert clean.filter_outliers(df, "v", "quantile").count() == (
        (values >= low) & (values <= high)).sum()
    assert clean.filter_outliers(df, "v", "other").count() == 501
    score = np.abs((values - values.mean()) / values.std(ddof=1))
    assert clean.filter_deviation(df, "v", 2.0).count() == (score < 2).sum()


def test_filters_are_pushed_to_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("cast(id as double) as v").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = clean.filter_outliers(df, "v", "quantile")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(v), GreaterThanOrEqual(v,0.99" in plan


def test_constant_column_has_no_deviation(table):
    df = table("v double", [(1.0,), (1.0,)])
    assert clean.filter_deviation(df, "v").count() == 0
    assert clean.filter_deviation(df, "v", enabled=False).count() == 2
    assert clean.filter_deviation(df, "absent").count() == 2


def test_quality_of_empty_and_partial_tables(table):
    empty = clean.quality_report(table("waiting_time double", []), datetime(2024, 1, 1)).first()
    assert empty["total_records"] == 0
    rows = [(1.0, "a"), (1.0, "a"), (1.0, "a"), (-1.0, None)]
    report = clean.quality_report(table("waiting_time double, s string", rows),
                                  datetime(2024, 1, 1)).first()
    assert (report["duplicate_rows"], report["missing_values"],
            report["negative_waiting_times"]) == (2, 1, 1)
    assert report["future_dates"] == 0 and report["data_quality_score"] == 0.0


def test_dedupe_keeps_one_of_many_copies(table):
    df = table("a int, b string", [(1, None)] * 50 + [(2, "x")])
    assert clean.remove_duplicates(df).count() == 2
    stats = clean.cleaning_stats(df).first()
    assert stats["duplicates_removed"] == 49
    assert stats["duplicate_percent"] == pytest.approx(49 / 51 * 100)


def test_given_calendar_columns_are_carried(table):
    df = table("arrival_time int, patient_id int, hour int, month int, waiting_time double",
               [(1, 1, None, None, 1.0), (2, 2, 7, None, None), (3, 3, None, None, 3.0)])
    filled, fill = clean.impute(df)
    assert {r["hour"] for r in filled.collect()} == {7}
    assert filled.where("month is null").count() == 3
    assert fill.filled == 3
