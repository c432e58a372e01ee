import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waitwright.operators.lags import latest_per, with_history, with_history_stats
from waitwright.operators.ordering import (
    arrange, fill_backward, fill_both_ways, fill_forward, over_blocks,
)


def visits(n=700, gaps=False, seed=5):
    rng = np.random.default_rng(seed)
    stamps = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 400, n), unit="min")
    stamps = stamps.to_series().reset_index(drop=True)
    stamps[: n // 3] = pd.Timestamp("2024-01-01 02:00")  # one instant holds a third
    wait = rng.uniform(1, 60, n)
    if gaps:
        wait[rng.random(n) < 0.4] = np.nan
        wait[:40] = np.nan
    return pd.DataFrame({"arrival_time": stamps, "patient_id": rng.permutation(n),
                         "waiting_time": wait,
                         "queue_length_at_arrival": rng.integers(0, 20, n)})


def to_spark(spark, pdf):
    schema = ("arrival_time timestamp_ntz, patient_id bigint, waiting_time double, "
              "queue_length_at_arrival bigint")
    rows = [tuple(None if pd.isna(v) else v for v in row) for row in zip(
        list(map(pd.Timestamp.to_pydatetime, pdf.arrival_time)), pdf.patient_id.tolist(), pdf.waiting_time.tolist(),
        pdf.queue_length_at_arrival.tolist())]
    return spark.createDataFrame(rows, schema)


def ordered(pdf):
    return pdf.sort_values(["arrival_time", "patient_id"]).reset_index(drop=True)


def arranged(spark, pdf, size=50):
    return arrange(to_spark(spark, pdf), ("arrival_time", "patient_id"), size)


def pull(result):
    return result.df.orderBy("ord").toPandas()


def test_positions_follow_the_order(spark):
    pdf = visits()
    placed = pull(arranged(spark, pdf))
    assert placed["ord"].tolist() == list(range(len(pdf)))
    assert placed["patient_id"].tolist() == ordered(pdf)["patient_id"].tolist()


def test_a_hot_instant_is_spread_over_partitions(spark):
    pdf = visits(3000)
    df = to_spark(spark, pdf).repartitionByRange(8, "arrival_time", "patient_id")
    sizes = df.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.max() < len(pdf) / 4


@pytest.mark.parametrize("gaps", [False, True])
def test_history_equals_pandas(spark, gaps):
    pdf = ordered(visits(gaps=gaps))
    got = pull(with_history(arranged(spark, pdf)))
    wait, queue = pdf["waiting_time"], pdf["queue_length_at_arrival"]
    for k in (1, 2):
        np.testing.assert_allclose(got[f"prev_wait_{k}"], wait.shift(k).bfill())
    for k in (5, 10):
        expected = wait.shift(1).rolling(k, min_periods=1).mean().bfill()
        np.testing.assert_allclose(got[f"rolling_wait_{k}"], expected)
    for k in (3, 5):
        np.testing.assert_allclose(got[f"rolling_queue_{k}"], queue.rolling(k, min_periods=1)
                                   .mean())


def test_history_stats_equal_pandas(spark):
    pdf = ordered(visits())
    result = with_history_stats(arranged(spark, pdf), "waiting_time", lags=(1, 3), windows=(4,))
    got, wait = pull(result), pdf["waiting_time"]
    expected = {"prev_wait_3": wait.shift(3), "prev_queue_1": pdf["queue_length_at_arrival"]
                .shift(1), "rolling_wait_4": wait.rolling(4, min_periods=1).mean(),
                "rolling_wait_std_4": wait.rolling(4, min_periods=1).std()}
    for name, series in expected.items():
        np.testing.assert_allclose(got[name], series.fillna(series.median()), rtol=1e-9)


def test_golden_lags(spark, table):
    rows = [(i, i, float(10 * (i + 1)), 3 * (i + 1)) for i in range(4)]
    df = table("t int, patient_id int, waiting_time double, queue_length_at_arrival int", rows)
    got = pull(with_history(arrange(df, ("t", "patient_id"))))
    assert got["prev_wait_1"].tolist() == [10, 10, 20, 30]
    assert got["prev_wait_2"].tolist() == [10, 10, 10, 20]
    assert got["rolling_wait_5"].tolist() == [10, 10, 15, 20]
    assert got["rolling_queue_3"].tolist() == [3, 4.5, 6, 9]
    bare = pull(with_history(arrange(df, ("t", "patient_id")), back_fill=False))
    assert pd.isna(bare["prev_wait_1"][0]) and pd.isna(bare["rolling_wait_5"][0])


@pytest.mark.parametrize("size", [7, 1000])
def test_fills_reach_across_blocks(spark, size):
    pdf = visits(300)
    pdf["waiting_time"] = np.where(pdf["patient_id"] % 97 == 0, pdf["waiting_time"], np.nan)
    pdf = ordered(pdf)
    source = arranged(spark, pdf, size)
    for fill, expected in ((fill_forward, pdf.waiting_time.ffill()),
                           (fill_backward, pdf.waiting_time.bfill()),
                           (fill_both_ways, pdf.waiting_time.ffill().bfill())):
        np.testing.assert_array_equal(pull(fill(source, ["waiting_time"]))["waiting_time"],
                                      expected)


def test_look_back_must_fit_a_block(spark):
    with pytest.raises(ValueError):
        over_blocks(arranged(spark, visits(20), 3), 4, lambda w: {})


def test_empty_table(spark):
    empty = to_spark(spark, visits(5)).where("false")
    assert with_history(arrange(empty, ("arrival_time", "patient_id"))).df.count() == 0


def test_latest_breaks_ties_by_id(table):
    df = table("department string, timestamp int, id int, wait_time double",
               [("A", 1, 1, 5.0), ("A", 2, 2, 6.0), ("A", 2, 3, 7.0), ("B", 0, 4, 8.0)])
    got = {r["department"]: r["wait_time"] for r in latest_per(df, tie="id").collect()}
    assert got == {"A": 7.0, "B": 8.0}
    assert latest_per(df.where("false"), tie="id").count() == 0


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_latest_filter_reaches_the_scan(spark, tmp_path, kind):
    spark.sql(f"""select if(id % 2 = 0, 'A', 'B') as department,
        cast(timestamp_ntz '2024-03-31 01:30:00' + make_dt_interval(0, cast(id as int)) as {kind})
        as timestamp, id from range(100)""").write.parquet(str(tmp_path / "t"))
    newest = latest_per(spark.read.parquet(str(tmp_path / "t")), tie="id")
    assert {(r["department"], r["id"]) for r in newest.collect()} == {("A", 98), ("B", 99)}
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in plan
