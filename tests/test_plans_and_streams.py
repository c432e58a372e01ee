from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waitwright.operators import allocate as al
from waitwright.operators import model, score
from waitwright.operators.encode import fit_encoder
from waitwright.plans.preprocess import preprocess, prepare_splits
from waitwright.plans.training import train
from waitwright.settings import FEATURES
from waitwright.sources import adapters
from waitwright.streaming import readings

AS_OF = datetime(2024, 1, 20)


def test_training_run(spark, data, table):
    staffing = table(
        "snapshot int, department string, predicted_wait double, current_counters int",
        [(1, "OPD", 28.5, 4), (1, "Diagnostics", 22.3, 3), (1, "Pharmacy", 15.1, 3)])
    run = train(adapters.visits_dirty(spark, data), staffing, AS_OF,
                {"trees": model.randomised_trees(trees=3, depth=4)})
    assert run.prepared.features == list(FEATURES) and len(FEATURES) == 38
    assert run.summary["data"]["samples"] == run.prepared.stats.values["final_size"]
    assert run.summary["allocation"] == {"recommendations_generated": 3, "alerts_generated": 1}
    stats = run.prepared.stats.values
    assert stats["original_size"] - stats["duplicates_removed"] - stats[
        "waiting_time_outliers_removed"] == stats["final_size"]
    assert run.prepared.quality.first()["missing_values"] == 0
    assert run.prepared.stats.to_frame(spark).count() == len(stats)


def test_missing_columns_stop_the_run(table):
    with pytest.raises(ValueError, match="Missing columns"):
        preprocess(table("arrival_time timestamp", []), AS_OF)


def test_optional_columns_shrink_the_features(spark, data):
    visits = adapters.visits_dirty(spark, data).drop(
        "is_holiday", "service_duration_expected", "patient_complexity", "patient_id")
    prepared = preprocess(visits, AS_OF)
    gone = {"is_holiday", "service_duration_expected", "patient_complexity_enc",
            "log_service_time"}
    assert prepared.features == [f for f in FEATURES if f not in gone]


def test_known_encoder_is_reused(spark, data):
    visits = adapters.visits(spark, data)
    encoder = fit_encoder(visits.where("department <> 'OPD'"), ["department"])
    prepared = preprocess(visits, AS_OF, encoder)
    codes = {r[0] for r in prepared.matrix.select("department_enc").distinct().collect()}
    assert codes == {-1, 0, 1, 2}


def test_second_layout(spark, data):
    prepared = prepare_splits(adapters.timed_visits(spark, data), lags=(1,), windows=(3,))
    assert {"dept_OPD", "util_high", "prev_wait_1", "rolling_wait_std_3", "log_queue",
            "high_arrival_rate", "dow_sin", "hour_queue_interaction"} <= set(prepared.features)
    assert not {"timestamp", "wait_time_minutes", "patient_id"} & set(prepared.features)
    train_rows = prepared.rows.where("split = 'train'").toPandas()
    for name in prepared.features:
        column = train_rows[name].astype(float)
        assert abs(column.mean()) < 1e-6
        assert column.std(ddof=0) == pytest.approx(1) or column.nunique() == 1


def test_scoring_departments_with_a_model(spark, data):
    feed = adapters.department_feed(spark, data)
    names = ["queue_length_at_arrival", "total_counters_available", "hour", "unknown_feature"]
    rows = adapters.plain_visits(spark, data).select(
        "waiting_time", "queue_length_at_arrival", "total_counters_available",
        F.hour("arrival_time").alias("hour"), F.lit(0.0).alias("unknown_feature"))
    fitted = model.fit_one(model.randomised_trees(trees=3, depth=3), names, rows)
    got = score.predict_departments(feed, fitted, names, tie="patient_id").toPandas()
    assert len(got) == 4 and (got["prediction"] > 0).all()
    np.testing.assert_allclose(got["std_error"], got["prediction"] * 0.15)


def test_invalid_requests_keep_their_row(spark, data):
    requests = adapters.scoring_requests(spark, data)
    names = ["queue_length_at_arrival", "arrival_rate"]
    rows = adapters.timed_visits(spark, data).select(
        F.col("wait_time_minutes").alias("waiting_time"), *names)
    fitted = model.fit_one(model.randomised_trees(trees=2, depth=3), names, rows)
    got = score.score_requests(requests, fitted, names, keep=("request_id",))
    assert got.count() == requests.count()
    bad = got.where(F.size("violations") > 0)
    assert bad.count() > 0 and bad.where("predicted_wait_time is not null").count() == 0
    good = got.where(F.size("violations") == 0)
    assert good.where("confidence_lower > predicted_wait_time").count() == 0


FEED = "timestamp timestamp, department string, queue_length int, wait_time double, patient_id int"


def feed_files(spark, folder, batches):
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(folder)


def feed_stream(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def at(minute):
    return datetime(2024, 1, 1) + timedelta(minutes=minute)


def test_streams_over_several_batches(spark, tmp_path):
    folder = str(tmp_path / "feed")
    feed_files(spark, folder, [
        [(at(0), "A", 3, 10.0, 1), (at(30), "B", 4, 40.0, 2)],
        [(at(90), "A", 5, 25.0, 3), (at(20), "B", 6, 12.0, 4)],
        [(at(400), "A", 5, 14.0, 5)],
    ])
    path = lambda name: str(tmp_path / name)
    readings.write_stream(readings.latest_readings(feed_stream(spark, folder)), path("l"),
                          path("lc"), "complete").awaitTermination()
    latest = {r["department"]: r["patient_id"] for r in spark.read.parquet(path("l")).collect()}
    assert latest == {"A": 5, "B": 2}
    readings.write_stream(readings.alert_stream(feed_stream(spark, folder)), path("a"),
                          path("ac")).awaitTermination()
    assert {r["level"] for r in spark.read.parquet(path("a")).collect()} == {"error", "warning"}
    readings.write_stream(readings.hourly_congestion(feed_stream(spark, folder)), path("h"),
                          path("hc")).awaitTermination()
    hours = {(r["department"], r["hour_start"]): r["avg_wait"]
             for r in spark.read.parquet(path("h")).collect()}
    assert hours == {("A", at(0)): 10.0, ("B", at(0)): 26.0, ("A", at(60)): 25.0}


def test_late_readings_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "feed")
    # The watermark of one batch rejects rows from the batch after the next.
    feed_files(spark, folder, [[(at(600), "A", 1, 10.0, 1)], [(at(601), "A", 1, 12.0, 2)],
                               [(at(0), "A", 1, 99.0, 3)], [(at(1200), "A", 1, 10.0, 4)]])
    readings.write_stream(readings.hourly_congestion(feed_stream(spark, folder)),
                          str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    starts = [r["hour_start"] for r in spark.read.parquet(str(tmp_path / "o")).collect()]
    assert starts == [at(600)]


def test_cooldown_carries_over_batches(spark, tmp_path):
    schema = ("site string, run_time timestamp, department string, wait_time double, "
              "queue_length int, utilization double, current_counters int")
    folder, history = str(tmp_path / "s"), str(tmp_path / "h")
    minutes = [[0, 5, 14], [15, 16, 29], [31, 40]]
    for batch in minutes:
        spark.createDataFrame([("s", at(m), "OPD", 50.0, 3, 0.5, 3) for m in batch], schema) \
            .coalesce(1).write.mode("append").parquet(folder)
    states = al.department_states(feed_stream(spark, folder), by=("site", "run_time"))
    readings.allocate_batches(states, history, str(tmp_path / "c")).awaitTermination()
    rows = spark.read.parquet(history).collect()
    assert len(rows) == 8
    kept = sorted(r["run_time"] for r in rows if r["reasoning"] != al.COOLING)
    assert kept == [at(0), at(15), at(31)]


def test_visits_share_one_arrival_count(spark, data):
    pdf = adapters.visits(spark, data).toPandas()
    kinds = spark.read.parquet(f"{data}/events.parquet").toPandas().set_index("event_id")
    keys = [kinds["event_type"].reindex(pdf["patient_id"]).values,
            pdf["arrival_time"].dt.floor("h")]
    expected = pd.Series(1, index=pdf.index).groupby(keys).transform("count")
    assert pdf["arrivals_this_hour"].tolist() == expected.tolist()


def test_many_departments_become_a_vector(spark):
    from pyspark.sql import functions as F

    from waitwright.plans.preprocess import apply_prepared, prepare_splits

    rows = spark.range(6000).select(
        F.col("id").alias("patient_id"),
        F.concat(F.lit("d"), F.col("id") % 5000).alias("department"),
        (F.col("id") % 7).cast("double").alias("wait_time_minutes"))
    fitted = prepare_splits(rows, department_vector=True)
    assert "dept_vector" in fitted.features
    seen = fitted.rows.select("dept_vector").first()[0]
    assert seen.size == 5000 and seen.numNonzeros() == 1
    fresh = spark.createDataFrame([("d17",), ("new",), (None,)], "department string")
    vectors = [r["dept_vector"] for r in apply_prepared(fresh, fitted).collect()]
    assert sorted(v.numNonzeros() for v in vectors) == [0, 0, 1]


@pytest.mark.parametrize("vector", [False, True])
def test_saved_preparation_equals_the_fitted_one(spark, tmp_path, vector):
    from pyspark.sql import functions as F

    from waitwright.plans.preprocess import (
        apply_prepared, load_prepared, prepare_splits, save_prepared,
    )

    rows = spark.range(900).select(
        F.col("id").alias("patient_id"), F.concat(F.lit("d"), F.col("id") % 9).alias("department"),
        (F.col("id") % 13).alias("queue_length_at_arrival"),
        (F.col("id") % 7).cast("double").alias("wait_time_minutes"))
    fitted = prepare_splits(rows, department_vector=vector)
    assert ("dept_vector" in fitted.features) == vector
    save_prepared(spark, str(tmp_path / "p"), fitted)
    loaded = load_prepared(spark, str(tmp_path / "p"))
    fresh = spark.createDataFrame([("d3", 4), ("new", 5), (None, None)],
                                  "department string, queue_length_at_arrival int")
    assert loaded.interactions and loaded.features == fitted.features
    assert sorted(map(repr, apply_prepared(fresh, loaded).collect())) == sorted(
        map(repr, apply_prepared(fresh, fitted).collect()))


def test_tables_without_an_id_can_be_split(spark, data):
    from waitwright.plans.preprocess import prepare_splits
    from waitwright.sources import adapters as ad

    rows = ad.timed_visits(spark, data).drop("patient_id")
    parts = {r["split"]: r["count"] for r in
             prepare_splits(rows).rows.groupBy("split").count().collect()}
    assert set(parts) == {"train", "validation", "test"} and parts["train"] > parts["test"]


def test_events_without_a_kind_stay(spark, tmp_path):
    from datetime import datetime

    from waitwright.sources import adapters as ad

    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    row = spark.read.parquet("/root/testdata/sf0.001/events.parquet").first().asDict()
    rows = [row, {**row, "event_id": -1, "event_type": None, "ts": datetime(2024, 1, 1)}]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events.parquet")
    assert ad.visits(spark, str(tmp_path)).count() == 2
