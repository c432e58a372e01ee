import json
from datetime import datetime

import pytest

from waitwright import lineage
from waitwright.operators import allocate as al
from waitwright.operators import encode, model
from waitwright.sources import tables


def test_lenient_csv(spark, tmp_path):
    path = tmp_path / "v.csv"
    path.write_text("patient_id,arrival_time,waiting_time,department,note\n"
                    "2,2024-01-02 00:00:00,5.5,OPD,x\n1,not a time,,OPD,\n3,2024-01-01,7,,y\n")
    df = tables.read_visits_csv(spark, str(path), ordered=True)
    rows = df.collect()
    assert [r["patient_id"] for r in rows] == [3, 2, 1]
    assert rows[2]["arrival_time"] is None and rows[2]["waiting_time"] is None
    assert dict(df.dtypes)["waiting_time"] == "double" and dict(df.dtypes)["note"] == "string"


def test_strict_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("timestamp,wait_time_minutes\n2024-01-02 00:00:00,5.5\n")
    row = tables.read_timed_csv(spark, str(path)).first()
    assert row["timestamp"] == datetime(2024, 1, 2) and row["wait_time_minutes"] == 5.5
    path.write_text("timestamp,wait_time_minutes\nnot a time,5.5\n")
    with pytest.raises(Exception, match="CANNOT_PARSE|CAST_INVALID"):
        tables.read_timed_csv(spark, str(path)).collect()


def test_database_reader_options(spark):
    # Options only: no database is started for a test.
    plain = tables.database_reader(spark, "select 1", "jdbc:x:y", {"user": "u"})
    split = tables.database_reader(spark, "select 1", "jdbc:x:y", partition=("id", 0, 9, 4))
    assert plain is not None and split is not None


def test_schema_check(table):
    df = table("department string, waiting_time double", [])
    valid, missing = tables.check_schema(df)
    assert not valid and missing[:2] == ["arrival_time", "queue_length_at_arrival"]
    with pytest.raises(ValueError, match="Missing columns"):
        tables.require_schema(df)


def test_recommendation_report(spark, table, tmp_path):
    df = table("snapshot int, department string, predicted_wait double, current_counters int",
               [(1, "OPD", 28.5, 4)])
    path = str(tmp_path / "r")
    tables.write_recommendations(None, path)
    tables.write_recommendations(al.recommend(df), path)
    row = spark.read.option("header", True).csv(path).first().asDict()
    assert row == {"Department": "OPD", "Current Counters": "4", "Recommended Counters": "8",
                   "Action": "INCREASE", "Predicted Wait (min)": "28.5"}


def test_summary_and_metrics(spark, tmp_path):
    summary = {"status": "SUCCESS", "data": {"samples": 3, "target_range": [1.0, 2.5]},
               "model": {"name": "m", "rmse": 1.5}}
    tables.write_summary(spark, summary, str(tmp_path / "s"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "s")).collect()]
    assert lines == [summary]
    assert tables.read_metrics(spark, str(tmp_path / "s")).first()["model"]["rmse"] == 1.5


def test_importance_round_trip(spark, table, tmp_path):
    df = table("feature string, importance double", [("a", 0.25), ("b", 0.75)])
    tables.write_importance(df, str(tmp_path / "i"))
    rows = tables.read_importance(spark, str(tmp_path / "i")).collect()
    assert [r["feature"] for r in rows] == ["b", "a"]


def test_learning_logs(spark, tmp_path):
    for name, values in (("learn", (9.0, 5.0, 4.0)), ("test", (9.5, 6.0, 6.5))):
        (tmp_path / name).write_text("iter\tRMSE\n" + "".join(
            f"{i}\t{v}\n" for i, v in enumerate(values)))
    curve = tables.read_learning_curve(spark, str(tmp_path / "learn"), str(tmp_path / "test"))
    best = model.best_iteration(curve).first()
    assert (best["best_iteration"], best["best_test_rmse"], best["final_learn_rmse"]) == (1, 6, 4)
    (tmp_path / "time").write_text("iter\tPassed\tRemaining\n0\t186\t93203\n")
    assert tables.read_timing_log(spark, str(tmp_path / "time")).first()["passed_ms"] == 186


def test_fitted_state_round_trip(spark, table, tmp_path):
    state = {"medians": {"a": 1.5}, "features": ["x", "y"]}
    tables.save_state(spark, str(tmp_path / "s"), **state)
    assert tables.load_state(spark, str(tmp_path / "s")) == state
    encoder = encode.fit_encoder(table("w string", [("b",), ("a",)]), ["w"])
    tables.save_encoder(encoder, str(tmp_path / "e"))
    loaded = tables.load_encoder(spark, str(tmp_path / "e"))
    assert sorted(map(tuple, loaded.collect())) == [("w", "a", 0), ("w", "b", 1)]


def test_cut_uses_the_shared_folder(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(lineage, "scratch_dir", lambda _: str(tmp_path))
    kept = lineage.cut(table("a int", [(1,), (2,)]))
    assert kept.count() == 2 and any(p.name.startswith("cut-") for p in tmp_path.iterdir())


def test_size_check(table):
    wide = table("w string", [("x" * 5000,)] * 10)
    assert lineage.is_small(wide) and not lineage.is_small(wide, 10_000)
    assert lineage.is_small(wide.where("false"))
