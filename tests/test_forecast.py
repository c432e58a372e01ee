"""Seasonal forecasts against NumPy ridge, recovery of a known series, defined cases."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from waitwright.operators import forecast
from waitwright.operators.forecast import Season

START = datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp_ntz, v double"


def series(key, hours, value, per_hour=1):
    return [(key, START + timedelta(hours=h, minutes=7 * r), float(value(h)))
            for h in range(hours) for r in range(per_hour)]


def design(hours, first, last, s):
    t = (hours - first) / max(last - first, 1)
    columns = [np.ones(len(hours)), t, *(np.maximum(t - b, 0) for b in s.bends())]
    for period, order in ((24, s.daily), (168, s.weekly)):
        for k in range(1, order + 1):
            angle = 2 * np.pi * k * (hours % period) / period
            columns += [np.sin(angle), np.cos(angle)]
    return np.column_stack(columns)


@pytest.mark.parametrize("s", [Season(), Season(changepoints=3, daily=1, weekly=0),
                               Season(changepoints=4, daily=2, weekly=1, multiplicative=True)])
def test_weights_equal_ridge(table, s):
    rng = np.random.default_rng(1)
    rows = [r for k in "ab" for r in series(
        k, 400, lambda h: 20 + h / 50 + 5 * np.sin(h / 24 * 2 * np.pi) + rng.normal(), 2)]
    got = forecast.fit(table(SCHEMA, rows), ("k",), "ts", "v", s).collect()
    assert sorted(r.k for r in got) == ["a", "b"]
    for r in got:
        mine = [(t, v) for k, t, v in rows if k == r.k]
        hours = np.array([int((t - datetime(1970, 1, 1)).total_seconds() // 3600) for t, _ in mine])
        y = np.array([v for _, v in mine])
        y = np.round(np.log1p(y) if s.multiplicative else y, s.digits)
        x = design(hours, hours.min(), hours.max(), s)
        scale = np.abs(y).max()
        want = np.linalg.solve(x.T @ x + np.diag(s.penalties), x.T @ y / scale)
        assert r.scale == pytest.approx(scale)
        assert r.weights == pytest.approx(want, abs=1e-7)
        rest = y - x @ want * scale
        assert r.deviation == pytest.approx(np.sqrt((rest ** 2).mean()), rel=1e-6)
        assert r.n == len(mine)


def test_daily_wave_goes_on(table):
    wave = lambda h: 30 + 10 * np.sin(2 * np.pi * h / 24)
    fitted = forecast.fit(table(SCHEMA, series("a", 240, wave)), ("k",), "ts", "v",
                          Season(weekly=0))
    got = forecast.ahead(fitted, ("k",), 24, Season(weekly=0)).orderBy("hour").collect()
    assert [r.hour_start for r in got] == [START + timedelta(hours=240 + h) for h in range(24)]
    assert [r.forecast for r in got] == pytest.approx([wave(240 + h) for h in range(24)], abs=0.5)
    assert all(r.lower <= r.forecast <= r.upper for r in got)


def test_any_partitioning_and_row_order(table):
    df = table(SCHEMA, series("a", 200, lambda h: h % 24, 3)).where("v > 2")
    s = Season(changepoints=2)
    one = forecast.fit(df.coalesce(1), ("k",), "ts", "v", s).first()
    many = forecast.fit(df.orderBy(F.rand(3)).repartition(7), ("k",), "ts", "v", s).first()
    assert one.weights == pytest.approx(many.weights, abs=1e-9)


def test_cells_of_two_files_add_up(table):
    rows, s = series("a", 100, lambda h: h % 7, 4), Season(changepoints=1, daily=1, weekly=0)
    whole = forecast.hourly_cells(table(SCHEMA, rows), ("k",), "ts", "v", s)
    halves = [forecast.hourly_cells(table(SCHEMA, rows[i::2]), ("k",), "ts", "v", s) for i in (0, 1)]
    merged = halves[0].unionByName(halves[1]).groupBy("k", "hour").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squared").alias("squared"),
        F.max("largest").alias("largest"))
    key = lambda df: sorted((r.k, r.hour, r.n, r.total, r.squared, r.largest) for r in df.collect())
    assert key(whole) == key(merged)


def test_defined_cases(table):
    rows = [("one", START, 5.0), ("zero", START, 0.0), ("zero", START + timedelta(hours=1), 0.0),
            (None, START, 1.0), ("x", None, 1.0), ("x", START, None), ("x", START, float("nan"))]
    fitted = forecast.fit(table(SCHEMA, rows), ("k",), "ts", "v")
    got = {r.k: r for r in forecast.ahead(fitted, ("k",), 1).collect()}
    assert set(got) == {"one", "zero"}
    assert got["zero"].forecast == 0.0
    assert np.isfinite(got["one"].forecast)
    empty = forecast.fit(table(SCHEMA, []), ("k",), "ts", "v")
    assert empty.count() == 0 and forecast.ahead(empty, ("k",), 5).count() == 0


def test_rows_of_unknown_keys_keep_their_place(table):
    fitted = forecast.fit(table(SCHEMA, series("a", 48, lambda h: 3)), ("k",), "ts", "v")
    asked = table("k string, hour bigint, note string", [("a", 473400, "x"), ("b", 473400, "y")])
    got = {r.k: r for r in forecast.predict(asked, fitted, ("k",)).collect()}
    assert got["b"].forecast is None and got["a"].forecast == pytest.approx(3, abs=0.2)
    assert got["a"].note == "x"


def test_no_python_on_executors(table):
    s = Season(changepoints=2, daily=1, weekly=1)
    df = forecast.fit(table(SCHEMA, series("a", 30, lambda h: h)), ("k",), "ts", "v", s)
    plan = forecast.ahead(df, ("k",), 3, s)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan
