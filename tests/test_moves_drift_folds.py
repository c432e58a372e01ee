"""Moves at a cost, drift and folds against exhaustive search, recomputation and NumPy."""

import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from waitwright.operators import drift, folds, moves
from waitwright.settings import DEPARTMENTS, Thresholds
from waitwright.settings import TARGET as Y

STATE = ("snapshot int, department string, predicted_wait double, current_counters int, "
         "utilization double")


def total_minutes(rows, counters, cost):
    weight = {d.department: d.priority_weight for d in DEPARTMENTS}
    return sum(weight[d] * w * max(c, 1) / k + cost * max(0, k - c)
               for (d, w, c), k in zip(rows, counters))


@pytest.mark.parametrize("cost", [0.0, 5.0, 40.0])
def test_moves_equal_exhaustive_search(table, cost):
    rng = random.Random(int(cost))
    limits = {d.department: (d.min_counters, d.max_counters) for d in DEPARTMENTS}
    states = [(s, d, rng.uniform(1, 60), rng.randrange(0, 9), None)
              for s in range(25) for d in limits]
    got = moves.reallocate(table(STATE, states), move_cost=cost).collect()
    assert len(got) == len(states)
    for snapshot in range(25):
        rows = [(d, w, c) for s, d, w, c, _ in states if s == snapshot]
        plan = {r.department: r.recommended_counters for r in got if r.snapshot == snapshot}
        choices = itertools.product(*(range(limits[d][0], limits[d][1] + 1) for d, _, _ in rows))
        best = min(total_minutes(rows, k, cost) for k in choices if sum(k) <= 15)
        mine = [plan[d] for d, _, _ in rows]
        assert sum(mine) <= 15
        assert total_minutes(rows, mine, cost) == pytest.approx(best)


def test_use_limits_nulls_and_short_staff(table):
    rows = [(1, "OPD", 30.0, 6, 1.0), (1, "Pharmacy", 9.0, 4, 0.3), (1, "Emergency", None, None, 0.5),
            (2, "OPD", 30.0, 8, 1.0), (2, "Diagnostics", 30.0, 6, 1.0), (2, "Elsewhere", 1.0, 1, 0.1)]
    got = {(r.snapshot, r.department): r for r in moves.reallocate(table(STATE, rows)).collect()}
    assert got[1, "OPD"].recommended_counters == 8       # 6 busy of 6 need more than 7
    assert got[1, "Pharmacy"].recommended_counters == 2  # 1.2 busy: never more than the minimum
    assert got[1, "Emergency"].recommended_counters == 3 and got[1, "Emergency"].wait_after is None
    assert all(r.feasible for r in got.values())
    short = moves.reallocate(table(STATE, rows[:3]), staff=5).collect()
    assert not any(r.feasible for r in short)
    assert sorted(r.recommended_counters for r in short) == [2, 2, 3]
    assert moves.reallocate(table(STATE, [])).count() == 0


def scored(spark, rows=4000):
    return spark.range(rows).select(
        F.concat(F.lit("m"), F.col("id") % 2).alias("model"),
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,int(id div 100),0,0,0)").alias("ts"),
        F.pmod(F.hash("id"), F.lit(900)).cast("double").alias(Y),
        (F.pmod(F.hash("id"), F.lit(900)) + F.pmod(F.col("id") * 7, F.lit(40))
         * F.when(F.col("id") > 3000, 1.5).otherwise(1.0)).alias("prediction"))


def test_merged_moments_equal_recomputed_ones(spark):
    rows = scored(spark)
    by = ("model",)
    days = drift.daily_moments(rows, by, "ts")
    halves = [drift.daily_moments(rows.where(F.pmod(F.xxhash64(Y), F.lit(2)) == k), by, "ts")
              for k in (0, 1)]
    merged = drift.merge(halves[0].unionByName(halves[1]), ("model", "day"))
    order = ("model", "day")
    assert merged.select(days.columns).orderBy(*order).collect() == days.orderBy(*order).collect()
    whole = drift.merge(days, by).select("model", *[v.alias(k) for k, v in drift.measures().items()])
    pdf = rows.toPandas()
    for r in whole.collect():
        mine = pdf[pdf["model"] == r.model]
        error = mine[Y] - mine["prediction"]
        assert r.rmse == pytest.approx(np.sqrt((error ** 2).mean()), abs=1e-3)
        assert r.mae == pytest.approx(error.abs().mean(), abs=1e-3)
        assert r.bias == pytest.approx(error.mean(), abs=1e-3)
        assert r.r2 == pytest.approx(1 - (error ** 2).mean() / mine[Y].var(ddof=0), abs=1e-6)


def test_retraining_needs_lost_accuracy_and_rows(spark):
    days = drift.daily_moments(scored(spark), ("model",), "ts")
    found = drift.retrain_days(days, ("model",), least=300).orderBy("model", "day").collect()
    first = datetime(2024, 1, 1).date()
    for r in found:
        late = (r.day - first).days >= 36  # a week with enough worse days
        if r.retrain or late:
            assert r.day > first + timedelta(days=29) and r.rmse > 1.05 * r.base_rmse
        assert r.retrain == (r.n >= 300 and r.rmse > 1.05 * r.base_rmse)
    assert any(r.retrain for r in found) and found[0].n == 50
    none = drift.retrain_days(days, ("model",), least=10**6)
    assert none.where("retrain").isEmpty() and none.count() == len(found)
    assert drift.retrain_days(days.limit(0), ("model",)).count() == 0


def test_folds_keep_the_gap_and_equal_numpy(spark):
    rng = np.random.default_rng(8)
    n, gap = 900, 45
    minutes = np.sort(rng.integers(0, 5000, n))
    x = rng.normal(0, 2, (n, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(0, 1, n) + minutes / 2000
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(start + timedelta(minutes=int(m)), *map(float, r), float(v))
         for m, r, v in zip(minutes, x, y)], "t timestamp_ntz, a double, b double, c double, y double")
    names = ["a", "b", "c"]
    got = {r.fold: r for r in folds.cross_validate(
        df, "t", names, "y", gap_minutes=gap, folds=4, alpha=2.0).collect()}
    edges = [np.sort(minutes)[int(round(i / 5, 10) * (n - 1))] for i in range(1, 5)] + [10**9]
    assert sorted(got) == [1, 2, 3, 4]
    for i in range(4):
        train = minutes < edges[i] - gap
        test = (minutes >= edges[i]) & (minutes < edges[i + 1])
        mean, top = x[train].mean(0), y[train].mean()
        centred = x[train] - mean
        w = np.linalg.solve(centred.T @ centred + 2 * np.eye(3), centred.T @ (y[train] - top))
        error = y[test] - (top + (x[test] - mean) @ w)
        assert got[i + 1].rows == test.sum()
        assert got[i + 1].rmse == pytest.approx(np.sqrt((error ** 2).mean()))
        assert got[i + 1].r2 == pytest.approx(1 - (error ** 2).mean() / y[test].var())


def test_folds_of_odd_tables(spark):
    schema = "t timestamp, x double, y double"
    rows = [(datetime(2024, 1, 1), 1.0, float(i)) for i in range(20)] + [(None, 1.0, 1.0)]
    one_instant = folds.with_folds(spark.createDataFrame(rows, schema), "t")[0]
    assert {r.fold for r in one_instant.select("fold").collect()} == {5, None}
    assert folds.cross_validate(spark.createDataFrame([], schema), "t", ["x"], "y").count() == 0


def test_staff_is_never_exceeded(table):
    limits = Thresholds()
    states = [(s, d.department, 10.0 + s, 3, 0.7) for s in range(5) for d in DEPARTMENTS]
    got = moves.reallocate(table(STATE, states)).groupBy("snapshot").agg(
        F.sum("recommended_counters").alias("k"))
    assert all(r.k <= limits.total_staff for r in got.collect())
