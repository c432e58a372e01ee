import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waitwright.operators.quantiles import exact_quantiles, quantile_values

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def columns(seed=1, n=4000):
    rng = np.random.default_rng(seed)
    hot = rng.normal(0, 1, n)
    hot[: n // 3] = 0.25  # one value holds a third of the rows
    tails = np.where(rng.random(n) < 0.01, 1e300, rng.normal(5, 1e-9, n))
    return {"plain": rng.normal(10, 3, n), "hot": hot, "tails": tails,
            "signs": rng.standard_cauchy(n)}


@pytest.mark.parametrize("limit", [1_000_000, 40])
def test_equals_numpy_with_and_without_narrowing(spark, limit):
    data = columns()
    df = spark.createDataFrame(
        [tuple(map(float, row)) for row in zip(*data.values())], ", ".join(
            f"{c} double" for c in data))
    found = quantile_values(df, list(data), PROBS, distinct_limit=limit, buckets=16)
    for name, values in data.items():
        for prob in PROBS:
            assert found[(name, prob)] == np.quantile(values, prob), (name, prob)


@pytest.mark.parametrize("limit", [1_000_000, 30])
def test_groups_and_lower_method(spark, limit):
    rng = np.random.default_rng(3)
    rows = [("big" if i % 3 else f"g{i % 5}", float(rng.integers(0, 500))) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double")
    marks = exact_quantiles(df, ["v"], [0.3, 0.9], by=("k",), method="lower",
                            distinct_limit=limit, buckets=8).collect()
    assert len(marks) == 2 * len({k for k, _ in rows})
    for row in marks:
        values = [v for k, v in rows if k == row["k"]]
        assert row["value"] == np.quantile(values, row["prob"], method="lower")


def test_missing_values_are_ignored(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), None), (4.0, None)],
                               "v double, empty double")
    assert quantile_values(df, ["v", "empty"], [0.5]) == {("v", 0.5): 2.5}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_any_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = quantile_values(df, ["v"], [0.25, 0.6], distinct_limit=5, buckets=4)
    for prob in (0.25, 0.6):
        assert found[("v", prob)] == pytest.approx(np.quantile(values, prob), rel=1e-12)


def test_no_single_task_holds_all_values(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    plan = exact_quantiles(df, ["v"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan
