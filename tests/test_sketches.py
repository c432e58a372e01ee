"""Sketched quantiles: rank bounds, merging, flags of the operators, defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waitwright.operators import clean, report, scale, sketches
from waitwright.operators.quantiles import quantile_values

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")


def test_ranks_stay_within_the_bound(lines):
    rows = lines.where("l_extendedprice is not null")
    asked = sketches.approximate_quantiles(rows, ["l_extendedprice", "l_quantity"], PROBS,
                                           ("l_returnflag",))
    for column in ("l_extendedprice", "l_quantity"):
        got = sketches.rank_errors(rows, column, asked, ("l_returnflag",)).collect()
        assert len(got) == len(PROBS) * rows.select("l_returnflag").distinct().count()
        assert max(r.error for r in got) <= 2 * sketches.rank_bound()
        assert all(r.error == 0 for r in got if r.prob in (0.0, 1.0))


def test_merged_days_answer_a_span(lines):
    day = F.to_date("l_shipdate").alias("day")
    days = sketches.sketch(lines, ["l_extendedprice"], (day,))
    halves = [days.where("day(day) % 2 = 0"), days.where("day(day) % 2 = 1")]
    whole = sketches.merge(halves[0].unionByName(halves[1]), ["l_extendedprice"])
    got = sketches.answer(whole, ["l_extendedprice"], PROBS).collect()
    values = np.sort([r[0] for r in lines.where("l_extendedprice is not null").select(
        "l_extendedprice").collect()])
    for r in got:
        assert r.n == len(values)
        low, high = (np.searchsorted(values, r.value, side) / r.n for side in ("left", "right"))
        assert max(low - r.prob, r.prob - high, 0) <= 2 * sketches.rank_bound()


def test_small_groups_are_exact_in_rank(table):
    rows = [("a", float(v)) for v in range(300)] + [("b", 7.0)]
    got = {(r.k, r.prob): r.value for r in sketches.approximate_quantiles(
        table("k string, v double", rows).repartition(5), ["v"], [0.0, 0.5, 1.0], ("k",)).collect()}
    assert got["a", 0.0] == 0 and got["a", 1.0] == 299 and got["a", 0.5] in (149, 150)
    assert {got["b", p] for p in (0.0, 0.5, 1.0)} == {7.0}


def test_nulls_nan_and_empty(table):
    df = table("k string, v double", [("a", None), ("a", float("nan")), ("b", 1.0)])
    got = {r.k: r for r in sketches.approximate_quantiles(df, ["v"], [0.5], ("k",)).collect()}
    assert (got["a"].n, got["a"].value) == (0, None)
    assert (got["b"].n, got["b"].value) == (1, 1.0)
    assert sketches.approximate_values(df.where("k = 'a'"), ["v"], [0.5]) == {}
    assert sketches.approximate_quantiles(df.limit(0), ["v"], [0.5], ("k",)).count() == 0


def test_operators_take_them_by_flag(lines):
    near = lambda bound, prob: lines.where(F.col("l_extendedprice") < bound).count() / total - prob
    rows = lines.where("l_extendedprice is not null")
    total, limit = rows.count(), 2 * sketches.rank_bound()
    low, high = ((b.lower, b.upper) for b in clean.fit_quantile_range(
        rows, ["l_extendedprice"], sketch=400)).__next__()
    assert abs(near(low, 0.01)) <= limit and abs(near(high, 0.99)) <= limit
    exact = clean.filter_outliers(rows, "l_extendedprice", "quantile").count()
    loose = clean.filter_outliers(rows, "l_extendedprice", "quantile", sketch=400).count()
    assert abs(exact - loose) <= 2 * limit * total
    named = rows.withColumn("department", F.col("l_returnflag"))
    exact, loose = ({r.department: r for r in report.wait_distribution(
        named, "l_extendedprice", sketch=k).collect()} for k in (None, 400))
    assert exact.keys() == loose.keys()
    assert all((exact[d].min, exact[d].max) == (loose[d].min, loose[d].max) for d in exact)
    rates = rows.withColumn("arrival_rate", F.col("l_extendedprice"))
    flag = scale.fit_flags(rates, sketch=400).limits["arrival_rate"]
    assert abs(near(flag, 0.75)) <= limit
    assert scale.fit_flags(rates).limits["arrival_rate"] == pytest.approx(
        quantile_values(rates, ["arrival_rate"], [0.75])["arrival_rate", 0.75])
