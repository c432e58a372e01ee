"""Contributions against the enumeration of all subsets, and against predictions."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from waitwright.operators import boost, explain

FEATURES = ["a", "b", "c", "d", "e"]
SCHEMA = "id long, " + ", ".join(f"{f} double" for f in FEATURES) + ", y double"


def rows_of(n=600):
    rng = np.random.default_rng(4)
    x = np.round(rng.uniform(0, 10, (n, 5)), 1)
    x[rng.uniform(size=x.shape) < 0.1] = np.nan
    y = np.nan_to_num(x[:, 0]) * 2 + (x[:, 1] > 5) * np.nan_to_num(x[:, 2]) + rng.normal(size=n)
    return x, y


@pytest.fixture(scope="module")
def data(spark):
    x, y = rows_of()
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r), float(t))
            for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def expected(tree, bins, known, node=0):
    """Value of a tree where only the known features are."""
    feature = tree.feature[node]
    if feature < 0:
        return tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if feature in known:
        return expected(tree, bins, known, right if bins[feature] > tree.cut[node] else left)
    if not tree.n[node]:
        return 0.0
    return sum(tree.n[child] / tree.n[node] * expected(tree, bins, known, child)
               for child in (left, right))


def enumerated(trees, bins):
    size, result = len(bins), np.zeros(len(bins))
    worth = lambda known: sum(expected(t, bins, known) for t in trees)
    for i in range(size):
        others = [j for j in range(size) if j != i]
        for k in range(size):
            weight = factorial(k) * factorial(size - 1 - k) / factorial(size)
            for subset in combinations(others, k):
                result[i] += weight * (worth({*subset, i}) - worth(set(subset)))
    return result


@pytest.mark.parametrize("settings", [
    boost.leafwise(rounds=4, leaves=12, depth=6, min_rows=5),
    boost.symmetric(rounds=3, depth=5)])
def test_equal_enumeration_and_prediction(data, settings):
    fitted = boost.fit(data, FEATURES, "y", settings=settings)
    long = explain.contributions(data, fitted, ("id",)).collect()
    assert len(long) == 600 * 5
    got = {}
    for r in long:
        got.setdefault(r.id, {})[r.feature] = (r.value, r.contribution)
    x = np.array([[np.nan if got[i][f][0] is None else got[i][f][0] for f in FEATURES]
                  for i in range(600)])
    bins = boost._binned(list(x.T), fitted.edges).astype(int)
    for i in range(0, 600, 37):
        assert [got[i][f][1] for f in FEATURES] == pytest.approx(
            enumerated(fitted.trees, bins[i]), abs=1e-9)
    base = explain.base_value(fitted)
    for r in fitted.transform(data).collect():
        assert base + sum(v for _, v in got[r.id].values()) == pytest.approx(r.prediction, abs=1e-9)


def test_base_is_the_mean_prediction(data):
    fitted = boost.fit(data, FEATURES, "y", settings=boost.leafwise(rounds=3, leaves=8, depth=4))
    mean = fitted.transform(data).agg(F.avg("prediction")).first()[0]
    assert explain.base_value(fitted) == pytest.approx(mean, abs=1e-9)


def test_no_trees_and_no_rows(data, table):
    empty = boost.Booster(FEATURES, [np.zeros(0)] * 5, 3.0, [], [])
    assert explain.base_value(empty) == 3.0
    one = explain.contributions(data.limit(1), empty, ("id",)).collect()
    assert [r.feature for r in one] == FEATURES and {r.contribution for r in one} == {0.0}
    assert explain.contributions(table(SCHEMA, []), empty, ("id",)).count() == 0


def test_importance_names_what_matters(data):
    fitted = boost.fit(data, FEATURES, "y", settings=boost.leafwise(rounds=5, leaves=8, depth=4))
    got = {r.feature: r for r in explain.mean_contributions(
        explain.contributions(data, fitted, ("id",))).collect()}
    assert {r.rows for r in got.values()} == {600}
    assert max(got, key=lambda f: got[f].importance) == "a"
