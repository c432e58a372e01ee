"""Boosting against plain trees grown one cut at a time, stopping, resuming, defined cases."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from waitwright.operators import boost

FEATURES = ["a", "b", "c"]


def rows_of(seed, n, noise):
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(0, 10, n), np.round(rng.uniform(0, 1, n), 1)
    c = np.where(rng.uniform(size=n) < 0.2, np.nan, rng.integers(0, 4, n))
    y = 2 * a + 5 * (b > 0.5) + np.nan_to_num(c) * (a > 5) + rng.normal(0, noise, n)
    return np.column_stack([a, b, c]), y


def frame(spark, x, y, parts=4):
    rows = [(*(None if np.isnan(v) else float(v) for v in r), float(t)) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(parts)


class Plain:
    """One tree on raw rows: cuts at the edges, one at a time, no histograms."""

    def __init__(self, x, units, edges, settings):
        self.x, self.units, self.edges, self.s = x, units, edges, settings

    def score(self, rows):
        return float(self.units[rows].sum()) ** 2 / max(len(rows) + self.s.ridge, 1)

    def sides(self, rows, feature, at):
        values = self.x[rows, feature]
        low = np.isnan(values) if at == 0 else np.isnan(values) | (values <= self.edges[feature][at - 1])
        return rows[low], rows[~low]

    def cuts(self):
        return [(f, at) for f in range(self.x.shape[1]) for at in range(len(self.edges[f]) + 1)]

    def best(self, rows):
        found = None
        for f, at in self.cuts():
            l, r = self.sides(rows, f, at)
            if min(len(l), len(r)) >= self.s.min_rows:
                gain = self.score(l) + self.score(r) - self.score(rows)
                if gain > 0 and (found is None or gain > found[0]):
                    found = (gain, f, at)
        return found

    def leafwise(self):
        leaves, heap = {0: np.arange(len(self.x))}, []
        depth, number = {0: 0}, 0
        push = lambda k: (b := self.best(leaves[k])) and depth[k] < self.s.depth and heapq.heappush(
            heap, (-b[0], k, b[1], b[2]))
        push(0)
        while heap and len(leaves) < self.s.leaves:
            _, k, f, at = heapq.heappop(heap)
            for part in self.sides(leaves.pop(k), f, at):
                number += 1
                leaves[number], depth[number] = part, depth[k] + 1
                push(number)
        return list(leaves.values())

    def symmetric(self):
        leaves = [np.arange(len(self.x))]
        for _ in range(self.s.depth):
            gains = [(sum(self.score(l) + self.score(r) - self.score(rows) for rows in leaves
                          for l, r in [self.sides(rows, f, at)]), f, at) for f, at in self.cuts()]
            gain, f, at = max(gains, key=lambda g: g[0])
            if gain <= 0:
                break
            leaves = [part for rows in leaves for part in self.sides(rows, f, at)]
        return [rows for rows in leaves if len(rows)]


def plain_predictions(x, y, edges, base, settings):
    margin, unit = np.full(len(y), base), max(y.max() - base, base - y.min()) / boost.UNITS
    for _ in range(settings.rounds):
        units = np.rint((y - margin) / unit)
        tree = Plain(x, units, edges, settings)
        for rows in tree.symmetric() if settings.symmetric else tree.leafwise():
            margin[rows] += settings.rate * units[rows].sum() * unit / max(
                len(rows) + settings.ridge, 1)
    return margin


@pytest.mark.parametrize("settings", [
    boost.leafwise(rounds=3, leaves=7, depth=5, bins=12, min_rows=5, rate=0.3),
    boost.leafwise(rounds=2, leaves=4, depth=9, bins=12, min_rows=1, rate=0.3),
    boost.symmetric(rounds=3, depth=3, bins=12, rate=0.3, every=1)])
def test_trees_equal_plain_ones(spark, settings):
    x, y = rows_of(1, 240, 0.5)
    model = boost.fit(frame(spark, x, y), FEATURES, "y", settings=settings)
    got = sorted((r.y, r.prediction) for r in model.transform(frame(spark, x, y)).collect())
    want = sorted(zip(y, plain_predictions(x, y, model.edges, model.base, settings)))
    assert np.allclose([p for _, p in got], [p for _, p in want], atol=1e-9)


def test_leafwise_is_not_complete_and_keeps_its_number_of_leaves(spark):
    x, y = rows_of(2, 400, 0.2)
    tree = boost.fit(frame(spark, x, y), FEATURES, "y", settings=boost.leafwise(
        rounds=1, leaves=6, depth=10, min_rows=5)).trees[0]
    assert tree.feature.count(-1) == 6 and len(tree.feature) == 11


def test_trees_do_not_depend_on_partitions(spark):
    x, y = rows_of(3, 300, 0.5)
    settings = boost.leafwise(rounds=3, leaves=8, min_rows=5)
    one, many = (boost.fit(frame(spark, x, y, p), FEATURES, "y", settings=settings).trees
                 for p in (1, 7))
    assert one == many


def test_training_ends_after_the_best_round(spark):
    """A noisy target overfits: the best round lies before the last, and the work ends there."""
    x, y = rows_of(4, 200, 6.0)
    u, v = rows_of(5, 200, 6.0)
    model = boost.fit(frame(spark, x, y), FEATURES, "y", frame(spark, u, v), boost.leafwise(
        rounds=60, rate=0.4, leaves=16, min_rows=2, patience=4))
    best = min(range(1, len(model.errors)), key=model.errors.__getitem__)
    assert len(model.trees) == best and len(model.errors) - 1 == best + 4 < 60
    scored = model.transform(frame(spark, u, v))
    rmse = scored.agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
    assert rmse == pytest.approx(model.errors[best], rel=1e-4)


def test_a_run_resumes_from_its_folder(spark, tmp_path):
    x, y = rows_of(6, 200, 0.5)
    u, v = rows_of(7, 100, 0.5)
    fit = lambda rounds, folder: boost.fit(
        frame(spark, x, y), FEATURES, "y", frame(spark, u, v),
        boost.symmetric(rounds=rounds, depth=2, every=2, bins=8), folder)
    whole, folder = fit(6, None), str(tmp_path / "run")
    fit(4, folder)
    again = fit(6, folder)
    assert again.trees == whole.trees and again.errors[1:] == whole.errors[1:]
    table = again.nodes(spark)
    assert table.agg(F.count_distinct("round")).first()[0] == len(again.trees)


def test_defined_cases(spark):
    schema = "a double, b double, c double, y double"
    empty = spark.createDataFrame([], schema)
    model = boost.fit(empty, FEATURES, "y")
    some = spark.createDataFrame([(1.0, None, float("nan"), 2.0), (None, None, None, None)], schema)
    assert [r.prediction for r in model.transform(some).collect()] == [0.0, 0.0]
    assert model.transform(empty).count() == 0
    constant = boost.fit(some, FEATURES, "y", settings=boost.leafwise(rounds=2))
    assert [r.prediction for r in constant.transform(some).collect()] == [2.0, 2.0]
    more = some.withColumns({"margin": F.lit("x"), "valid": F.lit("y"), "bins": F.lit(1)})
    assert boost.fit(more, FEATURES, "y", more, boost.leafwise(rounds=1)).base == 2.0
