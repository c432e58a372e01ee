"""Extremely randomised trees against a plain twin on raw rows, for any partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waitwright.operators import extra_trees as et
from waitwright.operators.boost import UNITS

FEATURES = ["a", "b", "c"]
SCHEMA = "a double, b double, c double, y double"


def rows_of(n=500):
    rng = np.random.default_rng(2)
    x = np.round(rng.uniform(0, 10, (n, 3)), 1)
    x[rng.uniform(size=x.shape) < 0.1] = np.nan
    x[:, 2] = np.where(rng.uniform(size=n) < 0.5, 1.0, x[:, 2])
    return x, 3 * np.nan_to_num(x[:, 0]) + (np.nan_to_num(x[:, 1]) > 5) * 8 + rng.normal(size=n)


@pytest.fixture(scope="module")
def data(spark):
    x, y = rows_of()
    return spark.createDataFrame([(*(None if np.isnan(v) else float(v) for v in r), float(t))
                                  for r, t in zip(x, y)], SCHEMA)


def twin(x, y, base, unit, tree, settings):
    """One tree, node by node in level order: (feature, cut, rows, mean) of every node."""
    units, nodes, level, number = np.rint((y - base) / unit), {}, [(0, np.arange(len(x)))], 1
    nodes[0] = [-1, None, len(x), 0.0]
    for _ in range(settings.depth):
        coming = []
        for node, rows in level:
            if len(rows) < 2 * settings.min_rows:
                continue
            known = [x[rows, f][~np.isnan(x[rows, f])] for f in range(3)]
            span = lambda pick: np.array([pick(v) if len(v) else np.nan for v in known])
            best = None
            for f, at in et.draws(settings, tree, node, span(np.min), span(np.max)):
                right = x[rows, f] > at
                sides = rows[~right], rows[right]
                if min(map(len, sides)) < settings.min_rows:
                    continue
                score = lambda r: units[r].sum() ** 2 / len(r)
                gain = score(sides[0]) + score(sides[1]) - score(rows)
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, f, at, sides
            if best is None:
                continue
            nodes[node][:2] = best[1], best[2]
            for side in best[3]:
                nodes[number] = [-1, None, len(side), units[side].sum() * unit / len(side)]
                coming.append((number, side))
                number += 1
        level = coming
    return nodes


@pytest.mark.parametrize("settings", [et.Settings(trees=3, depth=4),
                                      et.Settings(trees=2, depth=3, drawn=1, seed=7)])
def test_equal_the_plain_twin(data, settings):
    x, y = rows_of()
    forest = et.fit(data.repartition(5), FEATURES, "y", settings)
    base = forest.base
    unit = max(y.max() - base, base - y.min()) / UNITS
    for number, tree in enumerate(forest.trees):
        want = twin(x, y, base, unit, number, settings)
        assert len(tree.feature) == len(want)
        for node, (feature, at, n, mean) in want.items():
            assert (tree.feature[node], tree.n[node]) == (feature, n)
            assert feature < 0 or tree.cut[node] == at
            assert tree.value[node] == pytest.approx(mean, abs=1e-9)


def test_same_forest_for_any_partitioning(data):
    one = et.fit(data.coalesce(1), FEATURES, "y", et.Settings(trees=4, depth=5))
    many = et.fit(data.orderBy(F.rand(1)).repartition(9), FEATURES, "y",
                  et.Settings(trees=4, depth=5))
    assert one == many


def test_forest_beats_the_mean_and_its_trees_differ(data):
    forest = et.fit(data, FEATURES, "y", et.Settings(trees=8, depth=6))
    assert len({tuple(t.cut) for t in forest.trees}) == 8
    row = forest.transform(data).agg(
        F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2)).alias("rmse"),
        F.stddev_pop("y").alias("spread")).first()
    assert row["rmse"] < 0.5 * row["spread"]


def test_defined_cases(table):
    empty = et.fit(table(SCHEMA, []), FEATURES, "y")
    assert empty.trees == []
    assert empty.transform(table(SCHEMA, [(1.0, None, 2.0, None)])).first()["prediction"] == 0.0
    flat = et.fit(table(SCHEMA, [(1.0, None, 2.0, 4.0)] * 30 + [(1.0, None, 2.0, None)]),
                  FEATURES, "y", et.Settings(trees=2))
    assert all(t.feature == [-1] for t in flat.trees)
    assert flat.transform(table(SCHEMA, [(None, None, None, None)])).first()["prediction"] == 4.0
