import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from waitwright.operators import grouped, model
from waitwright.plans import catalogue

INPUTS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def ready(spark):
    """Inputs of 7, 10 and 20 values, a label with noise of its own for every row."""
    value = lambda seed, size: F.pmod(F.hash("id", F.lit(seed)), F.lit(size))
    rows = spark.range(3000).select(
        "id", value(1, 7).cast("double").alias("a"), value(2, 10).alias("b"),
        value(3, 20).cast("double").alias("c"), (value(4, 1000) / 50).alias("noise"))
    rows = rows.withColumn("y", F.col("a") * 2 + F.col("b") * F.col("c") + F.col("noise"))
    return model.assembled_rows(rows, INPUTS)


@pytest.mark.parametrize("make", [
    lambda: model.boosted_leafwise("y", 8),
    lambda: model.boosted_symmetric("y", 6, depth=4, minInstancesPerNode=15, minInfoGain=0.5)])
def test_trees_are_those_of_spark_ml(ready, make):
    estimator = make()
    theirs, ours = estimator.fit(ready), grouped.fit(estimator, INPUTS, ready)
    assert ours.treeWeights == theirs.treeWeights
    assert ours.totalNumNodes == theirs.totalNumNodes
    assert ours.uid == theirs.uid and ours.extractParamMap() == theirs.extractParamMap()
    np.testing.assert_allclose(ours.featureImportances.toArray(),
                               theirs.featureImportances.toArray(), rtol=1e-9)
    both = theirs.transform(ready).withColumnRenamed("prediction", "theirs")
    gap = ours.transform(both.drop("features").join(ready.select("id", "features"), "id")).agg(
        F.max(F.abs(F.col("prediction") - F.col("theirs")))).first()[0]
    assert gap < 1e-9


def test_an_input_of_many_values_is_cut_at_its_quantiles(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=1000)
    y = np.where(x > 0.4, 3.0, 1.0) + rng.normal(0, 0.1, 1000)
    rows = model.assembled_rows(spark.createDataFrame(
        [(float(p), float(q)) for p, q in zip(x, y)], "x double, y double"), ["x"])
    held = np.sort(x)
    points = [held[int(i / 8 * 999)] for i in range(1, 8)]
    loss = {p: ((y[x <= p] - y[x <= p].mean()) ** 2).sum() + ((y[x > p] - y[x > p].mean()) ** 2).sum()
            for p in points}
    stump = grouped.fit(model.GBTRegressor(labelCol="y", maxIter=1, maxDepth=1, maxBins=8),
                        ["x"], rows)
    root = stump.trees[0]._java_obj.rootNode()
    assert root.split().threshold() == min(loss, key=loss.get)


def test_rows_in_too_many_groups_are_left_to_spark_ml(ready, monkeypatch):
    booster = model.boosted_leafwise("y", 3)
    whole = model.fit_one(booster, INPUTS, ready)
    monkeypatch.setattr(grouped, "MOST_BINS", 100)
    assert grouped.fit(booster, INPUTS, ready) is None
    plain = model.fit_one(booster, INPUTS, ready)
    total = lambda fitted: fitted.stages[-1].transform(ready).agg(F.sum("prediction")).first()[0]
    assert plain.stages[-1].getNumTrees == 3
    assert total(plain) == pytest.approx(total(whole))


def test_other_losses_and_samples_are_left_to_spark_ml(ready):
    for options in ({"subsamplingRate": 0.5}, {"lossType": "absolute"},
                    {"featureSubsetStrategy": "onethird"}):
        assert grouped.fit(model.boosted_leafwise("y", 2, **options), INPUTS, ready) is None


def test_a_missing_label_is_still_refused(ready):
    rows = ready.withColumn("y", F.when(F.col("id") > 5, F.col("y")))
    with pytest.raises(Exception, match="Labels MUST NOT be Null or NaN"):
        model.fit_one(model.boosted_leafwise("y", 2), INPUTS, rows)


class Given(Exception):
    """Ends a query where its estimators are known."""


def test_compare_query_gives_both_boosters_all_rounds(spark, data, monkeypatch):
    def given(split, features, candidates, label):
        raise Given({n: (e.getMaxIter(), e.getMaxDepth()) for n, e in candidates.items()})

    monkeypatch.setattr(model, "train_and_compare", given)
    with pytest.raises(Given) as found:
        catalogue.model_compare(spark, data)
    assert found.value.args[0] == {"leafwise": (500, 6), "symmetric": (500, 8)}


def test_stack_query_gives_its_bases_all_rounds_trees_and_levels(spark, data, monkeypatch):
    def given(rows, features, bases, **options):
        raise Given({n: (e.getOrDefault("maxIter") if e.hasParam("maxIter") else e.getNumTrees(),
                         e.getMaxDepth()) for n, e in bases.items()})

    monkeypatch.setattr(model, "fit_stack", given)
    with pytest.raises(Given) as found:
        catalogue.model_stack(spark, data)
    assert found.value.args[0] == {"leafwise": (500, 6), "symmetric": (500, 8),
                                   "trees": (100, 10), "shallow": (100, 4)}


def test_a_stack_holds_the_fits_on_all_rows(spark):
    rows = spark.range(400).select("id", (F.col("id") % 5).cast("double").alias("a"),
                                   (F.col("id") % 7).cast("double").alias("b"))
    rows = rows.withColumn("y", F.col("a") * 3 + F.col("b"))
    bases = {"boosted": model.boosted_leafwise("y", 3),
             "trees": model.randomised_trees("y", trees=2, depth=3)}
    stack = model.fit_stack(rows, ["a", "b"], bases, label="y", key="id", folds=3)
    assert list(stack.bases) == ["boosted", "trees"]
    root = lambda fitted: fitted.trees[0]._java_obj.rootNode()
    assert root(stack.bases["boosted"].stages[-1]).impurityStats().count() == 400
    scored = stack.transform(rows)
    assert scored.count() == 400 and "features" not in scored.columns


def test_a_failed_fit_ends_the_others(spark):
    def failing():
        raise ValueError("no rows")

    later = []
    jobs = {"bad": failing} | {n: lambda: time.sleep(0.2) or later.append(1) for n in range(20)}
    with pytest.raises(ValueError, match="no rows"):
        model._results(model._in_threads(spark, jobs, 1))
    assert len(later) < 5
