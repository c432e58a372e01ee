import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from waitwright.operators import model, split
from waitwright.settings import TARGET

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def visits(spark):
    rng = np.random.default_rng(0)
    a, b = rng.uniform(0, 10, 1500), rng.uniform(0, 1, 1500)
    y = 5 + 3 * a + 10 * (b > 0.5) + rng.normal(0, 1, 1500)
    df = spark.createDataFrame([(i, float(p), float(q), float(r)) for i, (p, q, r) in
                                enumerate(zip(a, b, y))],
                               f"patient_id bigint, a double, b double, {TARGET} double")
    return split.split_by_hash(df, "patient_id").cache()


def test_metrics_equal_numpy(table):
    y, p = np.array([3.0, 5.0, 0.0, 8.0]), np.array([2.0, 5.5, 1.0, 7.0])
    row = model.regression_metrics(table(f"{TARGET} double, prediction double", [
        (float(u), float(v)) for u, v in zip(y, p)])).first()
    assert row["rmse"] == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
    assert row["mae"] == pytest.approx(np.mean(np.abs(y - p)))
    assert row["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    known = y != 0
    assert row["mape"] == pytest.approx(np.mean(np.abs((y - p)[known] / y[known])) * 100)
    assert row["zero_labels"] == 1


def test_candidates_beat_the_mean_and_the_best_can_be_saved(spark, visits, tmp_path):
    candidates = {"leafwise": model.boosted_leafwise(rounds=20, minInstancesPerNode=5),
                  "symmetric": model.boosted_symmetric(rounds=10, depth=4),
                  "trees": model.randomised_trees(trees=10, depth=5)}
    result = model.train_and_compare(visits, FEATURES, candidates)
    rows = result.metrics.collect()
    assert [r["rmse"] for r in rows] == sorted(r["rmse"] for r in rows)
    assert result.best == rows[0]["model"]
    base = model.baseline_metrics(visits).first()["rmse"]
    assert rows[0]["rmse"] < base / 2
    best = result.models[result.best]
    best.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    test = visits.where("split = 'test'")
    before = best.transform(test).agg(F.sum("prediction")).first()[0]
    assert again.transform(test).agg(F.sum("prediction")).first()[0] == pytest.approx(before)


def test_first_candidate_wins_ties(visits):
    same = {"one": model.randomised_trees(trees=2, depth=2),
            "two": model.randomised_trees(trees=2, depth=2)}
    assert model.train_and_compare(visits, FEATURES, same).best == "one"


def test_ridge_and_lasso_penalties_equal_the_textbook(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 2, (200, 2))
    y = x @ [1.5, -0.5] + 4 + rng.normal(0, 0.3, 200)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)],
                               "a double, b double, y double")
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)
    centred, target = x - x.mean(0), y - y.mean()
    ridge = model.meta_learner("ridge", "y", y.std(), len(y), alpha=30.0).fit(ready)
    expected = np.linalg.solve(centred.T @ centred + 30.0 * np.eye(2), centred.T @ target)
    np.testing.assert_allclose(ridge.coefficients.toArray(), expected, rtol=1e-6)
    weights = model.meta_learner("lasso", "y", y.std(), len(y), alpha=0.4).fit(ready)
    w = weights.coefficients.toArray()
    slope = centred.T @ (target - centred @ w) / len(y)
    active = np.abs(w) > 1e-8
    np.testing.assert_allclose(slope[active], 0.4 * np.sign(w[active]), atol=1e-4)
    elastic = model.meta_learner("elastic", "y", y.std(), len(y), alpha=0.4).fit(ready)
    w = elastic.coefficients.toArray()
    slope = centred.T @ (target - centred @ w) / len(y) - 0.2 * w
    np.testing.assert_allclose(slope, 0.2 * np.sign(w), atol=1e-4)


def test_stack_beats_the_mean_and_never_goes_negative(visits):
    bases = {"leafwise": model.boosted_leafwise(rounds=8),
             "trees": model.randomised_trees(trees=5, depth=5)}
    stack = model.fit_stack(visits.where("split = 'train'"), FEATURES, bases, folds=3)
    scored = stack.transform(visits.where("split = 'test'"))
    assert scored.agg(F.min("prediction")).first()[0] >= 0
    assert model.regression_metrics(scored).first()["rmse"] < (
        model.baseline_metrics(visits).first()["rmse"] / 2)


def test_importance_and_learning_curve(spark, visits):
    train, test = visits.where("split = 'train'"), visits.where("split = 'test'")
    fitted = model.fit_one(model.boosted_leafwise(rounds=4), FEATURES, train)
    table = model.feature_importance({"m": fitted}, FEATURES, spark).collect()
    assert [r["feature"] for r in table] == ["a", "b"]
    assert sum(r["importance"] for r in table) == pytest.approx(1.0)
    curve = model.learning_curve(fitted, train, test)
    errors = [r["learn_rmse"] for r in curve.orderBy("iter").collect()]
    assert len(errors) == 4 and errors == sorted(errors, reverse=True)
    best = model.best_iteration(curve).first()
    assert best["iterations"] == 4 and best["best_test_rmse"] <= best["final_test_rmse"]


def test_boosting_keeps_the_trees_up_to_the_best_validation_round(spark):
    """A linear target still gains at the last round, so every round stays."""
    names = [f"x{i}" for i in range(3)]
    rows = spark.range(1500).select(
        *[(F.pmod(F.hash("id", F.lit(i)), F.lit(1000)) / 100.0).alias(n)
          for i, n in enumerate(names)], "id")
    rows = rows.withColumn("y", sum(F.col(n) * (k + 1) for k, n in enumerate(names))).coalesce(2)
    train, validation = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    booster = model.boosted_leafwise("y", 12)
    kept = model.fit_boosted(booster, names, train, validation)
    assert kept.stages[-1].getNumTrees == 12
    whole = model.fit_one(booster, names, train)
    short = model.first_rounds(whole.stages[-1], 5)
    curve = model.learning_curve(whole, train, validation).collect()
    cut = model.PipelineModel([*whole.stages[:-1], short]).transform(validation)
    rmse = model.regression_metrics(cut, "y").first()["rmse"]
    assert rmse == pytest.approx(curve[4]["test_rmse"])


def test_patience():
    assert model.best_round([5, 4, 3, 3.5, 3.4, 2], patience=2) == 2
    assert model.best_round([5, 4, 3, 3.5, 3.4, 2], patience=4) == 5
    assert model.best_round([1.0]) == 0


class Watched(RandomForestRegressor):
    """Keeps the sizes of the parts that every fit is given."""

    seen = []

    def _fit(self, dataset):
        Watched.seen.append([len(part) for part in dataset.select("a").rdd.glom().collect()])
        return super()._fit(dataset)


def watched():
    return Watched(labelCol=TARGET, numTrees=2, maxDepth=2, seed=1)


@pytest.mark.parametrize("fit", [
    lambda rows: model.fit_one(watched(), FEATURES, rows),
    lambda rows: model.train_and_compare(rows, FEATURES, {"one": watched(), "two": watched()}),
    lambda rows: model.fit_stack(rows, FEATURES, {"one": watched(), "two": watched()}, folds=2)])
def test_tree_learners_get_even_parts_however_the_rows_lie(spark, visits, fit):
    Watched.seen = []
    few = visits.where("patient_id < 40").coalesce(1)
    fit(few.unionByName(visits.where("patient_id >= 40").coalesce(1)))
    for sizes in Watched.seen:
        assert len(sizes) == spark.sparkContext.defaultParallelism
        assert max(sizes) < 2 * sum(sizes) / len(sizes)


def test_rows_are_assembled_once_for_all_fits(visits, monkeypatch):
    written = []
    cut = model.cut
    monkeypatch.setattr(model, "cut", lambda df: written.append(df.columns) or cut(df))
    model.fit_stack(visits, FEATURES, {"one": watched(), "two": watched()}, folds=2)
    assert sum("features" in columns for columns in written) == 1


def test_a_feature_that_is_missing_is_still_refused(spark):
    rows = spark.createDataFrame([(1.0, None, 2.0), (2.0, 1.0, 3.0)], f"a double, b double, {TARGET} double")
    with pytest.raises(Exception, match="null"):
        model.fit_one(watched(), FEATURES, rows)
