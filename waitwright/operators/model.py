"""Wait-time regressors on Spark ML: train, compare, stack, explain."""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waitwright.lineage import cut, scratch_path
from waitwright.operators import grouped
from waitwright.operators.split import hash_share, split_key
from waitwright.settings import TARGET

SEED = 42
PATIENCE = 50


# --- estimators -------------------------------------------------------------------------------
def boosted_leafwise(label: str = TARGET, rounds: int = 500, **options) -> GBTRegressor:
    """Role of the leaf-wise booster: rate .05, up to 64 leaves."""
    return GBTRegressor(labelCol=label, maxIter=rounds, stepSize=0.05, maxDepth=6, maxBins=64,
                        seed=SEED, **options)


def boosted_symmetric(label: str = TARGET, rounds: int = 500, depth: int = 8,
                      **options) -> GBTRegressor:
    """Role of the symmetric-tree booster: rate .05, depth 8."""
    return GBTRegressor(labelCol=label, maxIter=rounds, stepSize=0.05, maxDepth=depth, seed=SEED,
                        **options)


def randomised_trees(label: str = TARGET, trees: int = 100, depth: int = 10,
                     **options) -> RandomForestRegressor:
    """Role of the extremely randomised trees."""
    return RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, seed=SEED,
                                 featureSubsetStrategy="onethird", **options)


def assembled(estimator: Estimator, features: list[str]) -> Pipeline:
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    return Pipeline(stages=[assembler, estimator])


def assembled_rows(rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` and their vector of features, written once in even parts, one per core.

    Tree learners read their rows three times, then go through them once a level with a task for
    each part: every level lasts as long as the largest part.
    """
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    parts = rows.sparkSession.sparkContext.defaultParallelism
    return cut(assembler.transform(rows).repartition(parts))


def fit_one(estimator: Estimator, features: list[str], rows: DataFrame) -> PipelineModel:
    """Assemble the features and fit one estimator; ``assembled_rows`` are taken as they are.

    Boosters go through groups of like rows where these are few enough, else through the rows.
    """
    pipeline = assembled(estimator, features)
    if "features" not in rows.columns:
        if not isinstance(estimator, (GBTRegressor, RandomForestRegressor)):
            return pipeline.fit(rows)
        rows = assembled_rows(rows, features)
    fitted = None
    if isinstance(estimator, GBTRegressor):
        fitted = grouped.fit(estimator, features, rows)
    if fitted is None:
        _bound_lineage(rows.sparkSession)
        fitted = estimator.fit(rows)
    return PipelineModel([pipeline.getStages()[0], fitted])


def _bound_lineage(spark: SparkSession) -> None:
    """Let Spark ML write its margins every few rounds: hundreds in one lineage end the stack."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_path(spark, "margins"))


def _in_threads(spark: SparkSession, jobs: dict, at_once: int | None = None
                ) -> dict[object, Future]:
    """Start all jobs, one per core at a time: a booster's rounds keep a single core busy."""
    pool = ThreadPoolExecutor(at_once or spark.sparkContext.defaultParallelism)
    running = {name: pool.submit(inheritable_thread_target(spark)(job))
               for name, job in jobs.items()}
    pool.shutdown(wait=False)
    return running


def _results(running: dict[object, Future]) -> dict:
    """What all jobs return; after a failure none is started any more."""
    try:
        return {name: job.result() for name, job in running.items()}
    finally:
        for job in running.values():
            job.cancel()


# --- metrics ----------------------------------------------------------------------------------
def regression_metrics(df: DataFrame, label: str = TARGET, prediction: str = "prediction"
                       ) -> DataFrame:
    """RMSE, MAE, R2 and MAPE in one aggregate; rows with a zero label are left out of MAPE."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    error = y - p
    known = error.isNotNull()
    squared = F.avg(error * error)
    return df.where(known).agg(
        F.count("*").alias("rows"),
        F.sqrt(squared).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        (F.lit(1.0) - F.try_divide(squared, F.var_pop(y))).alias("r2"),
        (F.avg(F.abs(F.try_divide(error, y))) * F.lit(100.0)).alias("mape"),
        F.count_if(y == 0).alias("zero_labels"),
    )


# --- early stopping ---------------------------------------------------------------------------
def best_round(errors: list[float], patience: int = PATIENCE) -> int:
    """Round (from 0) with the least error before ``patience`` rounds passed without a new least."""
    best = 0
    for number, error in enumerate(errors):
        if error < errors[best]:
            best = number
        elif number - best >= patience:
            break
    return best


def first_rounds(model: GBTRegressionModel, count: int) -> GBTRegressionModel:
    """The same booster with its first ``count`` trees only."""
    context = SparkContext.getOrCreate()
    regression = context._jvm.org.apache.spark.ml.regression
    trees = context._gateway.new_array(regression.DecisionTreeRegressionModel, count)
    weights = context._gateway.new_array(context._jvm.double, count)
    given, shares = model._java_obj.trees(), model.treeWeights
    for number in range(count):
        trees[number], weights[number] = given[number], float(shares[number])
    cut_short = GBTRegressionModel(regression.GBTRegressionModel(model.uid, trees, weights))
    return (cut_short.setFeaturesCol(model.getFeaturesCol())
            .setPredictionCol(model.getPredictionCol()))


def fit_boosted(estimator: GBTRegressor, features: list[str], train: DataFrame,
                validation: DataFrame, patience: int = PATIENCE) -> PipelineModel:
    """Boost on ``train`` for all rounds, then keep those up to the best one on ``validation``."""
    model = fit_one(estimator, features, train)
    *before, booster = model.stages
    ready = PipelineModel(before).transform(validation)
    errors = list(booster.evaluateEachIteration(ready, "squared"))
    return PipelineModel([*before, first_rounds(booster, best_round(errors, patience) + 1)])


# --- compare ----------------------------------------------------------------------------------
@dataclass
class Comparison:
    """Fitted candidates and their test metrics, best first; rounds kept by boosters."""

    models: dict[str, PipelineModel]
    metrics: DataFrame
    best: str
    rounds: dict[str, int]


def train_and_compare(split: DataFrame, features: list[str], candidates: dict[str, Estimator],
                      label: str = TARGET, patience: int = PATIENCE) -> Comparison:
    """Fit on ``train``, stop boosters at their best ``validation`` round, rank on ``test`` RMSE.

    The first listed candidate wins ties. Only metrics reach the driver.
    """
    spark = split.sparkSession
    data = split.where(F.col(label).isNotNull())
    train, validation, test = (data.where(F.col("split") == part)
                               for part in ("train", "validation", "test"))
    models, rows = {}, []
    train = assembled_rows(train, features)
    stops = not validation.isEmpty()

    def boosted(estimator):
        if stops:
            return fit_boosted(estimator, features, train, validation, patience)
        return fit_one(estimator, features, train)

    boosting = _in_threads(spark, {name: partial(boosted, estimator)
                                   for name, estimator in candidates.items()
                                   if isinstance(estimator, GBTRegressor)})
    for position, (name, estimator) in enumerate(candidates.items()):
        models[name] = model = (boosting[name].result() if name in boosting
                                else fit_one(estimator, features, train))
        scores = regression_metrics(model.transform(test), label).first()
        rows.append((position, name, scores["rmse"], scores["mae"], scores["r2"], scores["mape"]))
    best = min(rows, key=lambda row: (row[2], row[0]))[1]
    metrics = _rows(spark, ("position", "model", "rmse", "mae", "r2", "mape"), rows)
    rounds = {name: model.stages[-1].getNumTrees for name, model in models.items()
              if isinstance(model.stages[-1], GBTRegressionModel)}
    return Comparison(models, metrics.orderBy("rmse", "position"), best, rounds)


def _rows(spark: SparkSession, names: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    """Table from a few driver values."""
    entries = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*entries)))


def baseline_metrics(split: DataFrame, label: str = TARGET) -> DataFrame:
    """Metrics of always predicting the training mean, on the same test rows."""
    mean = split.where("split = 'train'").agg(F.avg(label)).first()[0]
    return regression_metrics(split.where("split = 'test'").withColumn("prediction", F.lit(mean)),
                              label)


# --- stacking ---------------------------------------------------------------------------------
@dataclass
class Stack:
    """Base models fitted on all training rows and a linear model over their predictions."""

    bases: dict[str, PipelineModel]
    meta: PipelineModel
    log_target: bool

    def transform(self, df: DataFrame) -> DataFrame:
        scored = _base_predictions(df, self.bases)
        result = self.meta.transform(scored.drop("features")).drop("features", *_names(self.bases))
        value = F.expm1("prediction") if self.log_target else F.col("prediction")
        return result.withColumn("prediction", F.greatest(value, F.lit(0.0)))


def _names(bases: dict) -> list[str]:
    return [f"base_{name}" for name in bases]


def _base_predictions(df: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    for name, model in models.items():
        df = (model.transform(df.drop("features"))
              .withColumnRenamed("prediction", f"base_{name}"))
    return df


def meta_learner(kind: str, label: str, deviation: float, rows: int, alpha: float = 1.0
                 ) -> LinearRegression:
    """Linear learner whose penalty equals ``alpha`` in the usual textbook objectives.

    Spark scales the label by its deviation, which shrinks the squared penalty by as much;
    the ridge objective in use sums rather than averages squared errors.
    """
    absolute, squared = {"ridge": (0.0, alpha / rows), "lasso": (alpha, 0.0)}.get(
        kind, (alpha / 2, alpha / 2))
    strength = absolute + deviation * squared
    return LinearRegression(
        labelCol=label, regParam=strength, elasticNetParam=absolute / strength if strength else 0.0,
        standardization=False, solver="normal" if kind == "ridge" else "auto", maxIter=500,
        tol=1e-9)


def fit_stack(train: DataFrame, features: list[str], bases: dict[str, Estimator], *,
              label: str = TARGET, key: str = "patient_id", meta: str = "ridge",
              folds: int = 5, log_target: bool = True) -> Stack:
    """Out-of-fold predictions of every base train the linear learner."""
    target = "_label"
    value = F.log1p(label) if log_target else F.col(label).cast("double")
    fold = F.pmod(F.shiftright(hash_share(split_key(train, key), SEED), 7), F.lit(folds))
    data = assembled_rows(train.withColumns({target: value, "_fold": fold.cast("int")}), features)
    named = {name: est.copy({est.labelCol: target}) for name, est in bases.items()}
    # Rows of a fit: all but a fold's, or all of them.
    parts = {number: data.where(F.col("_fold") != number) for number in range(folds)}
    parts[None] = data
    fits = {(number, name): partial(fit_one, est, features, rest)
            for number, rest in parts.items() for name, est in named.items()}
    spark, boosts = data.sparkSession, lambda place: isinstance(named[place[1]], GBTRegressor)
    running = _in_threads(spark, {p: fit for p, fit in fits.items() if boosts(p)})
    # Others spread over all cores; two of them, as the driver also works alone between levels.
    running |= _in_threads(spark, {p: fit for p, fit in fits.items() if not boosts(p)}, 2)
    done = _results(running)
    held_out = None
    for number in range(folds):
        fitted = {name: done[number, name] for name in named}
        part = _base_predictions(data.where(F.col("_fold") == number), fitted)
        part = part.select(target, *_names(bases))
        held_out = part if held_out is None else held_out.unionByName(part)
    held_out = cut(held_out)
    size = held_out.agg(F.count("*").alias("rows"), F.stddev_pop(target).alias("std")).first()
    learner = meta_learner(meta, target, size["std"], size["rows"])
    fitted_meta = fit_one(learner, _names(bases), held_out)
    return Stack({name: done[None, name] for name in named}, fitted_meta, log_target)


# --- explanation ------------------------------------------------------------------------------
def feature_importance(models: dict[str, PipelineModel], features: list[str],
                       spark: SparkSession) -> DataFrame:
    """Mean importance over the fitted models that have one, largest first."""
    rows = []
    for name, model in models.items():
        weights = getattr(model.stages[-1], "featureImportances", None)
        if weights is not None:
            rows += [(name, f, float(w)) for f, w in zip(features, weights.toArray())]
    table = _rows(spark, ("model", "feature", "importance"), rows)
    return (table.groupBy("feature").agg(F.avg("importance").alias("importance"))
            .orderBy(F.desc("importance"), "feature"))


def learning_curve(model: PipelineModel, train: DataFrame, test: DataFrame) -> DataFrame:
    """RMSE per boosting round on training and test rows."""
    booster, ready = model.stages[-1], PipelineModel(model.stages[:-1])
    learn = booster.evaluateEachIteration(ready.transform(train), "squared")
    held = booster.evaluateEachIteration(ready.transform(test), "squared")
    rows = [(i, a ** 0.5, b ** 0.5) for i, (a, b) in enumerate(zip(learn, held))]
    return _rows(train.sparkSession, ("iter", "learn_rmse", "test_rmse"), rows)


def best_iteration(curve: DataFrame) -> DataFrame:
    """One row: last and best test error of a learning curve."""
    return curve.agg(
        F.count("*").alias("iterations"),
        F.min_by("iter", F.struct("test_rmse", "iter")).alias("best_iteration"),
        F.min("test_rmse").alias("best_test_rmse"),
        F.max_by("learn_rmse", "iter").alias("final_learn_rmse"),
        F.max_by("test_rmse", "iter").alias("final_test_rmse"))
