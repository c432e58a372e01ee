"""Spark ML boosters fitted on groups of rows that no tree can tell apart.

A tree of a booster sees its inputs as bins only: rows with the same bins share every prediction, so
for squared errors their count and the sums of their labels and squares say all. Rows are binned and
grouped by a shuffle; the groups of one fit, far fewer than rows where inputs have few bins
together, then go through all rounds in one task that holds them as arrays. The trees are those of
``GBTRegressor.fit``: the first on the labels, each later one on twice the residuals, added at the
step size; best gain, first feature and lowest cut among equals. Cuts lie midway between the values
of an input with at most ``maxBins`` of them, else at its exact quantiles (Spark ML: of a sample).

The task writes its trees in the form Spark ML saves them in, and the model is loaded from there.

Not fitted here (``fit`` returns None, the caller leaves it to Spark ML): more than ``MOST_BINS``
bins over all groups, no rows, inputs that are no numbers or are categories, other losses, samples
of rows or inputs, weights, validation columns.
"""

from __future__ import annotations

import json
import time

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waitwright.lineage import cut, scratch_path
from waitwright.operators.quantiles import exact_quantiles

#: groups times inputs that one task holds; plan only, the job is the same beyond
MOST_BINS = 1 << 23
_EPSILON = 2.0 ** -52
_NODE = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, "
         "impurityStats: array<double>, rawCount: bigint, gain: double, leftChild: int, "
         "rightChild: int, split: struct<featureIndex: int, "
         "leftCategoriesOrThreshold: array<double>, numCategories: int>>")
_TREE_PARAMS = ("cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol",
                "leafCol", "maxBins", "maxDepth", "maxMemoryInMB", "minInfoGain",
                "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed")


def _usual(estimator: GBTRegressor, features: list[str], rows: DataFrame) -> bool:
    """Whether the trees follow from the bins, counts and label sums of groups."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    plain = (T.NumericType, T.BooleanType)
    if not features or not all(isinstance(kinds.get(f), plain) for f in features):
        return False
    if "nominal" in json.dumps(rows.schema["features"].metadata):
        return False
    given = lambda name: estimator.isDefined(name) and bool(estimator.getOrDefault(name))
    return (estimator.getLossType() == "squared" and estimator.getSubsamplingRate() == 1.0
            and estimator.getFeatureSubsetStrategy() in ("all", "auto", "1.0")
            and not estimator.getMinWeightFractionPerNode()
            and not given("weightCol") and not given("validationIndicatorCol"))


def cuts(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Rising cuts of each input; values up to a cut lie left of it."""
    values = rows.select([F.col(f).cast("double").alias(str(i)) for i, f in enumerate(features)])
    names = values.columns
    pairs = values if len(names) == 1 else values.unpivot([], names, "column", "v")
    if len(names) == 1:
        pairs = values.select(F.lit(names[0]).alias("column"), F.col(names[0]).alias("v"))
    single = cut(pairs.distinct())
    few = [r["column"] for r in single.groupBy("column").count().where(F.col("count") <= bins)
           .collect()]
    found: dict[str, list[float]] = {name: [] for name in names}
    for row in single.where(F.col("column").isin(few)).collect():
        found[row["column"]].append(row["v"])
    for name in few:
        held = sorted(found[name])
        found[name] = [(a + b) / 2 for a, b in zip(held, held[1:])]
    many = [name for name in names if name not in few]
    if many:
        probs = [i / bins for i in range(1, bins)]
        for row in exact_quantiles(values, many, probs, method="lower").collect():
            found[row["column"]].append(row["value"])
    return [np.array(sorted(set(found[name])), float) for name in names]


def groups(rows: DataFrame, features: list[str], label: str, at: list[np.ndarray]) -> DataFrame:
    """bins, n, total, square: rows and sums of labels and their squares, by bins."""
    y = F.col(label).cast("double")
    known = F.when(y.isNull() | F.isnan(y), F.raise_error(F.lit(
        "Labels MUST NOT be Null or NaN")).cast("double")).otherwise(y)
    picked = rows.select(known.alias("y"), *(F.col(f).cast("double").alias(f"f{i}")
                                             for i, f in enumerate(features)))

    def task(batches):
        for batch in batches:
            bins = np.zeros((batch.num_rows, len(at)), "<u2")
            for i, points in enumerate(at):
                values = batch.column(f"f{i}").to_numpy(zero_copy_only=False)
                bins[:, i] = np.searchsorted(points, values, "left")
            packed = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(2 * len(at)), batch.num_rows, [None, pa.py_buffer(bins.tobytes())])
            yield pa.RecordBatch.from_arrays([packed.cast(pa.binary()), batch.column("y")],
                                             names=["bins", "y"])

    return picked.mapInArrow(task, "bins binary, y double").groupBy("bins").agg(
        F.count("*").alias("n"), F.sum("y").alias("total"),
        F.sum(F.col("y") * F.col("y")).alias("square"))


def _impurity(n: np.ndarray, total: np.ndarray, square: np.ndarray) -> np.ndarray:
    return (square - total * total / n) / n


def grow(bins: np.ndarray, n: np.ndarray, total: np.ndarray, square: np.ndarray, width: int,
         depth: int, least_rows: int, least_gain: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Nodes of a tree, parents first, and the leaf of each group. ``bins``: [input, group]."""
    place, opened = np.zeros(len(n), np.int64), np.zeros(1, np.int64)
    nodes = {"n": [n.sum()], "total": [total.sum()], "square": [square.sum()],
             "feature": [-1], "at": [0], "gain": [-1.0], "left": [-1]}
    nodes = {name: np.array(values) for name, values in nodes.items()}
    for level in range(depth):
        slots = np.full(len(nodes["n"]), len(opened))
        slots[opened] = np.arange(len(opened))
        base = slots[place] * width
        rows, sums = np.zeros((2, len(opened), len(bins), width))
        for i, column in enumerate(bins):
            cell = base + column
            for into, weights in ((rows, n), (sums, total)):
                into[:, i] = np.bincount(cell, weights, (len(opened) + 1) * width).reshape(
                    -1, width)[:-1]
        best, gains = _best(rows, sums, least_rows, least_gain)
        picked = np.flatnonzero(gains > 0)
        if not len(picked):
            break
        first, count, parents = len(nodes["n"]), 2 * len(picked), opened[picked]
        nodes["feature"][parents], nodes["at"][parents] = np.divmod(best[picked], width)
        nodes["gain"][parents] = gains[picked]
        nodes["left"][parents] = first + np.arange(0, count, 2)
        low = np.full(first, -1)
        low[parents] = nodes["left"][parents]
        to = low[place]
        right = bins[nodes["feature"][place], np.arange(len(place))] > nodes["at"][place]
        place = np.where(to >= 0, to + right, place)
        new = np.where(to >= 0, place - first, count)
        held = {name: np.bincount(new, weights, count + 1)[:-1]
                for name, weights in (("n", n), ("total", total), ("square", square))}
        held |= {"feature": np.full(count, -1), "at": np.zeros(count, int),
                 "gain": np.full(count, -1.0), "left": np.full(count, -1)}
        nodes = {name: np.concatenate([nodes[name], held[name]]) for name in nodes}
        opened = first + np.flatnonzero(
            _impurity(held["n"], held["total"], held["square"]) >= _EPSILON)
        if not len(opened):
            break
    return nodes, place


def _best(rows: np.ndarray, sums: np.ndarray, least_rows: int, least_gain: float
          ) -> tuple[np.ndarray, np.ndarray]:
    """Best cut of each node and its gain, 0 where no cut is allowed; both by [node, input, bin]."""
    score = lambda s, r: s * s / np.maximum(r, 1)
    rows, sums = np.cumsum(rows, axis=2), np.cumsum(sums, axis=2)
    all_rows, all_sums = rows[:, :1, -1:], sums[:, :1, -1:]
    other_rows = all_rows - rows
    gains = (score(sums, rows) + score(all_sums - sums, other_rows)
             - score(all_sums, all_rows)) / all_rows
    allowed = (rows >= least_rows) & (other_rows >= least_rows) & (gains >= least_gain)
    gains = np.where(allowed, gains, 0.0).reshape(len(rows), -1)
    best = np.argmax(gains, axis=1)
    return best, gains[np.arange(len(rows)), best]


def _saved(number: int, tree: dict[str, np.ndarray], at: list[np.ndarray]) -> pa.RecordBatch:
    """Nodes in the form that Spark ML saves."""
    size, inner = len(tree["n"]), tree["left"] >= 0
    lists = lambda lengths, values: pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, pa.float64()))
    points = [float(at[f][k]) for f, k in zip(tree["feature"][inner], tree["at"][inner])]
    whole = lambda values: pa.array(values, pa.int32())
    split = pa.StructArray.from_arrays(
        [whole(tree["feature"]), lists(inner.astype(int), points), whole(np.full(size, -1))],
        ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    stats = np.stack([tree["n"], tree["total"], tree["square"]], axis=1).ravel()
    impurity = np.maximum(_impurity(tree["n"], tree["total"], tree["square"]), 0.0)
    data = pa.StructArray.from_arrays(
        [whole(np.arange(size)), pa.array(tree["total"] / tree["n"]), pa.array(impurity),
         lists(np.full(size, 3), stats), pa.array(tree["n"].astype(np.int64)),
         pa.array(tree["gain"]), whole(tree["left"]), whole(np.where(inner, tree["left"] + 1, -1)),
         split], ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild",
                  "rightChild", "split"])
    return pa.RecordBatch.from_arrays([whole(np.full(size, number)), data],
                                      names=["treeID", "nodeData"])


def _boost(held: DataFrame, at: list[np.ndarray], rounds: int, step: float, depth: int,
           least_rows: int, least_gain: float) -> DataFrame:
    """Nodes of all rounds, from one task over all groups."""
    width = max(len(points) for points in at) + 1

    def task(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        whole = pa.Table.from_batches(batches)
        bins = np.frombuffer(b"".join(whole.column("bins").to_pylist()), "<u2")
        bins = np.ascontiguousarray(bins.reshape(-1, len(at)).T)
        order = np.lexsort(bins[::-1])
        bins = np.ascontiguousarray(bins[:, order])
        n, total, square = (whole.column(c).to_numpy().astype(float)[order]
                            for c in ("n", "total", "square"))
        margin, rest, squares = np.zeros(len(n)), total, square
        for number in range(rounds):
            tree, leaf = grow(bins, n, rest, squares, width, depth, least_rows, least_gain)
            margin += (step if number else 1.0) * (tree["total"] / tree["n"])[leaf]
            rest = 2 * (total - n * margin)
            squares = 4 * (square - 2 * margin * total + n * margin * margin)
            yield _saved(number, tree, at)

    return held.coalesce(1).mapInArrow(task, _NODE)


def _described(estimator: GBTRegressor, kind: str, uid: str, names=None, **more) -> str:
    plain = lambda given: {p.name: v for p, v in given.items() if names is None or p.name in names}
    return json.dumps({
        "class": f"org.apache.spark.ml.regression.{kind}", "timestamp": int(time.time() * 1000),
        "sparkVersion": more.pop("version"), "uid": uid, "paramMap": plain(estimator._paramMap),
        "defaultParamMap": plain(estimator._defaultParamMap), **more})


def fit(estimator: GBTRegressor, features: list[str], rows: DataFrame) -> GBTRegressionModel | None:
    """The booster that ``estimator`` gives on ``rows``, which hold ``features`` and their vector."""
    if not _usual(estimator, features, rows):
        return None
    spark, rounds = rows.sparkSession, estimator.getMaxIter()
    at = cuts(rows, features, estimator.getMaxBins())
    held = cut(groups(rows, features, estimator.getLabelCol(), at))
    if not 0 < held.count() * len(features) <= MOST_BINS:
        return None
    path = scratch_path(spark, "booster")
    _boost(held, at, rounds, estimator.getStepSize(), estimator.getMaxDepth(),
           estimator.getMinInstancesPerNode(), estimator.getMinInfoGain()
           ).write.parquet(f"{path}/data")
    about = _described(estimator, "GBTRegressionModel", estimator.uid, version=spark.version,
                       numFeatures=len(features), numTrees=rounds)
    tree = _described(estimator, "DecisionTreeRegressionModel", f"{estimator.uid}_tree",
                      _TREE_PARAMS, version=spark.version)
    number = F.col("id").cast("int")
    spark.range(1).coalesce(1).select(F.lit(about).alias("value")).write.text(f"{path}/metadata")
    spark.range(0, rounds, 1, 1).select(
        number.alias("_1"), F.lit(tree).alias("_2"),
        F.when(number == 0, 1.0).otherwise(estimator.getStepSize()).alias("_3")
    ).write.parquet(f"{path}/treesMetadata")
    return GBTRegressionModel.load(path)
