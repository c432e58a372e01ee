"""Boosted regression trees on binned features, grown level by level, stopped when they end to help.

Features are cut at exact quantiles of the training rows into at most ``bins`` bins (bin 0: missing)
and kept as one byte each beside label and margin in a written table. A level of a tree is one job:
every task adds up residuals and rows by (node, feature, bin), Spark sums these cells, and the
driver, which sees at most leaves x features x bins of them, picks the cuts. Only the smaller child
of a split is summed; its sibling is the parent less it.

Symmetric trees cut all nodes of a level alike, where the summed gain is largest. Leaf-wise trees
are best-first: a node is cut only after its ancestors, so best-first order is by the least gain on
the way to a node; nodes that are not among the ``leaves - 1`` largest so far are never opened.

Residuals are summed as whole units, 2^-20 of the largest distance of a label from the mean, so
trees do not depend on partitions or the order of rows. The sums of a round's first job also give
the validation error of the rounds before it: training ends ``patience`` rounds after the best one.
Every ``every`` rounds margins are written, and trees too where a folder is given; a later call
with this folder goes on from there.

Defined cases: rows without a label are left out; missing and NaN features go left; ties are won by
the feature listed first, then the smaller cut; without validation rows all rounds are kept; a table
without rows gives a model of no trees that predicts 0; text or columns that are no features are
not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waitwright.lineage import cut
from waitwright.operators.quantiles import exact_quantiles

UNITS = 1 << 20
CELLS = "node int, feature int, bin int, total bigint, n bigint"
NODES = ("round int, node int, feature int, cut int, threshold double, left int, right int, "
         "value double, n bigint, error double")


@dataclass(frozen=True)
class Settings:
    # fixed: rate, rounds, patience, leaves and depth of the published boosters
    rounds: int = 500
    rate: float = 0.05
    patience: int = 50
    leaves: int = 64
    depth: int = 10
    bins: int = 64
    min_rows: int = 20
    ridge: float = 0.0
    symmetric: bool = False
    every: int = 10


def leafwise(**options) -> Settings:
    return Settings(**options)


def symmetric(**options) -> Settings:
    return Settings(**({"symmetric": True, "depth": 8, "min_rows": 1, "ridge": 3.0} | options))


@dataclass
class Tree:
    """Node arrays; node 0 is the root. A leaf has feature -1 and is its own child."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    n: list[int] = field(default_factory=lambda: [0])
    depth: int = 0

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        left, right = len(self.feature), len(self.feature) + 1
        self.feature[node], self.cut[node] = feature, at
        self.left[node], self.right[node] = left, right
        for child in (left, right):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(child)
            self.right.append(child)
            self.value.append(0.0)
            self.n.append(0)
        return left, right

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """Leaf that each row of bins falls into."""
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        feature, at = np.maximum(self.feature, 0), np.array(self.cut)
        left, right = np.array(self.left), np.array(self.right)
        for _ in range(self.depth):
            node = np.where(bins[rows, feature[node]] > at[node], right[node], left[node])
        return node


def _margin(start: np.ndarray, bins: np.ndarray, trees: list[Tree]) -> np.ndarray:
    for tree in trees:
        start = start + np.array(tree.value)[tree.leaf(bins)]
    return start


def _binned(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """One byte per feature: 0 for missing, else 1 + number of edges below the value."""
    bins = np.zeros((len(columns[0]) if columns else 0, len(edges)), np.uint8)
    for k, (values, at) in enumerate(zip(columns, edges)):
        bins[:, k] = np.where(np.isnan(values), 0, 1 + np.searchsorted(at, values, "left"))
    return bins


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def _bytes(batch: pa.RecordBatch, width: int) -> np.ndarray:
    packed = b"".join(batch.column("bins").to_pylist())
    return np.frombuffer(packed, np.uint8).reshape(batch.num_rows, width)


def bin_edges(train: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Distinct exact quantiles of each feature, at most ``bins - 2``."""
    probs = [i / (bins - 1) for i in range(1, bins - 1)]
    found: dict[str, set] = {f: set() for f in features}
    for row in exact_quantiles(train, features, probs, method="lower").collect():
        if row["value"] is not None:
            found[row["column"]].add(float(row["value"]))
    return [np.array(sorted(found[f])) for f in features]


def _pack(rows: DataFrame, features: list[str], label: str, edges, base: float) -> DataFrame:
    """bins, y, margin, valid: what training reads."""
    picked = rows.select(F.col(label).cast("double").alias("y"), F.col("_valid").alias("valid"),
                         *(F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)))

    def task(batches):
        for batch in batches:
            bins = _binned([_numbers(batch.column(f"f{i}")) for i in range(len(edges))], edges)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in bins], pa.binary()), batch.column("y"),
                 pa.array(np.full(batch.num_rows, base)), batch.column("valid")],
                names=["bins", "y", "margin", "valid"])

    return picked.mapInArrow(task, "bins binary, y double, margin double, valid boolean")


def _advance(data: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    """The same rows with the margin after ``trees``."""
    def task(batches):
        for batch in batches:
            after = _margin(_numbers(batch.column("margin")), _bytes(batch, width), trees)
            yield pa.RecordBatch.from_arrays(
                [batch.column("bins"), batch.column("y"), pa.array(after), batch.column("valid")],
                names=["bins", "y", "margin", "valid"])

    return data.mapInArrow(task, data.schema)


def _sums(data: DataFrame, trees: list[Tree], tree: Tree, wanted: list[int], width: int, bins: int,
          unit: float, errors: bool) -> tuple[dict[int, np.ndarray], int, int]:
    """Cells of the wanted nodes, [2, feature, bin] each, and squared validation error and rows."""
    slots = np.full(len(tree.feature), -1)
    slots[wanted] = np.arange(len(wanted))

    def task(batches):
        cells = np.zeros((2, len(wanted) * width * bins), np.int64)
        squares, offsets = np.zeros(3, np.int64), np.arange(width) * bins
        for batch in batches:
            packed = _bytes(batch, width)
            rest = _numbers(batch.column("y")) - _margin(
                _numbers(batch.column("margin")), packed, trees)
            units = np.rint(rest / unit).astype(np.int64)
            valid = batch.column("valid").to_numpy(zero_copy_only=False).astype(bool)
            if errors:
                # Squares are summed in two halves, so that no sum leaves 64 bits.
                square = units[valid] ** 2
                squares += [(square >> 24).sum(), (square & 0xFFFFFF).sum(), valid.sum()]
            slot = np.where(valid, -1, slots[tree.leaf(packed)])
            some = slot >= 0
            if some.any():
                cell = (slot[some, None] * (width * bins) + offsets + packed[some]).ravel()
                cells[0] += np.bincount(cell, np.repeat(units[some], width), cells.shape[1]
                                        ).astype(np.int64)
                cells[1] += np.bincount(cell, minlength=cells.shape[1])
        if errors:
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, -1], pa.int32()), pa.array([0, 1], pa.int32()),
                 pa.array([0, 0], pa.int32()), pa.array(squares[:2]),
                 pa.array([squares[2], 0], pa.int64())],
                names=["node", "feature", "bin", "total", "n"])
        at = np.flatnonzero(cells[1])
        for part in np.array_split(at, max(1, len(at) // 65536)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(wanted, np.int32)[part // (width * bins)], pa.int32()),
                 pa.array((part // bins % width).astype(np.int32)),
                 pa.array((part % bins).astype(np.int32)),
                 pa.array(cells[0][part]), pa.array(cells[1][part])],
                names=["node", "feature", "bin", "total", "n"])

    found = data.mapInArrow(task, CELLS).groupBy("node", "feature", "bin").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    node, feature, at, total, n = (found.column(c).to_numpy()
                                   for c in ("node", "feature", "bin", "total", "n"))
    result = {}
    for number in wanted:
        mine = node == number
        result[number] = np.zeros((2, width, bins), np.int64)
        result[number][:, feature[mine], at[mine]] = total[mine], n[mine]
    parts = {int(f): (int(t), int(c)) for f, t, c in zip(feature[node < 0], total[node < 0],
                                                        n[node < 0])}
    high, rows = parts.get(0, (0, 0))
    return result, (high << 24) + parts.get(1, (0, 0))[0], rows


def cut_gains(cells: np.ndarray, settings: Settings) -> np.ndarray:
    """Gain of each (feature, cut) of a node in squared units; -inf where a side is too small."""
    left = np.cumsum(cells, axis=2)
    total, rows = cells[:, 0].sum(axis=1)
    right = np.array([total, rows])[:, None, None] - left
    score = lambda g, n: np.asarray(g, float) ** 2 / np.maximum(
        np.asarray(n, float) + settings.ridge, 1)
    gains = score(*left) + score(*right) - score(total, rows)
    if settings.symmetric:
        return gains
    return np.where((left[1] >= settings.min_rows) & (right[1] >= settings.min_rows), gains, -np.inf)


def _best(gains: np.ndarray) -> tuple[float, int, int]:
    at = int(np.argmax(gains))
    return float(gains.flat[at]), *divmod(at, gains.shape[1])


def _sides(cells: np.ndarray, feature: int, at: int) -> tuple[tuple[int, int], tuple[int, int]]:
    left = cells[:, feature, :at + 1].sum(axis=1)
    return tuple(left), tuple(cells[:, feature].sum(axis=1) - left)


def _children(tree: Tree, opened: list[tuple], level) -> dict[int, np.ndarray]:
    """Cells of both children of each opened (node, cells, left, right, totals)."""
    small = {node: (l if sides[0][1] <= sides[1][1] else r) for node, _, l, r, sides in opened}
    summed = level(tree, sorted(small.values()))
    result = {}
    for node, cells, l, r, _ in opened:
        other = l + r - small[node]
        result[small[node]] = summed[small[node]]
        result[other] = cells - summed[small[node]]
    return result


def _valued(tree: Tree, node: int, side: tuple[int, int], unit: float, settings: Settings) -> None:
    total, rows = side
    tree.n[node] = int(rows)
    tree.value[node] = settings.rate * float(total) * unit / max(float(rows) + settings.ridge, 1.0)


def _grow_symmetric(root: np.ndarray, level, unit: float, settings: Settings) -> Tree:
    tree, cells = Tree(n=[int(root[1, 0].sum())]), {0: root}
    for depth in range(settings.depth):
        gain, feature, at = _best(sum(cut_gains(c, settings) for c in cells.values()))
        if not gain > 0:
            break
        opened = []
        for node, held in cells.items():
            sides = _sides(held, feature, at)
            l, r = tree.split(node, feature, at)
            for child, side in zip((l, r), sides):
                _valued(tree, child, side, unit, settings)
            opened.append((node, held, l, r, sides))
        tree.depth = depth + 1
        if depth + 1 < settings.depth:
            cells = _children(tree, opened, level)
    return tree


def _grow_leafwise(root: np.ndarray, level, unit: float, settings: Settings) -> Tree:
    probe, cells, known = Tree(n=[int(root[1, 0].sum())]), {0: root}, {}    # node: (-least gain on the way, depth, cut)
    least = {0: np.inf}
    for depth in range(settings.depth):
        for node, held in cells.items():
            gain, feature, at = _best(cut_gains(held, settings))
            if gain > 0:
                known[node] = (-min(gain, least[node]), depth, node, feature, at)
        taken = sorted(known.values())[:settings.leaves - 1]
        opened = []
        for bound, _, node, feature, at in sorted(taken, key=lambda k: k[2]):
            if node in cells:
                l, r = probe.split(node, feature, at)
                sides = _sides(cells[node], feature, at)
                for child, side in zip((l, r), sides):
                    least[child] = -bound
                    _valued(probe, child, side, unit, settings)
                opened.append((node, cells[node], l, r, sides))
        if not opened:
            break
        probe.depth = depth + 1
        if depth + 1 < settings.depth:
            cells = _children(probe, opened, level)
    return _pruned(probe, {k[2] for k in sorted(known.values())[:settings.leaves - 1]})


def _pruned(probe: Tree, kept: set[int]) -> Tree:
    """Only the kept cuts: some nodes were opened before larger gains turned up elsewhere."""
    tree, waiting = Tree(), [(0, 0, 0)]
    while waiting:
        old, new, depth = waiting.pop(0)
        tree.value[new], tree.n[new] = probe.value[old], probe.n[old]
        tree.depth = max(tree.depth, depth)
        if old in kept and probe.feature[old] >= 0:
            l, r = tree.split(new, probe.feature[old], probe.cut[old])
            waiting += [(probe.left[old], l, depth + 1), (probe.right[old], r, depth + 1)]
    return tree


@dataclass
class Booster:
    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]
    errors: list[float]     # validation RMSE with 0, 1, 2, ... trees, also those after the best

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """Adds the prediction; the model travels with the tasks."""
        edges, trees, base = self.edges, self.trees, self.base

        @F.pandas_udf("double")
        def predict(*columns: pd.Series) -> pd.Series:
            values = [c.to_numpy(dtype=float, na_value=np.nan) for c in columns]
            return pd.Series(_margin(np.full(len(values[0]), base), _binned(values, edges), trees))

        return df.withColumn(prediction, predict(*(F.col(f).cast("double") for f in self.features)))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """All nodes: round, node, feature (position), threshold (up to it: left), children, value."""
        return _node_table(spark, self.trees, 0, self.errors, self.edges)


def _node_table(spark, trees: list[Tree], first: int, errors: list[float], edges) -> DataFrame:
    rows = []
    for number, tree in enumerate(trees, first):
        error = float(errors[number + 1]) if number + 1 < len(errors) else None
        for node, feature in enumerate(tree.feature):
            at = tree.cut[node]
            threshold = float(edges[feature][at - 1]) if feature >= 0 and at > 0 else None
            rows.append((number, node, feature, at, threshold, tree.left[node], tree.right[node],
                         tree.value[node], tree.n[node], error))
    return spark.createDataFrame(rows, NODES)


def _saved(spark: SparkSession, folder: str) -> tuple[list[Tree], list[float]]:
    """Trees and validation errors that an earlier run left in ``folder``."""
    rows = spark.read.schema(NODES).parquet(f"{folder}/rounds").orderBy("round", "node").collect()
    trees, errors = [], []
    for row in rows:
        if row["node"] == 0:
            trees.append(Tree([], [], [], [], [], []))
            errors.append(row["error"])
        tree = trees[row["round"]]
        for name in ("feature", "cut", "left", "right", "value", "n"):
            getattr(tree, name).append(row[name])
    for tree in trees:
        depths = {0: 0}
        for node, feature in enumerate(tree.feature):
            if feature >= 0:
                depths[tree.left[node]] = depths[tree.right[node]] = depths[node] + 1
        tree.depth = max(depths.values())
    return trees, errors


def fit(train: DataFrame, features: list[str], label: str, validation: DataFrame | None = None,
        settings: Settings = Settings(), folder: str | None = None) -> Booster:
    """Boost on ``train``; keep the rounds up to the best one on ``validation``.

    ``folder``: shared folder for finished rounds; a call with the same rows and settings resumes.
    """
    spark, width = train.sparkSession, len(features)
    pick = lambda df, valid: df.where(F.col(label).isNotNull()).select(
        *dict.fromkeys([*features, label]), F.lit(valid).alias("_valid"))
    mine = pick(train, False)
    rows = mine if validation is None else mine.unionByName(pick(validation, True))
    y = F.col(label).cast("double")
    facts = mine.agg(F.round(F.avg(y), 6).alias("mean"), F.min(y).alias("lo"), F.max(y).alias("hi"),
                     F.count("*").alias("n")).first()
    if not facts["n"]:
        return Booster(features, [np.zeros(0) for _ in features], 0.0, [], [])
    base, edges = float(facts["mean"]), bin_edges(mine, features, settings.bins)
    unit = (max(facts["hi"] - base, base - facts["lo"]) or 1.0) / UNITS
    data = cut(_pack(rows, features, label, edges, base))
    trees, errors, pending, written = [], [], [], 0
    if folder is not None:
        spark.createDataFrame([], NODES).write.mode("append").parquet(f"{folder}/rounds")
        trees, errors = _saved(spark, folder)
        pending, written = list(trees), len(trees)
    level = lambda tree, wanted: _sums(data, pending, tree, wanted, width, settings.bins, unit,
                                       False)[0]
    grow = _grow_symmetric if settings.symmetric else _grow_leafwise
    errors = [float("inf"), *errors[:-1]] if trees else []
    while True:
        done = len(trees)
        root, squares, held = _sums(data, pending, Tree(), [0], width, settings.bins, unit, True)
        errors.append((squares / held) ** 0.5 * unit if held else float("nan"))
        best = done if not held else min(range(min(1, done), done + 1), key=lambda k: errors[k])
        over = done >= settings.rounds or (held and done - best >= settings.patience)
        if done - written >= settings.every or over:
            if folder is not None and done > written:
                _node_table(spark, trees[written:], written, errors, edges).coalesce(1).write.mode(
                    "append").parquet(f"{folder}/rounds")
            written = done
        if over:
            break
        if len(pending) >= settings.every:
            data, pending = cut(_advance(data, pending, width)), []
        tree = grow(root[0], level, unit, settings)
        if not tree.depth:
            break
        trees.append(tree)
        pending.append(tree)
    return Booster(features, edges, base, trees[:best], errors)
