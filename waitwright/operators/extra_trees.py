"""Extremely randomised trees: random features and random cut points, no bootstrap.

All trees grow together, level by level, in two jobs over the rows: one finds the range of every
feature in every open node, one adds up rows and labels left of the drawn cuts. A node draws its
features and cuts by hashing seed, tree, node and feature, and labels are summed as whole units, so
a forest is the same for any partitioning and order of rows. Tasks and driver hold trees x open
nodes x features numbers, whatever the table's size.

Defined cases: rows without a label are left out; missing and NaN features go left and have no part
in ranges; a node with no feature of two values, fewer than twice ``min_rows`` rows or no gain is a
leaf; ties are won by the feature listed first; a table without rows gives a forest that predicts 0.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitwright.lineage import cut
from waitwright.operators.boost import UNITS, Tree


@dataclass(frozen=True)
class Settings:
    trees: int = 20
    depth: int = 8
    min_rows: int = 5
    #: features drawn per node; None: all that have a range
    drawn: int | None = None
    seed: int = 42


def share(seed: int, tree: int, node: int, feature: int, use: str) -> float:
    """A number in (0, 1) for a draw."""
    name = f"{seed}:{tree}:{node}:{feature}:{use}".encode()
    number = int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "big")
    return ((number >> 11) + 0.5) / (1 << 53)


def draws(settings: Settings, tree: int, node: int, low: np.ndarray, high: np.ndarray
          ) -> list[tuple[int, float]]:
    """(feature, cut) of a node whose features have these ranges, in feature order."""
    usable = [f for f in range(len(low)) if low[f] < high[f]]
    usable.sort(key=lambda f: share(settings.seed, tree, node, f, "feature"))
    point = lambda f: float(low[f]) + (float(high[f]) - float(low[f])) * share(
        settings.seed, tree, node, f, "cut")
    # Rounding may reach the upper end, where nothing would be right of the cut.
    return [(f, min(point(f), float(np.nextafter(high[f], low[f]))))
            for f in sorted(usable[:settings.drawn])]


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    columns = [batch.column(f"f{i}").to_numpy(zero_copy_only=False).astype(float)
               for i in range(width)]
    return np.column_stack(columns) if columns else np.zeros((batch.num_rows, 0))


def _places(trees: list[Tree], open_nodes: list[tuple[int, int]]) -> dict[int, np.ndarray]:
    """Slot of each node of each tree that has open ones, -1 for the rest."""
    places: dict[int, np.ndarray] = {}
    for slot, (tree, node) in enumerate(open_nodes):
        places.setdefault(tree, np.full(len(trees[tree].feature), -1))[node] = slot
    return places


def _ranges(data: DataFrame, trees: list[Tree], open_nodes, width: int):
    """Lowest and highest value of each feature in each open node; NaN where it has none."""
    places = _places(trees, open_nodes)

    def task(batches):
        low = np.full((len(open_nodes), width), np.inf)
        high = -low
        for batch in batches:
            x = _matrix(batch, width)
            least, most = np.where(np.isnan(x), np.inf, x), np.where(np.isnan(x), -np.inf, x)
            for tree, slots in places.items():
                slot = slots[trees[tree].leaf(x)]
                order = np.argsort(slot, kind="stable")
                order = order[slot[order] >= 0]
                if len(order):
                    held, first = np.unique(slot[order], return_index=True)
                    low[held] = np.minimum(low[held], np.minimum.reduceat(least[order], first))
                    high[held] = np.maximum(high[held], np.maximum.reduceat(most[order], first))
        at = np.flatnonzero(low <= high)
        for part in np.array_split(at, max(1, len(at) // 65536)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(low.flat[part]), pa.array(high.flat[part])],
                names=["cell", "low", "high"])

    found = data.mapInArrow(task, "cell bigint, low double, high double").groupBy("cell").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    low = np.full(len(open_nodes) * width, np.nan)
    high, cells = low.copy(), found.column("cell").to_numpy()
    low[cells], high[cells] = found.column("low").to_numpy(), found.column("high").to_numpy()
    return low.reshape(-1, width), high.reshape(-1, width)


def _left_sums(data: DataFrame, trees: list[Tree], open_nodes, cuts, width: int, base: float,
               unit: float) -> np.ndarray:
    """[2, node, draw]: label units and rows left of each drawn cut; the last draw takes all."""
    places, most = _places(trees, open_nodes), max(map(len, cuts)) + 1
    feature, at = np.zeros((len(cuts), most), int), np.full((len(cuts), most), np.inf)
    for slot, drawn in enumerate(cuts):
        for k, (f, point) in enumerate(drawn):
            feature[slot, k], at[slot, k] = f, point

    def task(batches):
        sums = np.zeros((2, len(cuts) * most), np.int64)
        for batch in batches:
            x = _matrix(batch, width)
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            units = np.rint((y - base) / unit)
            for tree, slots in places.items():
                slot = slots[trees[tree].leaf(x)]
                rows = np.flatnonzero(slot >= 0)
                mine = slot[rows]
                for k in range(most):
                    left = ~(x[rows, feature[mine, k]] > at[mine, k]) if width else mine >= 0
                    cell = mine[left] * most + k
                    sums[0] += np.bincount(cell, units[rows[left]], sums.shape[1]).astype(np.int64)
                    sums[1] += np.bincount(cell, minlength=sums.shape[1])
        some = np.flatnonzero(sums[1])
        for part in np.array_split(some, max(1, len(some) // 65536)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(sums[0][part]), pa.array(sums[1][part])],
                names=["cell", "total", "n"])

    found = data.mapInArrow(task, "cell bigint, total bigint, n bigint").groupBy("cell").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    sums, cells = np.zeros((2, len(cuts) * most), np.int64), found.column("cell").to_numpy()
    sums[0, cells], sums[1, cells] = found.column("total").to_numpy(), found.column("n").to_numpy()
    return sums.reshape(2, len(cuts), most)


def best_draw(left: np.ndarray, whole: np.ndarray, min_rows: int) -> int | None:
    """The draw with the largest gain, from (units, rows) left of each cut and of the node."""
    right = whole[:, None] - left
    fits = (left[1] >= min_rows) & (right[1] >= min_rows)
    score = lambda s: s[0].astype(float) ** 2 / np.maximum(s[1], 1)
    gains = np.where(fits, score(left) + score(right) - score(whole), 0.0)
    return int(np.argmax(gains)) if len(gains) and gains.max() > 0 else None


@dataclass
class Forest:
    features: list[str]
    base: float
    trees: list[Tree]

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """Adds the mean of the trees."""
        trees, base = self.trees, self.base

        @F.pandas_udf("double")
        def predict(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])
            total = sum((np.array(t.value)[t.leaf(x)] for t in trees), np.zeros(len(x)))
            return pd.Series(base + total / max(len(trees), 1))

        return df.withColumn(prediction, predict(*(F.col(f).cast("double") for f in self.features)))


def fit(rows: DataFrame, features: list[str], label: str,
        settings: Settings = Settings()) -> Forest:
    """Grow a forest; two jobs per level, whatever the number of trees."""
    width, y = len(features), F.col(label).cast("double")
    data = cut(rows.where(F.col(label).isNotNull()).select(
        y.alias("y"), *(F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features))))
    facts = data.agg(F.round(F.avg("y"), 6).alias("mean"), F.min("y").alias("lo"),
                     F.max("y").alias("hi"), F.count("*").alias("n")).first()
    if not facts["n"]:
        return Forest(features, 0.0, [])
    base = float(facts["mean"])
    unit = (max(facts["hi"] - base, base - facts["lo"]) or 1.0) / UNITS
    trees = [Tree(n=[facts["n"]]) for _ in range(settings.trees)]
    open_nodes = [(t, 0) for t in range(settings.trees)]
    for depth in range(settings.depth):
        open_nodes = [(t, k) for t, k in open_nodes if trees[t].n[k] >= 2 * settings.min_rows]
        if not open_nodes:
            break
        low, high = _ranges(data, trees, open_nodes, width)
        cuts = [draws(settings, t, k, low[s], high[s]) for s, (t, k) in enumerate(open_nodes)]
        sums = _left_sums(data, trees, open_nodes, cuts, width, base, unit)
        opened = []
        for slot, (t, node) in enumerate(open_nodes):
            left, whole = sums[:, slot, :len(cuts[slot])], sums[:, slot, -1]
            best = best_draw(left, whole, settings.min_rows)
            if best is None:
                continue
            children = trees[t].split(node, *cuts[slot][best])
            trees[t].depth = depth + 1
            for child, side in zip(children, (left[:, best], whole - left[:, best])):
                trees[t].n[child] = int(side[1])
                trees[t].value[child] = float(side[0]) * unit / float(side[1])
                opened.append((t, child))
        open_nodes = opened
    return Forest(features, base, trees)
