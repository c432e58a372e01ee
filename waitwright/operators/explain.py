"""Contributions of features to each prediction of a booster (Shapley values of its trees).

A leaf is reached by conditions on a few features. Where a feature is unknown, a row follows both
sides of a cut in the shares of the training rows there, so each feature of a path has two factors:
1 or 0 for a row that meets its conditions or not, and the product of its shares. The weighted sum
over all coalitions is a polynomial in these factors. Rows of a batch with the same pattern of met
conditions have the same contributions from a leaf, which are computed once per pattern.

Contributions of a row add up to its prediction less ``base_value``. Features that a row's trees do
not use have 0. A missing value goes where the booster sends it. A booster of no trees gives zeros.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitwright.operators.boost import Booster, Tree, _binned


@dataclass(frozen=True)
class Path:
    """Conditions ``low < bin <= high`` of a leaf's features and their shares of training rows."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shares: np.ndarray
    value: float
    weight: float


def paths(tree: Tree) -> list[Path]:
    """All leaves of a tree that are not 0; those without training rows have value 0."""
    found, waiting = [], [(0, {})]
    while waiting:
        node, held = waiting.pop()
        feature = tree.feature[node]
        if feature < 0:
            if tree.value[node]:
                low, high, shares = (np.array(c) for c in zip(*held.values())) if held else (
                    np.zeros(0), np.zeros(0), np.zeros(0))
                found.append(Path(np.array(list(held), int), low, high, shares, tree.value[node],
                                  float(np.prod(shares))))
            continue
        low, high, share = held.get(feature, (-1, 1 << 30, 1.0))
        at, total = tree.cut[node], tree.n[node]
        for child, span in ((tree.left[node], (low, min(high, at))),
                            (tree.right[node], (max(low, at), high))):
            part = share * tree.n[child] / total if total else 0.0
            waiting.append((child, held | {feature: (*span, part)}))
    return found


def coalition_values(met: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Contribution of each feature of a path with value 1, for each pattern of met conditions."""
    patterns, size = met.shape
    # Coefficient k: all coalitions of k others; position i leaves feature i out.
    counts = np.zeros((patterns, size, size + 1))
    counts[:, :, 0] = 1.0
    for j in range(size):
        grown = counts * shares[j]
        grown[:, :, 1:] += counts[:, :, :-1] * met[:, j, None, None]
        grown[:, j] = counts[:, j]
        counts = grown
    weights = np.array([factorial(k) * factorial(size - 1 - k) / factorial(size)
                        for k in range(size)])
    return (met - shares) * (counts[:, :, :size] @ weights)


def _contributions(bins: np.ndarray, leaves: list[Path]) -> np.ndarray:
    result = np.zeros(bins.shape)
    for leaf in leaves:
        size = len(leaf.features)
        if not size or not len(bins):
            continue
        mine = bins[:, leaf.features]
        met = (mine > leaf.low) & (mine <= leaf.high)
        packed = np.packbits(met, axis=1, bitorder="little")
        code = packed.astype(np.int64) @ (1 << 8 * np.arange(packed.shape[1], dtype=np.int64))
        _, first, pattern = np.unique(code, return_index=True, return_inverse=True)
        values = coalition_values(met[first].astype(float), leaf.shares)
        result[:, leaf.features] += leaf.value * values[pattern.ravel()]
    return result


def base_value(fitted: Booster) -> float:
    """Mean prediction of the training rows, where every feature is unknown."""
    return fitted.base + sum(leaf.value * leaf.weight for tree in fitted.trees
                             for leaf in paths(tree))


def contributions(rows: DataFrame, fitted: Booster, keep: tuple[str, ...]) -> DataFrame:
    """(keep, feature, value, contribution): one row per row and feature, in feature order."""
    edges, leaves = fitted.edges, [leaf for tree in fitted.trees for leaf in paths(tree)]

    @F.pandas_udf("array<double>")
    def explained(*columns: pd.Series) -> pd.Series:
        values = [c.to_numpy(dtype=float, na_value=np.nan) for c in columns]
        return pd.Series(list(_contributions(_binned(values, edges).astype(np.int32), leaves)))

    inputs = [F.col(f).cast("double") for f in fitted.features]
    parts = F.arrays_zip(F.array(*(F.lit(f) for f in fitted.features)).alias("feature"),
                         F.array(*inputs).alias("value"), F.col("_parts").alias("contribution"))
    return rows.withColumn("_parts", explained(*inputs)).select(
        *keep, F.inline(parts).alias("feature", "value", "contribution"))


def mean_contributions(explained: DataFrame) -> DataFrame:
    """Mean size of the contributions of each feature: an importance that rows can be traced to."""
    return explained.groupBy("feature").agg(
        F.count("*").alias("rows"), F.avg(F.abs("contribution")).alias("importance"))
