"""Logistic regression on present-or-absent features, for a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 3


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt; a null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS == 1


def labelled_sample(labels: DataFrame, label: str, most: int, key: str = "doc_id") -> DataFrame:
    """At most ``most`` learnable rows (id, label), the same ones in every run.

    Rows without an id or a label are left out; an id labelled twice counts as its larger label.
    """
    usable = (labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()
                            & ~held_out(F.col(key)))
              .groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("label")))
    return usable.orderBy(F.xxhash64("id"), "id").limit(most)


def fit(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, width: int,
        pairs: np.ndarray | None = None, ridge: float = 1.0, steps: int = 1000
        ) -> tuple[np.ndarray, float]:
    """Weights and intercept of entries (row, column) = 1.

    Minimises log loss + ridge * |w|^2 / 2 + |pairs @ w|^2 / 2 by Nesterov steps that are scaled by
    each feature's frequency.
    """
    n = len(labels)
    if not n or not labels.any() or labels.all():
        share = (labels.sum() + 0.5) / (n + 1.0)
        return np.zeros(width), float(np.log(share / (1 - share)))
    per_row = np.bincount(rows, minlength=n) + 1.0
    # A bound on the curvature of each coordinate: features of a row move together.
    curve = np.bincount(columns, per_row[rows] / 4, width) + ridge
    curve_b = float(per_row.sum() / 4)
    if pairs is not None:
        curve += np.abs(pairs.T) @ np.abs(pairs).sum(1)
    w, b = np.zeros(width), float(np.log(labels.mean() / (1 - labels.mean())))
    look_w, look_b, momentum = w, b, 1.0
    for _ in range(steps):
        margin = np.bincount(rows, look_w[columns], n) + look_b
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels
        slope = np.bincount(columns, error[rows], width) + ridge * look_w
        if pairs is not None:
            slope += pairs.T @ (pairs @ look_w)
        new_w, new_b = look_w - slope / curve, look_b - error.sum() / curve_b
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        pull = (momentum - 1) / following
        look_w, look_b = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        w, b, momentum = new_w, new_b, following
    return w, b


def probability(rows: np.ndarray, columns: np.ndarray, count: int, weights: np.ndarray,
                intercept: float) -> np.ndarray:
    margin = np.bincount(rows, weights[columns], count) + intercept
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
