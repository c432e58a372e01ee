"""Training run: prepare, compare candidates, allocate, summarise."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.ml.base import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitwright.functions.rules import recommendation_alerts
from waitwright.lineage import cut
from waitwright.operators.allocate import recommend
from waitwright.operators.model import (
    Comparison, boosted_leafwise, boosted_symmetric, train_and_compare,
)
from waitwright.operators.split import split_by_hash
from waitwright.plans.preprocess import Prepared, preprocess
from waitwright.settings import TARGET, VISIT_ID


def default_candidates(rounds: int = 500) -> dict[str, Estimator]:
    return {"leafwise": boosted_leafwise(rounds=rounds),
            "symmetric": boosted_symmetric(rounds=rounds)}


@dataclass
class Run:
    prepared: Prepared
    comparison: Comparison
    recommendations: DataFrame
    alerts: DataFrame
    summary: dict


def train(visits: DataFrame, staffing: DataFrame, as_of: datetime,
          candidates: dict[str, Estimator] | None = None) -> Run:
    """``staffing`` holds ``snapshot, department, predicted_wait, current_counters``.

    The best model stays in the result, so that it can be saved and used.
    """
    prepared = preprocess(visits, as_of)
    matrix = cut(split_by_hash(prepared.matrix, VISIT_ID))
    comparison = train_and_compare(matrix, prepared.features, candidates or default_candidates())
    recommendations = recommend(staffing)
    alerts = recommendation_alerts(recommendations)
    span = matrix.agg(F.count("*").alias("n"), F.min(TARGET).alias("low"),
                      F.max(TARGET).alias("high")).first()
    best = comparison.metrics.first()
    summary = {
        "status": "SUCCESS",
        "data": {"samples": span["n"], "features": len(prepared.features),
                 "target_range": [span["low"], span["high"]]},
        "model": {"name": best["model"], "rmse": best["rmse"], "mae": best["mae"],
                  "r2_score": best["r2"]},
        "allocation": {"recommendations_generated": recommendations.count(),
                       "alerts_generated": alerts.count()},
    }
    return Run(prepared, comparison, recommendations, alerts, summary)
