"""Scoring: newest readings per department and tables of requests."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitwright.functions import arithmetic as af
from waitwright.functions import rules
from waitwright.functions.rounding import round_scaled
from waitwright.operators.encode import apply_encoder, text_columns
from waitwright.operators.lags import latest_per
from waitwright.operators.scale import Scaler, apply_scaler


def department_features(feed: DataFrame, encoder: DataFrame | None = None,
                        tie: str | None = None) -> DataFrame:
    """Model inputs of the newest reading of each department."""
    features = af.with_reading_features(latest_per(feed, tie=tie))
    if encoder is None:
        return features.withColumn("department_enc", F.lit(0))
    return apply_encoder(features, encoder, ["department"], unseen=0)


def predict_departments(feed: DataFrame, model: PipelineModel | None = None,
                        features: list[str] | None = None, encoder: DataFrame | None = None,
                        tie: str | None = None) -> DataFrame:
    """Predicted wait per department with its interval.

    Without a model the queue-per-counter estimate is used, and the observed wait where that
    is undefined.
    """
    inputs = department_features(feed, encoder, tie)
    if model is None:
        predicted = inputs.withColumn("prediction", rules.queueing_estimate(
            F.col(af.QUEUE), F.col(af.COUNTERS)))
    else:
        needed = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                  if c in inputs.columns else F.lit(0.0).alias(c) for c in features]
        predicted = model.transform(inputs.select("department", "wait_time", *needed))
    bands = rules.normal_interval(F.col("prediction"))
    scored = predicted.withColumns(bands)
    return scored.select(
        "department", F.coalesce("prediction", F.col("wait_time").cast("double")).alias("prediction"),
        "confidence_lower", "confidence_upper", "std_error")


FORMS = {"command": af.with_command_features, "service": af.with_request_features}


def score_requests(requests: DataFrame, model: PipelineModel, features: list[str],
                   scaler: Scaler | None = None, keep: tuple[str, ...] = (), *,
                   form: str = "command", encoder: DataFrame | None = None) -> DataFrame:
    """Predicted wait and interval for every valid request, any number of rows.

    ``form`` says which derived inputs the model was trained on: ``command`` or ``service``. Text
    features are coded with the fitted encoder, unknown values as its first class. Invalid requests
    keep their row with null results and the list of violations.
    """
    checked = af.with_request_check(requests)
    derived = FORMS[form](checked)
    kept = {c: f"_kept_{c}" for c in (*keep, "department", "violations")}
    derived = derived.withColumns({new: F.col(c) for c, new in kept.items()})
    texts = [c for c in text_columns(derived) if c in features]
    if texts:
        if encoder is None:
            raise ValueError(f"text features need the fitted encoder: {texts}")
        derived = apply_encoder(derived, encoder, texts, unseen=0, suffix="")
    ready = af.aligned(derived, features, tuple(kept.values()))
    ready = ready.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                               for c in features})
    if scaler is not None:
        ready = apply_scaler(ready, scaler)
    return scored_requests(model.transform(ready), keep)


def scored_requests(scored: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Clamped prediction and interval of rows with ``prediction`` and ``_kept_`` columns."""
    valid = F.size("_kept_violations") == 0
    clamped = rules.non_negative(F.col("prediction"))
    band = rules.relative_interval(clamped, digits=2)
    return scored.select(
        *(F.col(f"_kept_{c}").alias(c) for c in (*keep, "department", "violations")),
        F.when(valid, round_scaled(clamped, 2)).alias("predicted_wait_time"),
        F.when(valid, band["lower"]).alias("confidence_lower"),
        F.when(valid, band["upper"]).alias("confidence_upper"))
