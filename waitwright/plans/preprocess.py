"""End-to-end preparation of visit tables for training."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from waitwright.functions.arithmetic import (
    aligned, present, with_interactions, with_one_hot, with_optional_interactions, with_transforms,
    with_utilization_bands,
)
from waitwright.functions.calendar import with_calendar, with_calendar_flags, with_cyclical
from waitwright.lineage import cut
from waitwright.operators.clean import (
    Bounds, FillValues, StepStats, drop_missing_target, filter_deviation, fit_quantile_range,
    impute, nan_to_null, quality_report, remove_duplicates, within,
)
from waitwright.operators.encode import (
    apply_encoder, encode_categories, encode_in_place, fit_encoder, text_columns,
)
from waitwright.operators.lags import with_history, with_history_stats
from waitwright.operators.ordering import Arranged, arrange
from waitwright.operators.scale import (
    FlagLimits, Scaler, apply_flags, apply_scaler, fit_flags, fit_scaler,
)
from waitwright.operators.split import split_in_two_steps
from waitwright.settings import (
    ARRIVAL, CATEGORICAL_COLUMNS, FEATURES, LAGS, TARGET, VISIT_ID, WINDOWS, Z_LIMIT,
)
from waitwright.sources.tables import (
    load_encoder, load_state, require_schema, save_encoder, save_state,
)

DEPARTMENT_VECTOR = "dept_vector"


@dataclass
class Prepared:
    """Feature matrix with everything fitted on the way."""

    matrix: DataFrame
    features: list[str]
    encoder: DataFrame
    fill: FillValues
    bounds: list[Bounds]
    quality: DataFrame
    stats: StepStats


def time_order(df: DataFrame, ts: str = ARRIVAL) -> tuple[str, ...]:
    """Arrival time, then whatever makes the order total."""
    if VISIT_ID in df.columns:
        return (ts, VISIT_ID)
    return (ts, *[c for c in df.columns if c != ts])


def clean(df: DataFrame) -> tuple[Arranged, FillValues, list[Bounds], StepStats]:
    """Deduplicate, impute, drop extreme waits and number the rows by arrival.

    Two tables are written: the distinct rows, which all fits scan, and the ordered rows.
    """
    require_schema(df)
    stats, seen = StepStats(), Observation()
    source = nan_to_null(df).observe(seen, F.count("*").alias("rows"))
    distinct = cut(remove_duplicates(source))
    rows = distinct.count()
    stats.put("original_size", seen.get["rows"])
    stats.put("duplicates_removed", seen.get["rows"] - rows)
    filled, fill = impute(distinct, time_order(distinct))
    stats.put("missing_values_filled", fill.filled)
    bounds = fit_quantile_range(filled, [TARGET])
    kept = within(filled, bounds)
    arranged = arrange(kept, time_order(kept))
    stats.put(f"{TARGET}_outliers_removed", rows - arranged.rows)
    stats.put("final_size", arranged.rows)
    stats.put("removed_records", seen.get["rows"] - arranged.rows)
    return arranged, fill, bounds, stats


def engineer(arranged: Arranged, encoder: DataFrame | None = None, *,
             decimals: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All features of cleaned rows in one lazy plan; the encoder is fitted when not given."""
    # Calendar parts come after the block shuffle, which then carries fewer columns.
    df = with_calendar(with_history(arranged, decimals=decimals).df)
    df = with_transforms(with_interactions(with_cyclical(df)))
    if encoder is None:
        known = with_calendar(arranged.df)
        encoder = fit_encoder(known, [c for c in CATEGORICAL_COLUMNS if c in known.columns])
    return encode_categories(df, encoder)


def preprocess(df: DataFrame, as_of: datetime, encoder: DataFrame | None = None, *,
               decimals: int | None = None) -> Prepared:
    """Visits to feature matrix plus target, in the fixed step order."""
    arranged, fill, bounds, stats = clean(df)
    quality = quality_report(arranged.df.drop("ord"), as_of)
    engineered, encoder = engineer(arranged, encoder, decimals=decimals)
    keep = tuple(c for c in (VISIT_ID, TARGET) if c in engineered.columns)
    features = [c for c in FEATURES if c in engineered.columns]
    stats.put("num_features", len(features))
    return Prepared(present(engineered, FEATURES, keep), features, encoder, fill, bounds, quality,
                    stats)


@dataclass
class PreparedSplits:
    """Second feature set, scaled with the moments of its training rows."""

    rows: DataFrame | None
    features: list[str]
    encoder: DataFrame
    flags: FlagLimits
    scaler: Scaler
    one_hot: OneHot | None = None
    interactions: bool = True


def save_prepared(spark: SparkSession, path: str, fitted: PreparedSplits) -> None:
    """All that ``apply_prepared`` needs, in one folder; the training rows are not part of it."""
    one_hot = fitted.one_hot
    save_encoder(fitted.encoder, f"{path}/encoder")
    save_state(spark, f"{path}/state", features={"names": fitted.features},
               scaler=fitted.scaler.moments, flags=fitted.flags.limits,
               layout={"interactions": fitted.interactions, "one_hot": one_hot is not None,
                       "departments": one_hot.values if one_hot else [],
                       "vector": bool(one_hot and one_hot.vector)})
    if one_hot and one_hot.vector:
        one_hot.vector.write().overwrite().save(f"{path}/one_hot")
        save_encoder(one_hot.codes, f"{path}/one_hot_codes")


def load_prepared(spark: SparkSession, path: str) -> PreparedSplits:
    """Fitted state without rows."""
    state = load_state(spark, f"{path}/state")
    layout = state["layout"]
    one_hot = OneHot(layout["departments"]) if layout["one_hot"] else None
    if layout["vector"]:
        one_hot = OneHot([], load_encoder(spark, f"{path}/one_hot_codes"),
                         OneHotEncoderModel.load(f"{path}/one_hot"))
    scaler = Scaler({name: tuple(pair) for name, pair in state["scaler"].items()})
    return PreparedSplits(None, state["features"]["names"], load_encoder(spark, f"{path}/encoder"),
                          FlagLimits(state["flags"]), scaler, one_hot, layout["interactions"])


@dataclass
class OneHot:
    """Departments as boolean columns, or as one sparse vector if the caller asks for it."""

    values: list[str]
    codes: DataFrame | None = None
    vector: OneHotEncoderModel | None = None

    @property
    def vectors(self) -> list[str]:
        return [DEPARTMENT_VECTOR] if self.vector else []

    def apply(self, df: DataFrame) -> DataFrame:
        if self.vector is None:
            return with_one_hot(df, "department", self.values, "dept")
        unknown = self.vector.categorySizes[0]
        coded = apply_encoder(df, self.codes, ["department"], unseen=unknown, suffix="_code")
        return self.vector.transform(coded).drop("department_code")


def fit_one_hot(df: DataFrame, as_vector: bool = False) -> OneHot:
    """One form whatever the number of departments; a null or unknown one is in none of them.

    A plan holds a column per department at most in the low thousands; beyond, ask for the vector.
    """
    known = cut(df.select("department").where("department is not null").distinct())
    if not as_vector:
        return OneHot([row["department"] for row in known.orderBy("department").collect()])
    codes = fit_encoder(known, ["department"])
    encoder = OneHotEncoder(inputCol="department_code", outputCol=DEPARTMENT_VECTOR,
                            handleInvalid="keep")
    return OneHot([], codes, encoder.fit(codes.select(F.col("code").alias("department_code"))))


def prepare_splits(df: DataFrame, target: str = "wait_time_minutes", *, key: str = VISIT_ID,
                   lags: tuple[int, ...] = LAGS, windows: tuple[int, ...] = WINDOWS,
                   interactions: bool = True, department_vector: bool = False,
                   z_limit: float | None = Z_LIMIT,
                   test_size: float = 0.15, val_size: float = 0.15,
                   decimals: int | None = None) -> PreparedSplits:
    """Features, codes, outlier filter, split and scaling of the second layout."""
    df = drop_missing_target(nan_to_null(df), target)
    hot = interactions and "department" in df.columns
    one_hot = fit_one_hot(df, department_vector) if hot else None
    df = with_calendar_flags(df)
    if "timestamp" in df.columns:
        ordered = arrange(df, time_order(df, "timestamp"))
        df = with_history_stats(ordered, target, lags=lags, windows=windows,
                                decimals=decimals).df.drop("ord")
    df = with_optional_interactions(df, interactions)
    if one_hot is not None:
        df = one_hot.apply(df)
    if "queue_length_at_arrival" in df.columns:
        df = df.withColumn("log_queue", F.log1p(F.col("queue_length_at_arrival").cast("double")))
    flags = fit_flags(df)
    df = apply_flags(df, flags)
    if "system_utilization" in df.columns:
        df = with_utilization_bands(df)
    df, encoder = encode_in_place(df)
    if z_limit is not None:
        df = filter_deviation(df, target, z_limit)
    df = cut(split_in_two_steps(df, key, test_size, val_size))
    skip = {target, "timestamp", key, "split"}
    features = [c for c in df.columns if c not in skip]
    scalars = [c for c in features if one_hot is None or c not in one_hot.vectors]
    numeric = df.withColumns({c: F.col(c).cast("double") for c in scalars})
    scaler = fit_scaler(numeric.where("split = 'train'"), scalars)
    return PreparedSplits(apply_scaler(numeric, scaler).drop("timestamp"), features, encoder,
                          flags, scaler, one_hot, interactions)


def apply_prepared(rows: DataFrame, fitted: PreparedSplits, keep: tuple[str, ...] = ()
                   ) -> DataFrame:
    """``keep`` and the fitted features of new rows, encoded, flagged and scaled as in training.

    Rows have a ``timestamp`` or the parts ``hour``, ``day_of_week``, ``month``. A feature that
    they cannot give is 0 before scaling, as is a null; unknown texts take the first class.
    """
    df = with_calendar_flags(rows)
    if "timestamp" not in df.columns and "day_of_week" in df.columns:
        df = df.withColumn("is_weekend", (F.col("day_of_week") >= 5).cast("int"))
    df = with_optional_interactions(df, fitted.interactions)
    if fitted.one_hot is not None and "department" in df.columns:
        df = fitted.one_hot.apply(df)
    if "queue_length_at_arrival" in df.columns:
        df = df.withColumn("log_queue", F.log1p(F.col("queue_length_at_arrival").cast("double")))
    df = apply_flags(df, fitted.flags)
    if "system_utilization" in df.columns:
        df = with_utilization_bands(df)
    texts = [c for c in text_columns(df) if c in fitted.features]
    kept = {c: F.col(c).alias(f"_kept_{c}") for c in keep}
    df = apply_encoder(df.select("*", *kept.values()), fitted.encoder, texts, unseen=0, suffix="")
    df = aligned(df, fitted.features, tuple(f"_kept_{c}" for c in keep))
    scalars = [c for c in fitted.features if c in fitted.scaler.moments]
    df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in scalars})
    return apply_scaler(df, fitted.scaler)
