"""Ordinal encoders kept as ``(column, value, code)`` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waitwright.lineage import cut, is_small
from waitwright.operators.ordering import arrange
from waitwright.settings import CATEGORICAL_COLUMNS
from waitwright.skew import join_unique

SMALL_DOMAIN = 100_000
MISSING_TEXT = "nan"


def _text(column: Column) -> Column:
    """Encoders work on text; a missing value is a class of its own."""
    return F.coalesce(column.cast("string"), F.lit(MISSING_TEXT))


def _distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _text(F.col(c)).alias("value")) for c in columns]))
    return df.select(pairs.alias("pair")).select("pair.*").distinct()


def fit_encoder(df: DataFrame, columns: list[str]) -> DataFrame:
    """Code of each value is its rank among the column's values in ascending text order."""
    values = cut(_distinct_values(df, columns))
    largest = values.groupBy("column").count().agg(F.max("count")).first()[0] or 0
    if largest <= SMALL_DOMAIN:
        ordered = Window.partitionBy("column").orderBy("value")
        return values.withColumn("code", F.row_number().over(ordered) - 1)
    placed = arrange(values, ("column", "value")).df
    starts = placed.groupBy("column").agg(F.min("ord").alias("_start"))
    return (placed.join(F.broadcast(starts), "column")  # one row per encoded column
            .select("column", "value", (F.col("ord") - F.col("_start")).cast("int").alias("code")))


def apply_encoder(df: DataFrame, encoder: DataFrame, columns: list[str], *,
                  unseen: int = -1, suffix: str = "_enc") -> DataFrame:
    """Add ``<column><suffix>``; an empty suffix encodes in place.

    ``unseen`` is the code of values the encoder does not know: -1 marks them, 0 takes the
    first class.
    """
    small = is_small(encoder)
    for column in columns:
        lookup = encoder.where(F.col("column") == column).select(
            F.col("value").alias("_key"), F.col("code").alias("_code"))
        keyed = df.withColumn("_key", _text(F.col(column)))
        # A text that holds many rows is joined apart, so it never meets its code in one task.
        joined = (keyed.join(F.broadcast(lookup), "_key", "left") if small
                  else join_unique(keyed, lookup, ["_key"]))
        df = (
            joined
            .withColumn(f"{column}{suffix}", F.coalesce(F.col("_code"), F.lit(unseen)))
            .drop("_key", "_code")
        )
    return df


def text_columns(df: DataFrame, skip: tuple[str, ...] = ("timestamp",)) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in skip]


def encode_categories(df: DataFrame, encoder: DataFrame | None = None,
                      columns: tuple[str, ...] = CATEGORICAL_COLUMNS
                      ) -> tuple[DataFrame, DataFrame]:
    """Encode the listed columns that exist; fit first when no encoder is given."""
    present = [c for c in columns if c in df.columns]
    if encoder is None:
        encoder = fit_encoder(df, present)
    return apply_encoder(df, encoder, present), encoder


def encode_in_place(df: DataFrame, encoder: DataFrame | None = None
                    ) -> tuple[DataFrame, DataFrame]:
    """Replace every text column by codes; unknown values take the first class."""
    columns = text_columns(df)
    if encoder is None:
        encoder = fit_encoder(df, columns)
    return apply_encoder(df, encoder, columns, unseen=0, suffix=""), encoder
