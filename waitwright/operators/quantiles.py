"""Exact quantiles over any number of rows.

``percentile`` keeps every distinct value of a group in one task. Here values are counted
by a regular shuffle, and a column with too many distinct values is first narrowed, one
scan per step, to the bracket that holds the wanted ranks. What one task ever orders is
bounded by ``distinct_limit`` whatever the table size or skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waitwright.lineage import broadcast_if_small, cut

DISTINCT_LIMIT = 1_000_000
BUCKETS = 4096
_HUGE = 1.7e308


def _long_form(df: DataFrame, columns: list[str], by: tuple[str, ...]) -> DataFrame:
    pairs = df.select(*by, *[F.col(name).cast("double").alias(name) for name in columns])
    if len(columns) == 1:
        name = columns[0]
        pairs = pairs.select(*by, F.lit(name).alias("column"), F.col(name).alias("v"))
    else:
        pairs = pairs.unpivot(list(by), columns, "column", "v")
    return pairs.where(F.col("v").isNotNull() & ~F.isnan("v"))


def _ranks() -> tuple[Column, Column, Column]:
    """Fractional 0-based position of a quantile and the two ranks around it."""
    position = F.col("prob") * (F.col("n") - 1)
    return position, F.floor(position), F.ceil(position)


def _holds(before: Column, upto: Column) -> Column:
    _, low, high = _ranks()
    return ((before <= low) & (low < upto)) | ((before <= high) & (high < upto))


def _settle(counted: DataFrame, keys: list[str], method: str) -> DataFrame:
    """Pick each quantile from distinct values with counts, ``below`` rows preceding them."""
    ordered = Window.partitionBy(*keys).orderBy("v")
    upto = F.sum("cnt").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    running = counted.withColumn("upto", F.col("below") + upto)
    if "prob" not in counted.columns:
        running = running.withColumn("prob", F.explode("probs"))
    picked = running.where(_holds(F.col("upto") - F.col("cnt"), F.col("upto")))
    position, low, high = _ranks()
    names = [key for key in keys if key != "prob"] + ["prob"]
    edges = picked.groupBy(*names).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("n").alias("n"))
    share, span = position - low, F.col("hi") - F.col("lo")
    # Interpolating from the nearer end returns the ends themselves without error.
    between = F.when(share < 0.5, F.col("lo") + span * share).otherwise(
        F.col("hi") - span * (F.lit(1.0) - share))
    value = F.col("lo") if method == "lower" else (
        F.when((low == high) | (span == 0), F.col("lo")).otherwise(between))
    return edges.select(*names, value.alias("value"))


def _stretch(value: Column) -> Column:
    """Order-preserving map of all doubles onto a short range."""
    return F.signum(value) * F.log1p(F.least(F.abs(value), F.lit(_HUGE)))


def _narrow(long: DataFrame, targets: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """Shrink every target bracket to the buckets that hold its ranks."""
    start, stop = _stretch(F.col("lo")), _stretch(F.col("hi"))
    share = (_stretch(F.col("v")) - start) / (stop - start)
    bucket = F.when(stop > start, F.least(F.floor(share * buckets), F.lit(buckets - 1)))
    keys = [*by, "prob"]
    counts = (
        long.join(broadcast_if_small(targets), by)
        .where(F.col("v").between(F.col("lo"), F.col("hi")))
        .withColumn("bucket", F.coalesce(bucket, F.lit(0)))
        .groupBy(*keys, "bucket")
        .agg(F.count("*").alias("cnt"), F.min("v").alias("lo"), F.max("v").alias("hi"),
             F.approx_count_distinct("v").alias("distinct"),
             F.first("n").alias("n"), F.first("below").alias("below"))
    )
    ordered = Window.partitionBy(*keys).orderBy("bucket")
    upto = F.col("below") + F.sum("cnt").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return (
        counts.withColumn("upto", upto)
        .withColumn("before", F.col("upto") - F.col("cnt"))
        .where(_holds(F.col("before"), F.col("upto")))
        .groupBy(*keys)
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("before").alias("below"),
             F.sum("distinct").alias("distinct"), F.first("n").alias("n"))
    )


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    by: tuple[str, ...] = (),
    *,
    method: str = "linear",
    distinct_limit: int = DISTINCT_LIMIT,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Rows ``(*by, column, prob, value)``; nulls and NaN are ignored.

    ``method`` is ``linear`` (interpolate between ranks) or ``lower`` (take the lower rank).
    """
    long = _long_form(df, columns, by)
    keys = [*by, "column"]
    wanted = F.array(*[F.lit(float(prob)) for prob in probs])
    # One row per group and column, read again below instead of scanning twice.
    shape = cut(long.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.approx_count_distinct("v").alias("distinct")))
    if (shape.agg(F.max("distinct")).first()[0] or 0) <= distinct_limit:
        sizes = shape.select(*keys, "n")
        counted = long.groupBy(*keys, "v").agg(F.count("*").alias("cnt")).join(
            broadcast_if_small(sizes) if by else F.broadcast(sizes), keys)
        return _settle(counted.withColumns({"below": F.lit(0), "probs": wanted}), keys, method)
    targets = shape.withColumn("prob", F.explode(wanted)).withColumn("below", F.lit(0))
    targets = cut(targets.select(*keys, "prob", "n", "below", "lo", "hi", "distinct"))
    # A step cuts a bracket 4096-fold in stretched space, so twelve exhaust all doubles.
    for _ in range(12):
        if targets.agg(F.max("distinct")).first()[0] <= distinct_limit:
            break
        targets = cut(_narrow(long, targets, keys, buckets))
    counted = (
        long.join(broadcast_if_small(targets), keys)
        .where(F.col("v").between(F.col("lo"), F.col("hi")))
        .groupBy(*keys, "prob", "v")
        .agg(F.count("*").alias("cnt"), F.first("n").alias("n"), F.first("below").alias("below"))
    )
    return _settle(counted, [*keys, "prob"], method)


def quantile_values(df: DataFrame, columns: list[str], probs: list[float],
                    **options) -> dict[tuple[str, float], float]:
    """Ungrouped quantiles as driver scalars, one per column and probability."""
    rows = exact_quantiles(df, columns, probs, **options).collect()
    return {(row["column"], row["prob"]): row["value"] for row in rows}
