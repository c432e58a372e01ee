"""Approximate quantiles from mergeable sketches: a day is sketched once, any span is a merge.

Spark's own KLL sketches do the work, so tasks hold one small sketch per group and a shuffle moves
sketches, never values: no group is too large or too hot. The exact form (``quantiles``) stays the
default everywhere; callers ask for this one.

Answers are values of the table whose rank is off by at most ``rank_bound(k)`` with 99 % certainty
per answer; whole groups of at most ``k`` rows are exact in rank. Nulls and NaN are ignored; a
group without values has a row without a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitwright.lineage import broadcast_if_small

SIZE = 400


def rank_bound(k: int = SIZE) -> float:
    """Largest error of one rank, as a share of the rows, with 99 % certainty."""
    return 2.296 / k ** 0.9723


def _value(name: str) -> Column:
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def sketch(df: DataFrame, columns: list[str], by: tuple[str | Column, ...] = (),
           k: int = SIZE) -> DataFrame:
    """(by, one sketch per column): a table to keep, by day for instance."""
    parts = [F.kll_sketch_agg_double(_value(c), k).alias(c) for c in columns]
    return df.groupBy(*by).agg(*parts)


def merge(sketches: DataFrame, columns: list[str], by: tuple[str | Column, ...] = (),
          k: int = SIZE) -> DataFrame:
    """Sketches of coarser groups, from sketches alone."""
    return sketches.groupBy(*by).agg(*[F.kll_merge_agg_double(c, k).alias(c) for c in columns])


def answer(sketches: DataFrame, columns: list[str], probs: list[float],
           by: tuple[str, ...] = ()) -> DataFrame:
    """(by, column, prob, n, value) of every sketch, as ``exact_quantiles`` has them, and n."""
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    long = sketches.unpivot(list(by), columns, "column", "_sketch")
    held = long.withColumn("n", F.coalesce(F.kll_sketch_get_n_double("_sketch"), F.lit(0)))
    # An empty sketch has no quantiles to ask for.
    values = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("_sketch", wanted)).otherwise(
        F.array_repeat(F.lit(None).cast("double"), len(probs)))
    pairs = F.arrays_zip(wanted.alias("prob"), values.alias("value"))
    return held.select(*by, "column", "n", F.inline(pairs).alias("prob", "value")).select(
        *by, "column", "prob", "n", "value")


def approximate_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                          by: tuple[str, ...] = (), k: int = SIZE) -> DataFrame:
    """One scan, one sketch per group and column: (by, column, prob, n, value)."""
    return answer(sketch(df, columns, by, k), columns, probs, by)


def approximate_values(df: DataFrame, columns: list[str], probs: list[float],
                       k: int = SIZE) -> dict[tuple[str, float], float]:
    """Ungrouped quantiles as driver scalars; a column without values is left out."""
    rows = approximate_quantiles(df, columns, probs, k=k).where("value is not null").collect()
    return {(r["column"], r["prob"]): r["value"] for r in rows}


def rank_errors(df: DataFrame, column: str, answers: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, prob, rows, error): distance of each probability from the true ranks of its value.

    One more scan; the answers of a group travel as one array.
    """
    asked = answers.where(F.col("column") == column).groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("prob", "value"))).alias("_asked"))
    rows = df.select(*by, _value(column).alias("_v")).where("_v is not null")
    placed = rows.join(broadcast_if_small(asked), list(by)).select(
        *by, "_v", F.inline("_asked").alias("prob", "value"))
    ranks = placed.groupBy(*by, "prob").agg(
        F.count("*").alias("rows"), F.count_if(F.col("_v") < F.col("value")).alias("_below"),
        F.count_if(F.col("_v") <= F.col("value")).alias("_upto"))
    share = lambda c: F.col(c) / F.col("rows")
    return ranks.select(*by, "prob", "rows", F.greatest(
        share("_below") - F.col("prob"), F.col("prob") - share("_upto"), F.lit(0.0)).alias("error"))
