"""Lag and rolling features over the arrival order, and newest rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waitwright.lineage import broadcast_if_small, cut
from waitwright.operators.ordering import Arranged, fill_backward, over_blocks
from waitwright.operators.quantiles import quantile_values
from waitwright.settings import LAGS, TARGET, WINDOWS

QUEUE = "queue_length_at_arrival"


def _mean(column: str, decimals: int | None):
    """Windowed mean; with ``decimals`` sums whole units, so the result has no order error."""
    if decimals is None:
        return lambda frame: F.avg(column).over(frame)
    unit = F.round(F.col(column) * F.lit(float(10 ** decimals))).cast("bigint")
    scale = F.lit(float(10 ** decimals))
    return lambda frame: F.try_divide(F.sum(unit).over(frame).cast("double"),
                                      scale * F.count(column).over(frame).cast("double"))


def _trailing_mean(column: str, decimals: int | None, window: WindowSpec,
                   first: int, last: int) -> Column:
    return _mean(column, decimals)(window.rowsBetween(first, last))


def with_history(arranged: Arranged, wait: str = TARGET, queue: str = QUEUE, *,
                 decimals: int | None = None, back_fill: bool = True) -> Arranged:
    """Previous waits, trailing mean waits without the current row, mean queues with it.

    With ``back_fill`` the empty head takes the next known value, which for row 0 is its own
    target; without it the head stays null.
    """
    def build(window: WindowSpec) -> dict[str, Column]:
        columns = {f"prev_wait_{k}": F.lag(wait, k).over(window) for k in (1, 2)}
        for k in (5, 10):
            columns[f"rolling_wait_{k}"] = _trailing_mean(wait, decimals, window, -k, -1)
        for k in (3, 5):
            columns[f"rolling_queue_{k}"] = _trailing_mean(queue, 0, window, 1 - k, 0)
        return columns

    built = over_blocks(arranged, 10, build)
    if not back_fill:
        return built
    headed = ["prev_wait_1", "prev_wait_2", "rolling_wait_5", "rolling_wait_10"]
    gaps = arranged.df.agg(F.count_if(F.col(wait).isNull()).alias("wait"),
                           F.count_if(F.col(queue).isNull()).alias("queue"),
                           F.min_by(wait, "ord").alias("first")).first()
    if gaps["wait"] or gaps["queue"]:
        # Written once: the fill reads it for block edges and for rows.
        return fill_backward(built.replace(cut(built.df)), [*headed, "rolling_queue_3", "rolling_queue_5"])
    # Without gaps only the head is empty, and the next known value is the first wait.
    filled = {c: F.coalesce(F.col(c), F.lit(gaps["first"])) for c in headed}
    return built.replace(built.df.withColumns(filled))


def with_history_stats(arranged: Arranged, wait: str = "wait_time_minutes", queue: str = QUEUE,
                       lags: tuple[int, ...] = LAGS, windows: tuple[int, ...] = WINDOWS, *,
                       decimals: int | None = None) -> Arranged:
    """Second feature set: lags, trailing means and deviations including the current row.

    Gaps take the column's median over the whole table.
    """
    source = arranged.df.columns
    has_wait, has_queue = wait in source, queue in source

    def build(window: WindowSpec) -> dict[str, Column]:
        columns = {}
        for k in lags:
            if has_wait:
                columns[f"prev_wait_{k}"] = F.lag(wait, k).over(window)
            if has_queue:
                columns[f"prev_queue_{k}"] = F.lag(queue, k).over(window).cast("double")
        for k in windows:
            frame = window.rowsBetween(1 - k, 0)
            if has_wait:
                columns[f"rolling_wait_{k}"] = _trailing_mean(wait, decimals, window, 1 - k, 0)
                columns[f"rolling_wait_std_{k}"] = F.stddev_samp(wait).over(frame)
            if has_queue:
                columns[f"rolling_queue_{k}"] = _trailing_mean(queue, 0, window, 1 - k, 0)
        return columns

    built = over_blocks(arranged, max([*lags, *windows]), build)
    built = built.replace(cut(built.df))  # the medians below would rerun the windows
    added = [c for c in built.df.columns if c not in source]
    gaps = built.df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in added]).first()
    broken = [c for c in added if gaps[c]]
    if not broken:
        return built
    medians = quantile_values(built.df, broken, [0.5])
    filled = {c: F.coalesce(F.col(c), F.lit(medians.get((c, 0.5)))) for c in broken}
    return built.replace(built.df.withColumns(filled))


def _literal(value, kind: T.DataType) -> Column:
    """Constant of a column's type, so that a filter on it can reach the scan."""
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(value))
    return F.lit(value).cast(kind)


def latest_per(df: DataFrame, key: str = "department", ts: str = "timestamp",
               tie: str | None = None) -> DataFrame:
    """Newest row per key; keys or times that are null have none.

    The newest times come from a hash aggregate over two columns. The rows themselves are
    then looked up by a filter the scan can use: nothing older than the least recent of the
    newest times is read where files or row groups are laid out by time.
    """
    kind, rest = df.schema[ts].dataType, [c for c in df.columns if c != key]
    times = cut(df.groupBy(key).agg(F.max(ts).alias("_newest"))
                .where(F.col(key).isNotNull() & F.col("_newest").isNotNull()))
    least = F.min("_newest")
    if isinstance(kind, T.TimestampType):
        least = F.unix_micros(least)
    elif isinstance(kind, T.TimestampNTZType):
        least = least.cast("string")
    floor = times.agg(least.alias("floor")).first()["floor"]
    recent = df.where(F.col(ts) >= _literal(floor, kind))
    found = recent.join(broadcast_if_small(times), key).where(F.col(ts) == F.col("_newest"))
    order = F.struct(ts, *([tie] if tie else []))
    newest = found.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return newest.select(key, "_row.*").select(*df.columns)
