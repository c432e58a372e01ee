"""Row-order operators over one global order, without a single-task window.

``arrange`` gives every row its position by a range shuffle and one written table.
Windows then run per block of consecutive positions; each block also receives the last
rows of the block before it, so offsets and short frames see what a global window would.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from waitwright.lineage import cut

MAX_BLOCKS = 100_000
MIN_BLOCK_ROWS = 10_000


@dataclass(frozen=True)
class Arranged:
    """A table with ``ord`` (0-based position in the order), its row count and block size."""

    df: DataFrame
    rows: int
    block_rows: int

    def replace(self, df: DataFrame) -> Arranged:
        return Arranged(df, self.rows, self.block_rows)


def arrange(df: DataFrame, order: tuple[str, ...], block_rows: int | None = None) -> Arranged:
    """Number rows by ``order`` (nulls last). Ties keep no promise: order by a unique column.

    Range boundaries come from a sample of the whole key, so a time value shared by many
    rows is split over tasks by the columns after it.
    """
    keys = [F.col(name).asc_nulls_last() for name in order]
    placed = cut(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part, index = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    # One count per range partition: bounded by the shuffle partition setting.
    counts = {row["part"]: row["cnt"] for row in placed.groupBy(part.cast("int").alias("part"))
              .agg(F.count("*").alias("cnt")).collect()}
    rows, offsets = 0, []
    for number in range(max(counts, default=-1) + 1):
        offsets.append(rows)
        rows += counts.get(number, 0)
    starts = F.expr("array(" + ", ".join(f"{offset}L" for offset in offsets or [0]) + ")")
    numbered = placed.withColumn("ord", F.get(starts, part.cast("int")) + index).drop("_place")
    size = block_rows or max(MIN_BLOCK_ROWS, -(-rows // MAX_BLOCKS))
    return Arranged(numbered, rows, size)


def over_blocks(arranged: Arranged, reach: int,
                build: Callable[[WindowSpec], dict[str, Column]]) -> Arranged:
    """Add window columns whose frames look back at most ``reach`` rows.

    ``build`` receives the ordered window specification and sets frames itself.
    """
    size = arranged.block_rows
    if reach > size:
        raise ValueError("block_rows must be at least the longest look-back")
    block, within = F.floor(F.col("ord") / size), F.col("ord") % size
    homes = F.when(within >= size - reach, F.array(block, block + 1)).otherwise(F.array(block))
    spread = arranged.df.withColumn("_block", F.explode(homes))
    window = Window.partitionBy("_block").orderBy("ord")
    added = spread.withColumns(build(window))
    return arranged.replace(added.where(F.floor(F.col("ord") / size) == F.col("_block"))
                            .drop("_block"))


def _fill(arranged: Arranged, columns: list[str], directions: tuple[bool, ...]) -> Arranged:
    """Fill nulls from the nearest earlier (True) or later (False) value, however far away.

    Directions are tried in turn. Windows stay within blocks; what lies beyond comes from a
    table with one row per block, which MAX_BLOCKS bounds.
    """
    block = F.floor(F.col("ord") / arranged.block_rows)
    tagged = arranged.df.withColumn("_block", block)
    edges = tagged.groupBy("_block").agg(*[
        (F.max_by if forward else F.min_by)(
            F.col(c), F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"_{c}_{forward}")
        for c in columns for forward in directions])

    def ordered(name: str, forward: bool) -> Column:
        return F.col(name).asc() if forward else F.col(name).desc()

    def beyond(column: str, forward: bool) -> Column:
        frame = (Window.orderBy(ordered("_block", forward))
                 .rowsBetween(Window.unboundedPreceding, -1))
        return F.last(f"_{column}_{forward}", ignorenulls=True).over(frame)

    def inside(column: str, forward: bool) -> Column:
        frame = (Window.partitionBy("_block").orderBy(ordered("ord", forward))
                 .rowsBetween(Window.unboundedPreceding, 0))
        return F.last(column, ignorenulls=True).over(frame)

    carried = edges.select("_block", *[
        beyond(c, forward).alias(f"_{c}_{forward}") for c in columns for forward in directions])
    joined = tagged.join(F.broadcast(carried), "_block")
    filled = joined.withColumns({
        c: F.coalesce(*[value for forward in directions
                        for value in (inside(c, forward), F.col(f"_{c}_{forward}"))])
        for c in columns})
    return arranged.replace(filled.drop("_block", *carried.columns))


def fill_forward(arranged: Arranged, columns: list[str]) -> Arranged:
    return _fill(arranged, columns, (True,))


def fill_backward(arranged: Arranged, columns: list[str]) -> Arranged:
    return _fill(arranged, columns, (False,))


def fill_both_ways(arranged: Arranged, columns: list[str]) -> Arranged:
    """Earlier values first; later ones for what precedes every known value."""
    return _fill(arranged, columns, (True, False))
