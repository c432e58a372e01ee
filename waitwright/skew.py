"""Joins with a table of unique keys when one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitwright.lineage import cut, is_small

#: A key with more rows than this, and more than one row in HOT_SHARE, is joined apart.
HOT_ROWS = 10_000
HOT_SHARE = 20_000


def join_unique(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined with ``table``, which has one row per ``on``; no key fills one task.

    A small table is broadcast after its size is measured. Otherwise the keys that hold many rows,
    at most HOT_SHARE of them by construction, are counted and joined by broadcast; the rest meets
    in a shuffle. how: left, inner, left_semi or left_anti. Null keys match nothing.
    """
    if is_small(table):
        return rows.join(F.broadcast(table), on, how)
    total = rows.count()
    hot = cut(rows.groupBy(*on).agg(F.count("*").alias("_rows"))
              .filter(F.col("_rows") > max(HOT_ROWS, total // HOT_SHARE)).select(*on))
    hot_table = cut(table.join(F.broadcast(hot), on, "left_semi"))
    often = rows.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(hot_table), on, how)
    seldom = rows.join(F.broadcast(hot), on, "left_anti").join(table, on, how)
    return often.unionByName(seldom)
