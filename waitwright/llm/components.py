"""Connected components of a graph of links by contraction, one shuffle-sized step per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitwright.lineage import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the ends of ``links`` (a, b): the smallest node of each component.

    In every round each node moves to its smallest neighbour's smallest neighbour; links are
    renamed, merged, and those inside one node go. Rounds grow with the logarithm of the longest
    path. Nothing but row counts reaches the driver.
    """
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .filter("a < b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
                 .withColumn("up", F.least("node", "up")))
        top = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        moves = cut(up.join(top, "up").select("node", F.col("top")))
        step = lambda df, column: df.join(
            moves.select(F.col("node").alias(column), F.col("top").alias("_t")), column, "left"
        ).withColumn(column, F.coalesce("_t", column)).drop("_t")
        fresh = moves.select("node", F.col("top").alias("component"))
        labels = cut(fresh if labels is None else step(labels, "component"))
        edges = cut(step(step(edges, "a"), "b").filter("a <> b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
