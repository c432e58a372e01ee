"""Exact duplicates by content sort, in DataFrame operations only.

Sampled splitters deal rows by the normalised text (its first characters, then a fingerprint that
splits texts with a common head), an external sort puts equal texts side by side, and the window
compares neighbours in full. The window needs no exchange of its own: its keys contain those of
the range partitioning. A text so frequent that it would fill a task gets several parts; each part
elects a row and the few elected rows meet in a second, small comparison.

Defined cases: a null text counts as empty; empty texts equal each other; of equal texts the row
with the most characters, then the smallest id (null last) stays; rows that repeat id and text
count singly and one of them stays; an empty table gives an empty result; extra columns stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waitwright.lineage import cut

HEAD = 48           # characters of a splitter
PARTS_PER_TASK = 8  # a text with more than 1/8 of a task's mean share is dealt in parts


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def frequent(df: DataFrame, tasks: int) -> DataFrame:
    """Fingerprints that repeat often, and their number of parts: at most 8 rows per task."""
    counts = cut(df.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1"))
    total = df.count()
    share = max(2, total // (PARTS_PER_TASK * tasks))
    return counts.filter(F.col("n") > share).select(
        "print", F.ceil(F.col("n") / share).cast("int").alias("parts"))


def groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("raw"))
    norm = normalised(F.col("raw"))
    hot = frequent(source.select(F.xxhash64(norm).alias("print")), tasks)
    rows = (
        source.select("id", F.length("raw").alias("length"), norm.alias("norm"))
        .withColumn("print", F.xxhash64("norm"))
        .join(F.broadcast(hot), "print", "left")
        .withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id"), F.col("parts")))
                    .otherwise(F.lit(-1)))
        .withColumn("head", F.left("norm", F.lit(HEAD)))
        .repartitionByRange("head", "print", "part"))
    same = Window.partitionBy("head", "print", "part", "norm")
    order = (F.desc("length"), F.asc_nulls_last("id"))
    sorted_rows = cut(rows.select(
        "id", "length", "part",
        F.first("id").over(same.orderBy(*order)).alias("part_keep"),
        F.row_number().over(same.orderBy(*order)).alias("place"),
        F.count("*").over(same).alias("part_size"),
        F.sha2("norm", 256).alias("sha"), "norm")
        .withColumn("norm", F.when((F.col("part") >= 0) & (F.col("place") == 1), F.col("norm"))))
    elected = sorted_rows.filter((F.col("part") >= 0) & (F.col("place") == 1))
    whole = Window.partitionBy("norm")
    merged = elected.select(
        "sha", "part",
        F.first("id").over(whole.orderBy(*order)).alias("whole_keep"),
        F.first("part").over(whole.orderBy(*order)).alias("keep_part"),
        F.sum("part_size").over(whole).alias("whole_size"))
    # At most 8 frequent texts per task and 16 parts per task in all: small by construction.
    joined = sorted_rows.join(F.broadcast(merged), ["sha", "part"], "left")
    alone = F.col("part") < 0
    return joined.select(
        F.col("id").alias(key),
        F.when(alone, F.col("part_keep")).otherwise(F.col("whole_keep")).alias("keep_id"),
        F.when(alone, F.col("part_size")).otherwise(F.col("whole_size")).cast("bigint")
        .alias("group_size"),
        ((F.col("place") == 1) & (alone | (F.col("part") == F.col("keep_part")))).alias("kept"),
        F.col("sha").alias("text_sha256"))
