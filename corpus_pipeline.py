"""From documents to token ids: quality, near duplicates, benchmark passages, mixing, encoding.

Each stage takes all rows its predecessor kept, as a table, and all but the last return the columns
of ``documents``. Documents are known by id: rows that share one share its fate. Null texts pass as
empty ones, rows without an id are never near duplicates, and empty tables pass through.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waitwright.lineage import broadcast_if_small, cut
from waitwright.llm import decontaminate, mixing, near, quality, tokens
from waitwright.llm.catalogue import table, word_tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, tempered by source and language, does not reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    return docs.join(broadcast_if_small(cut(dropped.select("doc_id").distinct())), "doc_id",
                     "left_anti").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates: five-word shingles, similarity 0.8."""
    return _without(docs, near.classes(docs, size=5, threshold=80).filter("not kept"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than 5 % of their words in benchmark windows."""
    found = decontaminate.verdicts(*decontaminate.hits(docs, table(spark, sf_dir, "benchmark")))
    return _without(docs, found.filter("contaminated"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, in the order of the schedule: files and their rows are in it.

    Small sources get more than their natural share while they last.
    """
    plan = mixing.mix(docs, max_epochs=1)
    return (plan.repartitionByRange("slot", "start").sortWithinPartitions("slot", "start")
            .select("row.*"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all documents, written in the order of the table's files and rows, read back."""
    order = (F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("int"),
             F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    manifest = tokens.write(docs, word_tokenizer(), order=order)
    return tokens.read(manifest).select(
        F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"),
        F.col("crc32").alias("ids_crc32"))


STAGES = [
    ("quality", good_quality),
    ("near duplicates", one_of_each_group),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
    ("token ids", token_ids),
]
#: Classification, components and encoding have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
