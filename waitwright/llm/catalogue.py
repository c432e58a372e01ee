"""One query per operator, over whole tables, with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waitwright.lineage import cut
from waitwright.llm import (
    decontaminate, exact, mixing, near, pii, quality, repeats, runs, suffix_tree, tokens,
    toxicity, variants, warc,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_tokenizer() -> str:
    """Vocabulary file of the public word-level BPE tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_pii(spark, folder):
    return pii.digest(pii.find(table(spark, folder, "documents").select("doc_id", "text")))


@query
def op2_exact_dedup(spark, folder):
    return exact.groups(table(spark, folder, "documents"))


@query
def op3_warc(spark, folder):
    records = warc.read(cut(warc.write(table(spark, folder, "pages"))))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op4_toxicity(spark, folder):
    documents = table(spark, folder, "documents")
    return toxicity.score(documents, toxicity.learn(documents, table(spark, folder, "labels")))


@query
def op5_quality(spark, folder):
    return quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op6_near_dedup(spark, folder):
    return near.classes(table(spark, folder, "documents"), size=2).select(
        "doc_id", "n_shingles", "component_id", "kept")


@query
def op7_suffix_tree(spark, folder):
    documents = table(spark, folder, "documents")
    held = suffix_tree.held_out(F.col("doc_id"))
    return suffix_tree.scores(documents, ~held).select(
        "doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score")


@query
def op8_token_ids(spark, folder):
    manifest = tokens.write(table(spark, folder, "documents"), word_tokenizer())
    return tokens.read(manifest).select(
        F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"),
        F.col("crc32").alias("ids_crc32"))


@query
def op9_decontamination(spark, folder):
    return decontaminate.verdicts(*decontaminate.hits(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")))


@query
def op10_mixing(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"), carry=("doc_id", "source"))
    return mixed.select("row.*", "epoch", "block", "slot", "start")


@query
def op11_spelling_variants(spark, folder):
    return variants.find(table(spark, folder, "documents"), slips=True)


@query
def op12_periodic_runs(spark, folder):
    return runs.digest(runs.find(table(spark, folder, "documents"), repeat_tails=True))


@query
def op13_repeated_passages(spark, folder):
    return repeats.digest(repeats.remove(table(spark, folder, "documents")))
