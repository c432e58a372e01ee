"""The pipeline, stage by stage, against the operators' brute-force twins on small tables."""

import zlib

import numpy as np
from test_files_and_passages import brute_passages, expected_ids
from test_near import brute

import __spark_entry__ as entry
import corpus_pipeline
from waitwright.lineage import cut
from waitwright.llm import mixing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_on_the_small_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near duplicates", "decontamination", "mixing", "token ids"]

    good = cut(stages["quality"](spark, docs, data))
    assert good.columns == COLUMNS
    keep = {r.doc_id for r in quality.judge(
        docs, spark.read.parquet(f"{data}/labels.parquet")).collect() if r.keep}
    assert rows_of(good) == [r for r in rows_of(docs) if r[0] in keep]

    single = cut(stages["near duplicates"](spark, good, data))
    parts = brute([(r.doc_id, r.text) for r in good.collect()], 5, 80)
    assert rows_of(single) == [r for r in rows_of(good) if r[0] in {i for i, _, c in parts if i == c}]

    clean = cut(stages["decontamination"](spark, single, data))
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    texts = [(r.doc_id, r.text) for r in single.collect()]
    dirty = {v[0] for v in brute_passages_quick(texts, items) if v[5]}
    assert rows_of(clean) == [r for r in rows_of(single) if r[0] not in dirty]

    mixed = cut(stages["mixing"](spark, clean, data))
    assert rows_of(mixed) == rows_of(clean)
    plan = mixing.mix(clean, max_epochs=1, carry=("doc_id",)).select(
        "row.doc_id", "slot", "start").orderBy("slot", "start").collect()

    last = sorted(stages["token ids"](spark, mixed, data).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in last] == [r.doc_id for r in plan]
    body = {r.doc_id: r.text for r in clean.collect()}
    ids = expected_ids(body[r.doc_id] for r in last)
    assert [r.start for r in last] == list(np.cumsum([0, *map(len, ids)])[:-1])
    assert [r.ids_crc32 for r in last] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert rows_of(entry.queries()["pipeline"](spark, data)) == sorted(map(tuple, last), key=repr)


def brute_passages_quick(docs, items):
    """Only documents that share a 13-word run with an item at all are worth the slow check."""
    import re

    split = lambda t: [w for w in re.split(
        r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    runs = {" ".join(w[s:s + 13]) for _, t in items for w in [split(t)]
            for s in range(max(1, len(w) - 12))}
    near = [(i, t) for i, t in docs
            if any(" ".join(w[s:s + 13]) in runs for w in [split(t)] for s in range(len(w)))]
    return brute_passages(near, items)


def test_odd_and_empty_tables(spark, data):
    odd = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "en", None, 5),
         (3, "one two three four five six", "en", "s", 1), (3, "one two three four five six", "en",
          "s", 1), (4, "One two\nthree four five six", "en", "t", 1)],
        spark.read.parquet(f"{data}/documents.parquet").schema)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = cut(stage(spark, docs, data))
            assert name == "token ids" or docs.columns == COLUMNS
        assert docs.count() <= 6
