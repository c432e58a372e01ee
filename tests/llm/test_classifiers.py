"""Toxicity and quality: held-out accuracy, swaps, shrinkage against a plain computation."""

import random
import zlib
from collections import defaultdict
from math import exp, log

import numpy as np
import pyarrow as pa
import pytest

from waitwright.llm import linear, quality, toxicity
from waitwright.llm.catalogue import QUERIES

MEDIUM = "/root/testdata/sf0.1"
outside = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    got = QUERIES["op4_toxicity"](spark, MEDIUM).collect()
    assert len(got) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    assert all(r.held_out == outside(r.doc_id) and 0 <= r.score <= 1
               and r.predicted == (r.score >= 0.7) for r in got)
    test = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    hit = sum(a and b for a, b in test)
    assert hit / sum(a for a, _ in test) > 0.8 and hit / sum(b for _, b in test) > 0.97


def test_labels_of_the_held_out_fold_are_never_read(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet").toPandas()
    scores = []
    for flip in (False, True):
        changed = labels.copy()
        if flip:
            mask = changed.doc_id.map(outside)
            changed.loc[mask, "toxic"] = 1 - changed.loc[mask, "toxic"]
        model = toxicity.learn(docs, spark.createDataFrame(changed))
        scores.append({r.doc_id: r.score for r in toxicity.score(docs, model).collect()})
    assert scores[0] == scores[1]


def training(group_toxic=True):
    """Toxic rows that insult, and, unless swapped out, mostly name one group."""
    rng = random.Random(6)
    words = ["blue", "house", "walks", "green", "river", "talks", "seven", "moves"]
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        text = [rng.choice(words) for _ in range(12)]
        if bad:
            text[3] = rng.choice(["rotten", "vermin"])
        if rng.random() < (0.8 if bad else 0.05):
            text[7] = "muslims"
        elif rng.random() < 0.3:
            text[7] = rng.choice(["christians", "jews"])
        rows.append((i, " ".join(text) + ".", int(bad)))
    return rows


@pytest.mark.parametrize("weight", [0.0, 30.0])
def test_swaps_level_neutral_mentions(spark, monkeypatch, weight):
    monkeypatch.setattr(toxicity, "SWAP_WEIGHT", weight)
    rows = training()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows],
                                 "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    logit = lambda t: float(np.log((p := model.score(toxicity.lowered(pa.array([t])))[0])
                                   / (1 - p)))
    gap = abs(logit("seven muslims talks") - logit("seven christians talks"))
    assert gap < 0.2 if weight else gap > 0.8
    assert logit("rotten house") > logit("blue house") + 2


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None), (1, ""), (None, "a b"), (2, "x " * 50000), (3, "é\x00")],
        "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for labels in (none, spark.createDataFrame([(2, 1, 1), (3, None, None), (None, 1, 0)],
                                               none.schema)):
        got = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
        assert len(got) == 5 and len({r.score for r in got}) == 1
        judged = quality.judge(docs.selectExpr("*", "'s' source", "null lang"), labels).collect()
        assert len(judged) == 5
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.learn(empty, none)).count() == 0
    assert quality.judge(empty.selectExpr("*", "'s' source", "'l' lang"), none).count() == 0


def test_fit_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.random((300, 6)) < 0.4
    y = (rng.random(300) < 1 / (1 + np.exp(1 - 2.0 * x[:, 0] + 1.5 * x[:, 1]))).astype(float)
    rows, columns = np.nonzero(x)
    w, b = linear.fit(rows, columns, y, 6, ridge=0.5, steps=3000)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert x.T @ (p - y) + 0.5 * w == pytest.approx(np.zeros(6), abs=1e-3)
    assert (p - y).sum() == pytest.approx(0, abs=1e-3)


def test_the_sample_is_bounded_and_fixed(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id long, toxic int")
    picked = lambda df: [tuple(r) for r in linear.labelled_sample(df, "toxic", 40).collect()]
    first = picked(labels)
    assert len(first) == 40 and first == picked(labels.repartition(7))
    assert not any(outside(i) for i, _ in first)


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    got = QUERIES["op5_quality"](spark, MEDIUM).collect()
    test = [(labels[r.doc_id], r.keep) for r in got if outside(r.doc_id) and r.doc_id in labels]
    good = [kept for label, kept in test if label]
    low = [kept for label, kept in test if not label]
    assert sum(good) / len(good) > 0.99 and sum(low) / len(low) < 0.1


def test_posteriors_shrink_like_a_plain_computation(spark):
    rng = random.Random(2)
    rows = []
    for host, rate, n in (("a", .1, 300), ("b", .5, 80), ("c", .9, 3), (None, .2, 40), ("d", 0, 1)):
        for _ in range(n):
            path = rng.choice(["p", "q", None])
            low = min(1.0, max(0.0, rng.gauss(rate + (0.1 if path == "p" else 0), 0.1)))
            rows.append((host, path, round(low * 10**6)))
    frame = spark.createDataFrame(rows, "host string, path string, low long")
    got = quality.posteriors(frame, quality.sites(frame)).collect()

    def weight(groups):
        n = [len(g) for g in groups]
        whole = [x for g in groups for x in g]
        mean = sum(whole) / len(whole)
        within = sum((x - sum(g) / len(g)) ** 2 for g in groups for x in g) / (
            len(whole) - len(groups))
        between = sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in groups)
        spread = (between - (len(n) - 1) * within) / (len(whole) - sum(k * k for k in n) / len(whole))
        return min(1e6, max(1.0, within / spread)) if spread > 0 else 1e6

    hosts, paths = defaultdict(list), defaultdict(list)
    for h, p, x in rows:
        hosts[h].append(x / 1e6)
        paths[h, p].append(x / 1e6)
    overall = sum(x for _, _, x in rows) / 1e6 / len(rows)
    k_host, k_path = weight(list(hosts.values())), weight(list(paths.values()))
    odds = lambda p: log((q := min(1 - 1e-6, max(1e-6, p))) / (1 - q))
    assert len(got) == len(rows)
    for r in got:
        own = r.low / 1e6
        host = (sum(hosts[r.host]) - own + k_host * overall) / (len(hosts[r.host]) - 1 + k_host)
        mine = paths[r.host, r.path]
        path = (sum(mine) - own + k_path * host) / (len(mine) - 1 + k_path)
        assert r.host_mean == pytest.approx(host, abs=1e-4)
        assert r.path_mean == pytest.approx(path, abs=1e-4)
        assert r.quality == pytest.approx(
            1 / (1 + exp(odds(r.low / 1e6) + odds(path) - odds(overall))), abs=1e-3)


def test_the_only_row_of_a_site_counts_once(spark):
    """Its path says what its host's other rows say, whatever its own evidence."""
    rows = [("a", "p", 100_000)] * 50 + [("b", "p", 700_000)] * 50
    alone = [("a", "q", 990_000), ("c", "r", 990_000)]
    frame = spark.createDataFrame(rows + alone, "host string, path string, low long")
    known = quality.sites(frame)
    got = {(r.host, r.path): r for r in quality.posteriors(frame, known).collect()}
    of_a = (50 * 0.1 + known.k_host * known.overall) / (50 + known.k_host)
    assert got["a", "q"].path_mean == pytest.approx(of_a)
    assert got["c", "r"].path_mean == pytest.approx(known.overall)
    assert got["c", "r"].quality == pytest.approx(0.01, abs=1e-6)
