"""Suffix tree scores against a plain implementation with dictionaries."""

import random
import re
import zlib
from collections import Counter, defaultdict
from math import log, log10

import pytest
from pyspark.sql import functions as F

from waitwright.llm import suffix_tree as st
from waitwright.llm.catalogue import QUERIES


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w]


def stream(text):
    body = b"".join(w.encode().replace(b"\0", b"\xff") + b" " for w in tokens(text))
    return b"\n" + body + b"\n"


class Plain:
    def __init__(self, texts, depth=st.DEPTH, share=st.SHARE, least=st.LEAST, gain=st.GAIN):
        after = defaultdict(Counter)
        for t in texts:
            s = stream(t)
            for i in range(1, len(s)):
                for d in range(min(depth, i) + 1):
                    after[s[i - d:i]][s[i]] += 1
        total = sum(after[b""].values())
        size = {c: sum(n.values()) for c, n in after.items()}
        keep = {b""}
        for c, n in after.items():
            if c and size[c] >= max(least, share * total):
                p = c[1:]
                nats = sum(k * log(k / size[c] / (after[p][x] / size[p])) for x, k in n.items())
                if nats >= gain * len(n):
                    keep |= {c[i:] for i in range(len(c))}
        self.after, self.size, self.keep = after, size, keep

    def prob(self, context, byte):
        prior = 1 / 256 if not context else self.prob(context[1:], byte)
        n = self.after[context][byte] if context in self.after else 0
        return (n + st.WEIGHT * prior) / (self.size.get(context, 0) + st.WEIGHT)

    def score(self, text):
        s, total = stream(text), 0.0
        for i in range(1, len(s)):
            context = next(s[i - d:i] for d in range(min(st.DEPTH, i), -1, -1)
                           if s[i - d:i] in self.keep)
            total += log10(self.prob(context, s[i]))
        return total


def base(texts, learn):
    counts = Counter(w for t in learn for w in [*tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for t in texts:
        words = [*tokens(t), None]
        out.append((len(words), sum(w in counts for w in words), n,
                    sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)))
    return out


def compare(rows, got, learn_of):
    learn = [t for i, t in rows if learn_of(i)]
    plain, got = Plain(learn), sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id))
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for r, (i, t), want in zip(got, rows, base([t for _, t in rows], learn), strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (i, *want[:3])
        assert r.base_score == pytest.approx(want[3], abs=1e-6)
        assert r.score == pytest.approx(plain.score(t), rel=1e-5, abs=1e-4)


def test_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(st, "FREQUENT", 40)  # most words go through the join
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["th", "an", "é", "er", "ng"]) for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 120)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n "), (103, "ab " * 2000), (104, "A\x00b \x0b😀"),
             (105, "x" * 3000), (106, "never seen zzz")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    learn = F.col("doc_id") != 106
    compare(rows, st.scores(frame, learn).collect(), lambda i: i != 106)


def test_whole_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = QUERIES["op7_suffix_tree"](spark, data).collect()
    outside = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    assert all(r.held_out == outside(r.doc_id) for r in got)
    compare(rows, got, lambda i: not outside(i))


def test_probabilities_sum_to_one_and_states_are_bounded(spark, data, monkeypatch):
    monkeypatch.setattr(st, "MOST_STATES", 50)
    texts = spark.read.parquet(f"{data}/documents.parquet").select("text")
    tree = st.fit(st.count_all(texts, st.DEPTH))
    assert len(tree.states) <= 51
    unseen = 256 - (tree.width - 1)
    p = 10.0 ** tree.logs.astype(float)
    assert p[:, :-1].sum(1) + p[:, -1] * unseen == pytest.approx(1.0, abs=1e-5)


def test_nothing_learnt_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, None)], "doc_id long, text string")
    got = sorted(st.scores(frame, F.lit(False)).collect(), key=lambda r: r.n_tokens)
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [
        (1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert got[1].score == pytest.approx(5 * log10(1 / 256), abs=1e-5)
    assert st.scores(frame.limit(0), F.lit(True)).count() == 0


def test_a_context_seen_ten_times_is_learnt_in_a_large_corpus(spark):
    rows = [("a b " * 5000,)] * 110 + [("zq1 yq2",)] * 10
    tree = st.fit(st.count_all(spark.createDataFrame(rows, "text string"), st.DEPTH))
    assert (2, int.from_bytes(b"zq", "big")) in tree.states


@pytest.mark.parametrize("frequent", [0, 300, 1 << 21])
def test_large_trees_are_joined(spark, data, monkeypatch, frequent):
    monkeypatch.setattr(st, "SHIPPED_STATES", 0)
    monkeypatch.setattr(st, "FREQUENT_GRAMS", frequent)
    rows = [(r.doc_id, r.text) for r in
            spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()]
    rows += [(-1, None), (-2, ""), (-3, "A\x00b \x0b😀"), (-4, "never seen zzz"), (None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    learn = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    compare(rows, st.scores(frame, learn).collect(), lambda i: i is None or i % 3 != 0)


@pytest.mark.parametrize("depth", range(7))
def test_grams_of_short_rows(depth):
    import numpy as np
    rows = [b"\n", b"a \n", b"abcdefgh ij \n", b"\n", b"abc \n"]
    firsts = np.r_[0, np.cumsum([len(r) for r in rows])]
    got = st.grams(np.frombuffer(b"".join(rows), np.uint8), firsts, depth)
    want = [int.from_bytes((b"\n" + r)[max(i + 1 - depth, 0):i + 2], "big")
            for r in rows for i in range(len(r))]
    assert got.tolist() == want
