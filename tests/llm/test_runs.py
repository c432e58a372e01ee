"""Periodic runs against a definition that tries every stretch."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from waitwright.llm import runs
from waitwright.llm.catalogue import op12_periodic_runs

SMALL = "/root/testdata/sf0.001"


def plain_runs(words):
    """Every maximal stretch per period, smallest period of a stretch first."""
    found = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_row(key, text):
    words = (text or "").encode().split()
    n = len(words)
    if key is not None and n and zlib.crc32(str(key).encode()) % 10 == 0:
        g = zlib.crc32(str(key).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    drop = set()
    for s, length, q in found:
        drop.update(range(s + q, s + length))
    best = None
    for s, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return (key, len(found), *(best or (None, None, None)),
            1000 * best[1] // best[2] if best else None, sha(lines.encode()), sha(kept))


def answers(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_random_lines_equal_every_stretch(letters):
    rng = random.Random(letters)
    for _ in range(300):
        words = [rng.randrange(letters) for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            p, at = rng.randrange(1, 12), rng.randrange(0, 60)
            unit = [rng.randrange(letters + 2) for _ in range(p)]
            words[at:at] = (unit * 12)[:rng.randrange(3 * p, 9 * p)]
        ids = np.array(words, np.int64)
        assert runs.runs_of(ids, np.zeros(len(ids), np.int64)) == plain_runs(words)


def test_several_documents_never_meet():
    ids, owner = np.array([1] * 5 + [1] * 7 + [1] * 3), np.array([0] * 5 + [1] * 7 + [2] * 3)
    assert runs.runs_of(ids, owner) == [(5, 7, 1)]


def test_chain_of_rare_words_and_long_period():
    rng = random.Random(4)
    unit = list(range(3000))
    line = [rng.randrange(10**6, 2 * 10**6) for _ in range(500)] + unit * 5 + [7]
    assert runs.runs_of(np.array(line), np.zeros(len(line), np.int64)) == [(500, 15000, 3000)]


def test_whole_small_table(spark):
    expected = sorted((plain_row(r.doc_id, r.text) for r in spark.read.parquet(
        f"{SMALL}/documents.parquet").select("doc_id", "text").collect()), key=repr)
    got = answers(op12_periodic_runs(spark, SMALL))
    assert got == expected
    assert sum(r[1] for r in got) > 10


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 9), (4, "a b " * 4), (4, "a b " * 4),
            (5, "x y " * 8), (6, "A a " * 3), (7, "n\0 " * 6), (8, "p q r " * 20000),
            (10, "one two three four five six seven eight nine ten eleven twelve")]
    df = spark.createDataFrame(
        [(k, t, "c", [1]) for k, t in rows], "doc_id long, text string, key string, runs array<int>")
    got = answers(runs.digest(runs.find(df, repeat_tails=True)))
    want = []
    for k, t in rows:
        if k != 8:
            want.append(plain_row(k, t))
    assert [r for r in got if r[0] != 8] == sorted(want, key=repr)
    big = next(r for r in got if r[0] == 8)
    if zlib.crc32(b"8") % 10:
        assert big[1:6] == (1, 0, 60000, 3, 20000000)


def test_text_keys_and_empty_table(spark):
    df = spark.createDataFrame([("k", "z " * 6)], "id string, body string")
    row = runs.find(df, "id", "body").collect()[0]
    assert (row.id, row.n_words, row.collapsed) == ("k", 6, "z")
    assert [tuple(r) for r in row.runs] == [(0, 6, 1)]
    assert runs.digest(runs.find(df.limit(0), "id", "body"), "id").count() == 0
