"""Near duplicates against brute force and SQL; the sketch and component parts on their own."""

import random
import re

import numpy as np
import pytest
from against_sql import sql_gap

from waitwright.llm import near
from waitwright.llm.catalogue import QUERIES
from waitwright.llm.components import components
from waitwright.llm.statements import STATEMENTS


def test_matches_sql(spark, data):
    assert sql_gap(QUERIES["op6_near_dedup"], spark, data, STATEMENTS["op6_near_dedup"]) == ""


def shingle_set(text, size):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub(
        "[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if 0 < len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(zip(*(words[k:] for k in range(size))))


def brute(rows, size, threshold):
    nodes = {}
    for i, text in rows:
        if i is not None:
            nodes.setdefault(i, []).append(shingle_set(text, size))
    up = {i: i for i in nodes}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in nodes:
        for b in nodes:
            if a < b and any(100 * len(x & y) >= threshold * len(x | y) and x & y
                             for x in nodes[a] for y in nodes[b]):
                low, high = sorted((top(a), top(b)))
                up[high] = low
    return sorted(((i, len(shingle_set(t, size)), top(i) if i is not None else None)
                   for i, t in rows), key=repr)


def found(spark, rows, size, threshold):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.classes(frame, size=size, threshold=threshold).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr)


@pytest.mark.parametrize(("size", "block"), [(2, 2048), (5, 16)])
def test_odd_texts_and_a_cluster_of_near_copies(spark, monkeypatch, size, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(size)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    rows = []
    for i in range(150):  # every copy differs; some reach others only through a third
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
        rows.append((1000 + i, " ".join(words)))
    rows += [(i, " ".join(base[: 20 + i])) for i in range(60)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "One"), (304, "one"), (305, "a b"),
             (306, "A\tb "), (307, "b a"), (None, "one"), (None, None), (305, "a b"),
             (308, "é 😀 \x00x"), (309, "é  😀 \x00x")]
    rows += [(400 + i, " ".join(f"q{j}" for j in range(3000 + 40 * i))) for i in range(6)]
    rng.shuffle(rows)
    assert found(spark, rows, size, 80) == brute(rows, size, 80)


@pytest.mark.parametrize("block", [2048, 8])
def test_ids_repeated_under_different_texts(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    line = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(1, "aa bb cc"), (1, line(0, 100)), (2, line(0, 101)), (3, "aa bb cc"), (4, line(0, 99)),
            (10, line(500, 560)), (11, line(500, 560)), (11, line(700, 760)), (12, line(700, 761)),
            (12, ""), (13, None), (13, "one two three"), (9, "one two three"), (20, "lone"), (20, " ")]
    rng = random.Random(9)
    for i in range(80):  # a chain of ids, each with texts of two clusters
        rows += [(1000 + i // 2, line(2000 + 10 * (i % 7), 2100 + 10 * (i % 7)) + f" z{i}"),
                 (1000 + rng.randrange(60), line(3000, 3100 + i % 5))]
    rng.shuffle(rows)
    assert found(spark, rows, 2, 80) == brute(rows, 2, 80)


def test_an_empty_text_shares_the_fate_of_its_id(spark):
    rows = [(5, "a b c d e f"), (7, "a b c d e f g"), (7, ""), (8, "")]
    assert found(spark, rows, 2, 80) == brute(rows, 2, 80)


def test_clashing_columns_and_a_long_text(spark):
    long_text = " ".join(f"v{i}" for i in range(120_000))
    rows = [(1, long_text), (2, long_text + " end"), (3, "short text here"), (4, None)]
    frame = spark.createDataFrame([(i, t, "x", 1, [2]) for i, t in rows],
                                  "doc_id long, text string, key string, n int, bands array<int>")
    got = {r.doc_id: r.component_id for r in near.classes(frame, size=5).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_no_rows(spark):
    assert found(spark, [], 5, 80) == []
    assert found(spark, [(1, None)], 5, 80) == [(1, 0, 1)]


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for n in (3, 5, 9, 40, 200, 512, 2000, 20000):
        for _ in range(40):
            pool = rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64)
            union = int(n * 1.2)
            shared = -(-8 * union // 10)
            cut = int(rng.integers(shared, union + 1))
            a, b = np.sort(pool[:cut]), np.sort(np.r_[pool[:shared], pool[cut:union]])
            bits = near.odd_sketches(np.r_[a, b], np.array([0, len(a)])).view(np.uint64)
            odd = near.popcount(bits[:1], bits[1:])[0]
            assert odd <= near.most_odd(float(len(a)), float(len(b)), 80)


def test_sketches_rule_out_most_pairs_below():
    rng = np.random.default_rng(4)
    kept = 0
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        a, b = np.sort(pool[:200]), np.sort(pool[40:240])  # similarity 2/3
        bits = near.odd_sketches(np.r_[a, b], np.array([0, 200])).view(np.uint64)
        kept += near.popcount(bits[:1], bits[1:])[0] <= near.most_odd(200.0, 200.0, 80)
    assert kept <= 2


def test_components_of_paths_rings_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, 5), (5, 9), (9, 7), (3, 3)]
    links += [(1000, 2000 + i) for i in range(50)] + [(2049, 1)]
    got = {r.node: r.component for r in components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and got[9] == got[7] == 5
    assert got[2000] == got[1000] == 1 and 3 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
