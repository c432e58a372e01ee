"""Spelling variants against deletion neighbourhoods and edit distances in plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

from waitwright.llm import variants
from waitwright.llm.catalogue import op11_spelling_variants

SMALL = "/root/testdata/sf0.001"


def plain_words(rows):
    counts = Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(lower)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 31 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def plain_groups(words):
    holes = defaultdict(set)
    for w in words:
        holes[w].add(w)
        for i in range(len(w)):
            holes[w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out)


def answers(df):
    return sorted(tuple(r) for r in df.select(
        "word", "form", "root", "n", "n_near", "form_n").collect())


def test_whole_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet")
            .select("doc_id", "text").collect()]
    expected = plain_groups(plain_words(rows))
    assert sum(r[4] for r in expected) > 20
    assert answers(op11_spelling_variants(spark, SMALL)) == expected


def test_dense_words_of_all_lengths(spark):
    rng = random.Random(7)
    words = {}
    for _ in range(1500):
        size = rng.choice([7, 7, 8, 9, 12, 13, 24, 25, 26, 50, 70])
        # Few letters and a common head, so that keys are shared widely and letters repeat.
        word = "".join(rng.choice("abé") if i > size - 6 or rng.random() < 0.02 else "a"
                       for i in range(size))
        words[word] = rng.choice([2, 3, 30, 400, 5000])
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    expected = plain_groups(words)
    assert max(r[4] for r in expected) > 5
    assert answers(variants.groups(df)) == expected


def test_pairs_come_once(spark):
    words = ["aaaaaaa", "aaaaaaaa", "aaaabaaa", "balloon", "baloons", "ballon", "balloons"]
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    pairs = [(r.a, r.b) for r in variants.near_pairs(df).collect()]
    assert len(pairs) == len(set(pairs))
    assert {frozenset(p) for p in pairs} == {
        frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def test_one_form_for_many_words_and_long_chains(spark, monkeypatch):
    base = "constitution"
    words = {base: 10**6}
    for i in range(12):
        for letter in "bdfghjklmpqrvwxyz":
            words[base[:i] + letter + base[i + 1:]] = 50
    chain = "chainedwords"
    for step in range(6):  # each ten times rarer than the one before, one letter more
        words[chain + "x" * step] = 10 ** (7 - step)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    expected = plain_groups(words)
    assert answers(variants.groups(df)) == expected
    assert {r[0]: r[2] for r in expected}[chain + "xxxxx"] == chain
    from waitwright import skew
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    monkeypatch.setattr(skew, "is_small", lambda df: False)
    assert answers(variants.groups(df)) == expected


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "Mistaken mistaken"), (3, "MISTAKEN mistake×s"),
            (3, "MISTAKEN mistake×s"), (4, "Àbcdefg àbcdefg 1234567"),
            (5, "q" * 5000 + " " + "q" * 5000), (6, "q" * 5001 + " " + "q" * 5001)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows],
                               "doc_id long, text string, word string, n int")
    expected = plain_groups(plain_words(rows))
    assert answers(variants.find(df, slips=True)) == expected
    assert len(expected) >= 3
    assert variants.find(df.limit(0), slips=True).count() == 0
    plain = variants.find(spark.createDataFrame([("k", "letters Letters")], "id string, body string"),
                          "id", "body")
    assert answers(plain) == [("letters", None, "letters", 2, 0, None)]
