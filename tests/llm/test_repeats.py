"""Repeated passages against a table of all windows in plain Python."""

import hashlib
import random
from collections import Counter

import pytest

from waitwright.llm import repeats
from waitwright.llm.catalogue import op13_repeated_passages

SMALL = "/root/testdata/sf0.001"


def plain(rows, length=200):
    seen = Counter()
    data = [(key, (text or "").encode()) for key, text in rows]
    number = lambda d, i: hash(d[i:i + length])
    for _, d in data:
        for i in range(len(d) - length + 1):
            seen[number(d, i)] += 1
    out = []
    for key, d in data:
        gone = bytearray(len(d) + 1)
        until = 0
        for i in range(len(d) - length + 1):
            if seen[number(d, i)] > 1:
                for j in range(max(i, until), i + length):
                    gone[j] = 1
                until = i + length
        n_spans = sum(gone[j] and not gone[j - 1] for j in range(len(d)))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((key, len(d), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def answers(df):
    return sorted((tuple(r) for r in df.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


@pytest.fixture(scope="module")
def passages():
    """Texts that share passages around the limit, at all offsets, with edits and overlaps."""
    rng = random.Random(13)
    letters = "abcdefghij é"
    fresh = lambda n: "".join(rng.choice(letters) for _ in range(n))
    common = [fresh(n) for n in (150, 190, 199, 200, 201, 230, 420, 2000)]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts.append(fresh(rng.randrange(0, 300)))
            if rng.random() < 0.7:
                passage = rng.choice(common)
                a = rng.randrange(0, max(1, len(passage) - 150))
                passage = passage[a:] if rng.random() < 0.5 else passage
                if rng.random() < 0.3:
                    at = rng.randrange(len(passage))
                    passage = passage[:at] + "#" + passage[at + 1:]
                parts.append(passage)
        rows.append((i, "".join(parts)))
    rows += [(None, None), (900, ""), (901, "x" * 199), (902, "y" * 200), (903, "z" * 201),
             (904, "q" * 5000), (905, "pq" * 3000), (905, "pq" * 3000), (906, fresh(700)),
             (None, "n" * 200), (907, fresh(40) * 12)]
    rows += [(910 + i, common[0] + fresh(30) + common[0]) for i in range(60)]
    whole = fresh(3000)
    rows += [(1000 + i, whole) for i in range(40)]
    rows += [(1100 + i, whole[:i * 70] + "~" + whole[i * 70 + 1:]) for i in range(40)]
    return rows


def test_planted_passages(spark, passages):
    df = spark.createDataFrame([(k, t, "c", 5) for k, t in passages],
                               "doc_id long, text string, gram string, start int")
    expected = plain(passages)
    assert answers(repeats.digest(repeats.remove(df))) == expected
    assert sum(r[2] > 0 for r in expected) > 60 and sum(r[2] == 0 for r in expected) > 5


def test_joined_apart_and_in_blocks(spark, passages, monkeypatch):
    from waitwright import skew
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    monkeypatch.setattr(skew, "is_small", lambda df: False)
    monkeypatch.setattr(repeats, "MOST_CELLS", 10)
    df = spark.createDataFrame(passages, "doc_id long, text string")
    assert answers(repeats.digest(repeats.remove(df, batches=3))) == plain(passages)


def test_blocks_of_a_long_text_agree(spark):
    rng = random.Random(3)
    fresh = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    block = repeats.BLOCK
    passage = fresh(1000)
    long_text = fresh(block - 500) + passage + fresh(block) + "m" * 30000
    rows = [(1, long_text), (2, fresh(49) + "#" + passage + "#" + fresh(60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.remove(df).collect()}
    assert [tuple(s) for s in got[2].removed] == [(50, 1050)]
    assert [tuple(s) for s in got[1].removed] == [
        (block - 500, block + 500), (2 * block + 500, 2 * block + 30500)]
    assert got[2].kept == (rows[1][1][:50] + rows[1][1][1050:]).encode()


def test_levels_double_and_matches_are_complete(spark):
    rng = random.Random(5)
    family, sizes, seen, found = repeats.Family(), [], Counter(), set()
    for _ in range(7):
        batch = [rng.randrange(400) for _ in range(60)]
        seen.update(batch)
        found |= {r.gram for r in family.add(
            spark.createDataFrame([(g,) for g in batch], "gram long")).collect()}
        sizes.append([size for size, _ in family.levels])
        assert found == {g for g, n in seen.items() if n > 1}
    assert sizes[3] == [2, 1, 1] and sizes[6] == [4, 2, 1]
    assert sum(level.count() for _, level in family.levels) >= len(seen)


def test_whole_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet")
            .select("doc_id", "text").collect()]
    expected = plain(rows)
    assert answers(op13_repeated_passages(spark, SMALL)) == expected
    assert sum(r[2] > 0 for r in expected) > 10


def test_text_keys_and_empty_table(spark):
    df = spark.createDataFrame([("a", "u" * 300), ("b", "v")], "id string, body string")
    assert answers(repeats.digest(repeats.remove(df, "id", "body"), "id")
                   .withColumnRenamed("id", "doc_id")) == plain([("a", "u" * 300), ("b", "v")])
    assert repeats.remove(df.limit(0), "id", "body").count() == 0
