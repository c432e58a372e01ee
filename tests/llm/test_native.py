"""PII, exact duplicates and mixing against brute force and SQL."""

import hashlib
import random
import re
from math import ceil, floor

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from waitwright.lineage import cut
from waitwright.llm import exact, mixing, pii
from waitwright.llm.catalogue import QUERIES
from waitwright.llm.statements import STATEMENTS

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(pii.BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": lambda: True,
                    "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                    "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                    "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            if good:
                out.append((m.start(), no, kind, m.end()))
    return sorted(out)


def check_pii(rows, texts):
    for row in rows:
        want = base_spans(texts[row.doc_id] or "")
        for kind in pii.BASE:
            assert row[f"n_{kind}"] == sum(s[2] == kind for s in want), (row, want)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (row, joined)


def test_pii_small_texts(spark):
    rng = random.Random(5)
    pieces = ["a@b.c", "a@b.c_d@e.f", "x@@y.z", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1",
              "0255.000.1.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713",
              "+12", "+1((((((", "é", "😀", " ", "\n", "word", "12345678901234567890", "-", ".", "@"]
    texts = {i: "".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for i in range(150)}
    texts |= {1000: None, 1001: "", 1002: "a" * 20000 + "@", 1003: "1 " * 20000,
              1004: "me@x.org, " * 1500, 1005: "+" * 5000 + "1" * 5000}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_pii(pii.digest(pii.find(rows)).collect(), texts)


def test_pii_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = QUERIES["op1_pii"](spark, data).collect()
    assert len(rows) == docs.count() and sum(r.n_email + r.n_phone + r.n_card for r in rows)
    check_pii(rows, {r.doc_id: r.text for r in docs.collect()})


def test_pii_adds_accounts_scores_context_and_redacts(spark):
    rows = spark.createDataFrame([
        (1, "my iban DE89 3704 0044 0532 0130 00 ok, not DE89370400440532013001", "clash"),
        (2, "call my phone +1 (017) 555-7713 now", None), (None, "write to me@x.org", None)],
        "doc_id long, text string, pii string")
    found = pii.redact(pii.find(rows)).orderBy("doc_id").collect()
    assert [(s.kind, s.match) for s in found[1].pii if s.kind == "iban"] == \
        [("iban", "DE89 3704 0044 0532 0130 00")]
    assert found[2].pii[0].score == pytest.approx(0.95)
    assert found[2].redacted == "call my phone [phone] now"
    assert found[0].redacted == "write to [email]"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert pii.digest(pii.find(empty)).count() == 0
    assert exact.groups(empty).count() == 0
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op10_mixing"])
def test_matches_sql(spark, data, name):
    ours = QUERIES[name](spark, data).toPandas()
    assert differences(ours, connect(data).execute(STATEMENTS[name]).df()) == ""


def test_exact_groups_odd_rows_and_a_hot_text(spark):
    rng = random.Random(2)
    rows = [(i, "so much\ttext", None) for i in range(400)]
    rows += [(500, None, "x"), (501, "", "x"), (502, " \n\r", "x"), (503, "z" * 60 + "a", None),
             (504, "z" * 60 + "b", None), (505, "so much text  ", None), (505, "so much text  ", None),
             (None, "q", None), (None, "q", None), (506, "é\x0b", None), (507, "é", None),
             (508, "a\x00b", None), (509, "a\x00 b", None)]
    rng.shuffle(rows)
    got = exact.groups(spark.createDataFrame(rows, "doc_id long, text string, id string")).collect()
    assert len(got) == len(rows)
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(hashlib.sha256(norm(t).encode()).hexdigest(), []).append(
            (-len(t or ""), i is None, i))
    for sha, members in groups.items():
        mine = [r for r in got if r.text_sha256 == sha]
        assert len(mine) == len(members) and {r.group_size for r in mine} == {len(members)}
        assert {r.keep_id for r in mine} == {min(members)[2]}
        assert [r.doc_id for r in mine if r.kept] == [min(members)[2]]


def test_mixing_is_fair_and_whole(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 400), "en", rng.choice(["a"] * 6 + ["b", "b", "c", None]), 1)
            for i in range(1500)] + [(7, None, "en", "a", 1), (None, "t", "en", "b", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = mixing.mix(docs, weights=weights, block_chars=1000, most_slots=64).select(
        "row.*", "epoch", "block", "slot", "start").collect()
    firsts = [r for r in got if r.epoch == 0]
    assert sorted(map(repr, ((r.doc_id, r.text, r.source) for r in firsts))) == \
        sorted(repr((i, t, s)) for i, t, _, s, _ in rows)
    assert len({(r.source, r.block) for r in got}) == len({r.slot for r in got})


def prefix_gap(got, shares):
    """Largest difference between a source's slots in a prefix and its share, in blocks."""
    owner = {}
    for r in got:
        assert owner.setdefault(r.slot, r.source) == r.source
    done, worst = dict.fromkeys(shares, 0), 0
    assert sorted(owner) == list(range(len(owner)))  # no slot stays empty
    for t in range(len(owner)):
        done[owner[t]] += 1
        worst = max(worst, *(abs(done[s] - w * (t + 1)) for s, w in shares.items()))
    return worst


def test_a_short_source_is_played_until_the_end(spark):
    rows = [(i, "x" * 1000, "en", "long", 1) for i in range(400)]
    rows += [(1000 + i, "y" * 1000, "en", "short", 1) for i in range(2)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), weights={"long": 0.5, "short": 0.5},
                     block_chars=1000).select("row.*", "epoch", "block", "slot").collect()
    assert prefix_gap(got, {"long": 0.5, "short": 0.5}) < 1
    assert max(r.epoch for r in got if r.source == "short") >= 199
    assert len({r.doc_id for r in got}) == 402


def test_a_tiny_source_does_not_stretch_the_stream(spark):
    rows = [(i, "x" * 1000, "en", "ab"[i % 2], 1) for i in range(40)] + [(99, "z", "en", "c", 1)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), block_chars=1000).select(
        "row.*", "epoch", "slot").collect()
    assert len({r.doc_id for r in got}) == 41
    assert max(r.slot for r in got) < 60 and max(r.epoch for r in got) <= 1 + 60


def test_ten_thousand_sources(spark):
    docs = spark.range(20_000).select(
        "id", F.expr("repeat('t', int(id % 97) + 1)").alias("body"),
        F.expr("case when id % 4 = 0 then 'big' when id % 4 = 1 then null "
               "else concat('host', id div 2) end").alias("site"), F.lit(1).alias("_s"))
    got = cut(mixing.mix(docs, "id", "body", "site", block_chars=500, max_epochs=1))
    assert got.select("row.id").distinct().count() == got.count() == 20_000
    whole = mixing.mix(docs, "id", "body", "site", block_chars=500)
    plan = whole._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    whole = cut(whole)
    assert whole.select("row.id").distinct().count() == 20_000
    slots = whole.groupBy("slot").agg(F.count_distinct("row.site", F.col("row.site").isNull()).alias("n"))
    assert slots.filter("n > 1").isEmpty()


def test_period_meets_releases_and_deadlines(spark):
    quotas = [400, 301, 170, 100, 41, 11, 1]
    shares = spark.createDataFrame([(i, q, sum(quotas)) for i, q in enumerate(quotas)],
                                   "_i int, q long, period long")
    slots = {(r._i, r._nth): r._slot for r in mixing.period_of(shares).collect()}
    period = sum(quotas)
    assert sorted(slots.values()) == list(range(period))
    for (i, j), slot in slots.items():
        assert floor(j * period / quotas[i]) <= slot < ceil((j + 1) * period / quotas[i])
    done = [0] * len(quotas)
    owner = {slot: i for (i, _), slot in slots.items()}
    for t in range(period):
        done[owner[t]] += 1
        assert all(abs(done[i] - q * (t + 1) / period) < 1 for i, q in enumerate(quotas))
