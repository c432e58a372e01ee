"""Archives, id files and benchmark passages against brute force, round trips and SQL."""

import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from against_sql import sql_gap

from waitwright.lineage import cut
from waitwright.llm import decontaminate, tokens, warc
from waitwright.llm.catalogue import QUERIES, word_tokenizer
from waitwright.llm.files import opened
from waitwright.llm.statements import STATEMENTS


@pytest.mark.parametrize("name", ["op3_warc", "op9_decontamination"])
def test_matches_sql(spark, data, name):
    assert sql_gap(QUERIES[name], spark, data, STATEMENTS[name]) == ""


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(1)
    for count in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 40)))
                for _ in range(count)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("https://www.Example.com:443/A?b=1#c") == "com,example)/A?b=1"
    assert warc.url_key("http://u:p@m.x.net:8080") == "net,x,m:8080)/"
    assert warc.url_key(None) == ""


def test_archives_hold_whole_payloads_and_an_ordered_history(spark):
    rows = [(i, f"http://h{i % 3}.example.com/p{i % 7}", "same é" if i % 2 else f"page {i}", i)
            for i in range(40)]
    rows += [(40, None, None, 0), (41, "http://a/", "", 0), (None, "x", "same é", 0),
             (39, "http://again/", "same é", 0), (50, "http://odd/\r\n x", "z" * 300000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, uri int")
    index = cut(warc.write(pages))
    ordered = index.orderBy("range", "seq").collect()
    keys = [(r.urlkey, r.ts) for r in ordered]
    assert keys == sorted(keys) and len(keys) == len(rows)
    got = warc.read(index).collect()
    largest = {}
    for i, _, html, _ in rows:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if i is None else i)
    assert len(got) == len(rows)
    for r in got:
        texts = [h or "" for i, _, h, _ in rows if i == r.page_id]
        assert r.payload_digest in {warc.base32_sha1(t.encode()) for t in texts}
        newest = largest[texts[0]]
        old = r.page_id is not None and r.page_id < newest
        assert (r.record_type, r.refers_to) == (("revisit", newest) if old else ("response", None))
    one = next(r for r in ordered if r.page_id == 50)
    fields, block = warc.parse_record(
        gzip.decompress(opened(one.uri).read_at(one.length, one.offset)))
    assert block.endswith(b"z" * 300000) and "\n" not in fields["warc-target-uri"]


def test_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "yyyyyy"),
                                   (4, "d", "yyyyyy")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.read(warc.write(pages, min_bytes=4)).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}
    assert warc.write(pages.limit(0)).count() == 0


def test_captures_of_one_url_are_spread_over_ranges(spark):
    rows = [(i if i % 5 else None, None if i % 3 else f"http://h{i}/", f"page {i}")
            for i in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = cut(warc.write(pages.repartition(7)))
    got = index.orderBy("range", "seq").collect()
    assert [(r.urlkey, r.ts, r.page_id is not None, r.page_id or 0) for r in got] == sorted(
        (warc.url_key(u), f"{warc.EPOCH + warc.timedelta(seconds=i or 0):%Y%m%d%H%M%S}",
         i is not None, i or 0) for i, u, _ in rows)
    sizes = {r["range"]: r["count"] for r in index.groupBy("range").count().collect()}
    assert max(sizes.values()) < 1000 and len(sizes) > 3
    assert warc.read(index).count() == len(rows)


@pytest.mark.parametrize("values", [
    [5], [7] * 4096, list(range(4096)), [0, 2**32 - 1], [2**32 - 1] * 3,
    [3] * 3900 + [2**31 + i for i in range(196)], [0] * 4000 + [1] * 96])
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    assert (tokens.decode_block(tokens.encode_block(ids)) == ids).all()


def test_a_rare_large_id_costs_an_exception_not_a_wider_block():
    ids = np.full(4096, 9, np.uint32)
    ids[::2] = 8
    ids[100] = 49000
    assert len(tokens.encode_block(ids)) < 4096 // 8 + 40


def expected_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer())
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_ids_of_odd_texts(spark):
    odd = ["", None, "  ", "a", "Don't STOP\n\nnow", "é é", "áb ́c", "tab\tnl\r\nx y z",
           "x\x0by\x0cz\x1cq\x85w", "<|endoftext|> <|startoftext|>a", "ΣΑΣ ΣΑΣ", "12345 3.14",
           "😀 😀👍", "a~b ~ c~ x", "<|ENDOFTEXT|>", "\x00 a\x00b", "İstanbul ǅ", "long " * 30000, "w" * 5000]
    rows = list(enumerate(odd)) + [(5, "again"), (None, "none")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = tokens.write(frame.repartition(5), word_tokenizer())
    got = tokens.read(manifest).collect()
    want = sorted(((i is not None, i or 0, t or ""), ids)
                  for (i, t), ids in zip(rows, expected_ids(t for _, t in rows)))
    start = 0
    got = sorted(got, key=lambda r: r.start)
    for r, ((known, key, _), ids) in zip(got, want, strict=True):
        assert (r.key, r.start, r.n_ids) == (key if known else None, start, len(ids))
        assert r.crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    uri = manifest.orderBy("part").first()["uri"]
    reader = tokens.IdReader(uri)
    everything = list(reader.rows())
    assert all((a == b).all() for a, b in zip(reader.rows(3), everything[3:]))
    assert tokens.write(frame.limit(0), word_tokenizer()).count() == 0


def test_ids_of_the_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    got = QUERIES["op8_token_ids"](spark, data).orderBy("doc_id").collect()
    ids = expected_ids(d.text for d in docs)
    starts = np.r_[0, np.cumsum([len(x) for x in ids])]
    assert [tuple(r) for r in got] == [
        (d.doc_id, int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        for d, s, x in zip(docs, starts, ids)]


def brute_passages(docs, items):
    split = lambda t: [w for w in re.split(
        r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    out = []
    for doc_id, text in docs:
        words, hit, names = split(text), set(), set()
        for item_id, body in items:
            mine = split(body)
            size = min(13, len(mine))
            for s in range(len(mine) - size + 1 if mine else 0):
                for p in range(len(words) - size + 1):
                    if words[p:p + size] == mine[s:s + size]:
                        hit |= set(range(p, p + size))
                        if item_id is not None:
                            names.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(names), digest,
                    len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shipped", [True, False])
def test_passages_of_odd_texts(spark, monkeypatch, shipped):
    if not shipped:
        monkeypatch.setattr(decontaminate, "is_small", lambda *_: False)
    rng = random.Random(4)
    vocabulary = ["a", "b", "é", "c9", "d"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, text(20)), (2, text(13)), (3, "a B"), (4, text(3)), (10, None), (11, "--"),
             (2, "a b c9 d e f g h i j k l m n o p"), (None, "x1 x2 x3 x4 x5"), (12, "a b a b " * 9)]
    docs = [(i, text(rng.randint(0, 60)) + "; " + rng.choice(items)[1].__str__()) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "A"), (7, "again x1-x2_x3 X4 x5"), (None, items[0][1]),
             (103, "a b " * 300)]
    frames = (spark.createDataFrame(docs, "doc_id long, text string"),
              spark.createDataFrame(items, "item_id long, text string"))
    got = decontaminate.verdicts(*decontaminate.hits(*frames)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_passages(docs, items)


def test_a_long_item_is_not_copied_with_each_shingle(spark):
    long = [f"w{i}" for i in range(20000)]
    items = spark.createDataFrame([(1, " ".join(long)), (2, "a b c")], "item_id long, text string")
    listed = decontaminate.item_shingles(items, "item_id", "text", 13, 4)
    held = sum(len(v) for r in listed.collect() for v in r if isinstance(v, list))
    assert held < 26 * 20003
    docs = spark.createDataFrame(
        [(1, "x " + " ".join(long[9000:9030]) + " y"), (2, " ".join(long[-13:])),
         (3, " ".join(long[:12])), (4, "q a b c")], "doc_id long, text string")
    got = decontaminate.verdicts(*decontaminate.hits(docs, items)).collect()
    assert sorted((r.doc_id, r.n_hit, r.n_items) for r in got) == [
        (1, 30, 1), (2, 13, 1), (3, 0, 0), (4, 3, 1)]


def test_no_benchmark_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.verdicts(*decontaminate.hits(docs, items)).collect()
    assert [(r.doc_id, r.n_words, r.contaminated) for r in got] == [(1, 2, False)]
    assert decontaminate.verdicts(*decontaminate.hits(docs.limit(0), items)).count() == 0
