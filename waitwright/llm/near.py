"""Near duplicates: MinHash bands propose, odd sketches sift, whole texts decide.

Texts are linked when 100 * |A & B| >= threshold * |A | B| over their sets of word shingles.

1. One scan gives each row its set size, a 128-bit fingerprint of the set, the keys of 32 bands of
   4 MinHash values, and an odd sketch: the 512 smallest shingle numbers (a MinHash sample; the
   whole set if it is smaller) folded into 1024 parity bits.
2. Rows with equal sets collapse to one, the smallest id.
3. Rows of a band bucket are compared with the bucket's smallest row: one pair per row and bucket.
   The population count of two sketches' XOR never exceeds the samples' symmetric difference, so
   a count beyond what the threshold allows rules a pair out (for samples of larger sets with a
   margin of six standard deviations). Pairs left are decided on the words of both texts.
4. Components of these links are found. Buckets whose rows fell into several components are gone
   through once more, block by block: all their pairs across components meet the sketch test, each
   pair in the first bucket it shares, and the survivors are decided on the words.
5. Components of all links.

So every pair that shares a bucket is linked, ruled out, or already in one component. At
similarity 0.8 a pair shares no bucket with a chance of (1 - 0.8^4)^32, 5 in 10^8.

Defined cases: a null text and a text without words have no shingles and link with nothing; a text
with fewer words than a shingle is one shingle; rows that repeat an id, with equal or different
texts, are one node that holds all their sets, and each of them reports it; rows with a null id link with nothing, have no component and are kept; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitwright.lineage import broadcast_if_small, cut
from waitwright.llm.components import components
from waitwright.llm.words import SPACED, Words, mix, pieces, shingles

BANDS = 32
ROWS = 4
BITS = 1024
SAMPLE = 512
MARGIN = 6.0          # standard deviations a sampled sketch may be off
BLOCK = 2048          # rows of a block when a bucket is gone through pair by pair
STRIP = 64            # rows compared with a whole block at once
_random = np.random.default_rng(606)
FACTORS = _random.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
SIGNATURE = ("key long, t long, n int, print_a long, print_b long, bands array<long>, sketch binary")
PAIR = ["a", "t_a", "b", "t_b"]
PAIR_TYPE = "a long, t_a long, b long, t_b long"


def distinct_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle numbers of each row, joined, and the first of each row."""
    values, firsts = shingles(words, size)
    sets = [np.unique(values[a:b]) for a, b in zip(firsts[:-1], firsts[1:])]
    counts = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else values), np.r_[0, np.cumsum(counts)]


def band_keys(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Keys of each non-empty set's bands, a row of ``BANDS`` numbers per set."""
    base = (mix(values) >> np.uint64(32)).astype(np.uint32)
    lowest = np.empty((BANDS * ROWS, len(firsts)), np.uint64)
    for k in range(BANDS * ROWS):
        lowest[k] = np.minimum.reduceat(base * FACTORS[k] + SHIFTS[k], firsts)
    keys = np.empty((len(firsts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(firsts), band + 1, np.uint64)
        for k in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + lowest[band * ROWS + k])
        keys[:, band] = key
    return keys


def odd_sketches(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Parity bitmaps, 128 bytes a set, of the SAMPLE smallest numbers of each sorted set."""
    counts = np.diff(np.r_[firsts, len(values)])
    rank = np.arange(len(values)) - np.repeat(firsts, counts)
    owner = np.repeat(np.arange(len(firsts)), counts)[rank < SAMPLE]
    bit = (mix(values[rank < SAMPLE]) >> np.uint64(54)).astype(np.int64)
    odd = np.bincount(owner * BITS + bit, minlength=len(firsts) * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, BITS), axis=1)


def most_odd(n_a, n_b, threshold: int):
    """Largest population count of an XOR that a pair above the threshold can show."""
    together = n_a + n_b
    shared = together * (threshold / (100.0 + threshold))
    exact = together - 2.0 * np.ceil(shared - 1e-9)
    share = np.minimum(1.0, shared / np.maximum(n_a, n_b))
    s_a, s_b = np.minimum(n_a, SAMPLE), np.minimum(n_b, SAMPLE)
    small = np.minimum(s_a, s_b)
    common = small * share - MARGIN * np.sqrt(small * share * (1 - share) + 1.0)
    sampled = s_a + s_b - 2.0 * np.maximum(common, 0)
    return np.where(np.maximum(n_a, n_b) <= SAMPLE, exact, sampled)


def texts_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, t, text: an id may come with several texts, which t tells apart."""
    return df.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("t"),
                     F.col(text).alias("text"))


def signatures(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("t", pa.int64()), ("n", pa.int32()), ("print_a", pa.int64()),
                        ("print_b", pa.int64()), ("bands", pa.list_(pa.int64())),
                        ("sketch", pa.binary())])

    def task(batches):
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                words = Words(piece.column("text"), SPACED)
                values, firsts = distinct_sets(words, size)
                counts = np.diff(firsts)
                filled = np.flatnonzero(counts)
                starts = firsts[:-1][filled]
                prints = np.zeros((2, len(counts)), np.uint64)
                offsets = np.zeros(len(counts) + 1, np.int32)
                sketches = [None] * len(counts)
                bands = np.zeros(0, np.int64)
                if len(filled):
                    for k in (0, 1):
                        prints[k, filled] = np.add.reduceat(
                            mix(values + np.uint64(2 * k + 1)), starts)
                    bands = band_keys(values, starts).view(np.int64).ravel()
                    offsets[1:] = np.cumsum(np.where(counts > 0, BANDS, 0))
                    for row, bits in zip(filled, odd_sketches(values, starts)):
                        sketches[row] = bits.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [piece.column("key"), piece.column("t"), pa.array(counts.astype(np.int32)),
                     pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands)),
                     pa.array(sketches, pa.binary())], schema=schema)

    return texts_of(df, key, text).mapInArrow(task, SIGNATURE)


def popcount(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def bitmaps(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def sift(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, t_a, b, t_b) that the odd sketches cannot rule out."""
    thin = nodes.select("key", "t", "n", "sketch")
    named = lambda side: thin.select(F.col("key").alias(side), F.col("t").alias(f"t_{side}"),
                                     *(F.col(c).alias(f"{c}_{side}") for c in ("n", "sketch")))
    both = (pairs.join(named("a"), ["a", "t_a"]).join(named("b"), ["b", "t_b"])
            # Sizes alone rule out many: the smaller set is at least the threshold of the larger.
            .filter(100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
            .select(*PAIR, "n_a", "n_b", "sketch_a", "sketch_b"))

    def task(batches):
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            odd = popcount(bitmaps(batch.column("sketch_a")), bitmaps(batch.column("sketch_b"))) \
                if batch.num_rows else np.zeros(0)
            yield batch.select(PAIR).filter(pa.array(odd <= most_odd(n_a, n_b, threshold)))

    return both.mapInArrow(task, PAIR_TYPE)


def confirm(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """Pairs (a, b) with full shingle sets that reach the threshold, decided on the words."""
    ids = cut(pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("key"), F.col("t_a").alias("t")),
        F.struct(F.col("b").alias("key"), F.col("t_b").alias("t")))).alias("i"))
        .select("i.*").distinct())
    wanted = cut(texts.join(broadcast_if_small(ids), ["key", "t"], "left_semi")
                 .groupBy("key", "t").agg(F.min("text").alias("text")))
    named = lambda side: wanted.select(F.col("key").alias(side), F.col("t").alias(f"t_{side}"),
                                       F.col("text").alias(f"text_{side}"))
    both = (pairs.join(named("a"), ["a", "t_a"]).join(named("b"), ["b", "t_b"])
            .select(*PAIR, "text_a", "text_b"))

    def shingle_set(words: Words, row: int) -> set:
        mine = [words.data[s:e].tobytes() for s, e in zip(
            words.starts[words.rows[row]:words.rows[row + 1]],
            words.ends[words.rows[row]:words.rows[row + 1]])]
        if 0 < len(mine) < size:
            return {tuple(mine)}
        return set(zip(*(mine[k:] for k in range(size))))

    def task(batches):
        for batch in batches:
            for piece in pieces(batch, "text_a", 1 << 20):
                left = Words(piece.column("text_a"), SPACED)
                right = Words(piece.column("text_b"), SPACED)
                keep, last, held = [], None, set()
                for i, a in enumerate(zip(piece.column("a").to_pylist(),
                                          piece.column("t_a").to_pylist())):
                    if a != last:
                        last, held = a, shingle_set(left, i)
                    other = shingle_set(right, i)
                    shared = len(held & other)
                    keep.append(shared > 0 and
                                100 * shared >= threshold * (len(held) + len(other) - shared))
                yield piece.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(task, "a long, b long")


def across(members: DataFrame, threshold: int, band_count: int = BANDS) -> DataFrame:
    """Pairs of a bucket in different components that pass the sketch test, block by block.

    members: bucket, rows (in the bucket), key, t, component, n, bands, sketch.
    """
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("key"), blocks).cast("int")
    dealt = (members.withColumn("block", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .withColumn("low", F.least("block", "other"))
             .withColumn("high", F.greatest("block", "other")))

    def compare(table: pa.Table) -> pa.Table:
        out = []
        key, t, part = (
            table.column(c).to_numpy() for c in ("key", "t", "component"))
        n = table.column("n").to_numpy().astype(float)
        bucket = table.column("bucket")[0].as_py()
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, band_count)
        first = (bands == bucket).argmax(axis=1)  # the same band in every row
        bits = bitmaps(table.column("sketch"))
        block = table.column("block").to_numpy()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        rows, columns = np.flatnonzero(block == low), np.flatnonzero(block == high)
        for at in range(0, len(rows), STRIP):
            mine = rows[at:at + STRIP]
            open_ = (part[mine, None] != part[columns]) & (
                (key[mine, None] < key[columns]) if low == high else True)
            i, j = np.nonzero(open_)
            i, j = mine[i], columns[j]
            fits = 100 * np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])
            i, j = i[fits], j[fits]
            for c in range(0, len(i), 1 << 16):
                x, y = i[c:c + (1 << 16)], j[c:c + (1 << 16)]
                near = popcount(bits[x], bits[y]) <= most_odd(n[x], n[y], threshold)
                x, y = x[near], y[near]
                shared = (bands[x] == bands[y]).argmax(axis=1)
                x, y = x[shared == first[x]], y[shared == first[x]]
                x, y = np.where(key[x] < key[y], x, y), np.where(key[x] < key[y], y, x)
                out.append((key[x], t[x], key[y], t[y]))
        columns = zip(*out) if out else [[np.zeros(0, np.int64)]] * 4
        return pa.table(dict(zip(PAIR, map(np.concatenate, columns))))

    return dealt.groupBy("bucket", "low", "high").applyInArrow(compare, PAIR_TYPE)


def several_sets(signed: DataFrame) -> DataFrame:
    """Ids whose rows have different sets."""
    prints = F.struct("print_a", "print_b", "n")
    return (signed.filter("key is not null").groupBy("key")
            .agg(F.min(prints).alias("least"), F.max(prints).alias("most"))
            .filter("least <> most").select("key"))


def same_id(signed: DataFrame, several: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between such an id and the nodes of its sets."""
    sets = signed.filter("n > 0").join(broadcast_if_small(several), "key", "left_semi")
    return (sets.select(F.col("key").alias("a"), "print_a", "print_b", "n").distinct()
            .join(nodes.select("print_a", "print_b", "n", F.col("key").alias("b")),
                  ["print_a", "print_b", "n"]).filter("a <> b").select("a", "b"))


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5,
            threshold: int = 80) -> DataFrame:
    """One row per input row: key, n_shingles, set_id (smallest id with the same set),
    component_id (smallest id reachable), kept (whether it is that id)."""
    signed = cut(signatures(df, key, text, size))
    texts = texts_of(df, key, text)
    usable = signed.filter("n > 0 and key is not null")
    # Equal sets: one node. Copies shrink before the shuffle.
    nodes = cut(usable.groupBy("print_a", "print_b", "n").agg(
        F.min(F.struct("key", "t", "bands", "sketch")).alias("least"))
        .select("print_a", "print_b", "n", "least.*"))
    listed = nodes.select("key", "t", F.explode("bands").alias("bucket"))
    shared = cut(listed.groupBy("bucket").agg(
        F.count("*").alias("rows"), F.min(F.struct("key", "t")).alias("pivot"))
        .filter("rows > 1").select("bucket", "rows", F.col("pivot.key").alias("a"),
                                   F.col("pivot.t").alias("t_a")))
    members = cut(listed.join(broadcast_if_small(shared), "bucket"))
    stars = cut(sift(members.filter("key <> a").select(
        "a", "t_a", F.col("key").alias("b"), F.col("t").alias("t_b")).distinct(),
        nodes, threshold))
    several = cut(several_sets(signed))
    own = cut(same_id(signed, several, nodes))
    links = cut(confirm(stars, texts, size, threshold)).unionByName(own)
    parts = components(links)
    placed = members.join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key"))
    split = placed.groupBy("bucket").agg(
        F.min("component").alias("first"), F.max("component").alias("last"),
        F.max("rows").alias("size")).filter("first <> last and size > 2").select("bucket")
    torn = cut(placed.join(broadcast_if_small(cut(split)), "bucket").select(
        "bucket", "rows", "key", "t", "component"))
    wide = torn.join(nodes.select("key", "t", "n", "bands", "sketch"), ["key", "t"])
    rest = cut(across(wide, threshold).distinct().join(stars, PAIR, "left_anti"))
    if not rest.isEmpty():
        links = links.unionByName(cut(confirm(rest, texts, size, threshold)))
        parts = components(links)
    named = nodes.select("print_a", "print_b", "n", F.col("key").alias("set_id"))
    smallest = (named.join(parts, F.col("set_id") == F.col("node"), "left")
                .select("print_a", "print_b", "n", "set_id",
                        F.coalesce("component", "set_id").alias("component_id")))
    rows = signed.select("key", "n", "print_a", "print_b").join(
        smallest, ["print_a", "print_b", "n"], "left")
    if not several.isEmpty():  # texts without words share the fate of their id
        ids = parts.select(F.col("node").alias("key"), F.col("component").alias("_own"))
        bare = rows.filter("n = 0").join(ids, "key", "left").withColumn(
            "component_id", F.col("_own")).drop("_own")
        rows = rows.filter("n > 0").unionByName(bare)
    return rows.select(
        F.col("key").alias(key), F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("key").isNotNull(), F.coalesce("set_id", "key")).alias("set_id"),
        F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key")).alias("component_id")
    ).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
