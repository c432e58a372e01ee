"""Passages of a benchmark inside documents: prefix-filtered set join, verified word by word.

A window is 13 consecutive words of an item (a shorter item is one window). Its shingles are its
runs of 4 words (fewer if the item has fewer). Containment must be complete, so one shingle is a
necessary prefix: the rarest one over all documents. Windows of an item that share their rarest
shingle at the same place make one segment. Documents meet segments on that shingle only; length
and position bounds drop segments that cannot fit around it, and the words are compared exactly.

Steps: count how often each benchmark shingle occurs in the documents (one scan), choose prefixes,
find the documents' prefix shingles (second scan), join, verify, and unite the hit ranges.

The set of benchmark shingles is given to tasks only while it is small (measured); beyond that
every shingle of every document is joined by shuffle instead.

Defined cases: null or empty texts have no words; a null item id hits but is not listed; rows that
repeat an id are counted one by one; repeated items count once per id; an empty benchmark leaves
every document clean; other columns stay out of the way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waitwright.lineage import cut, is_small
from waitwright.llm.words import ALNUM, Words, pieces, shingles

WINDOW = 13
SHINGLE = 4
AROUND = WINDOW - 1
SHIPPED_BYTES = 32 << 20
ROWS = 1 << 13  # shingles of a record batch, each with its own few words


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def item_shingles(items: DataFrame, key: str, text: str, window: int, size: int) -> DataFrame:
    """(item, copy, total, near, here, at, size, shingle): every shingle of every item.

    ``copy`` numbers the items, ``total`` counts the item's words, ``at`` is the shingle's first
    word. ``near`` are the words of all windows around the shingle, which is at ``here`` in them.
    """
    around = window - 1

    def task(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = Words(piece.column("text"), ALNUM)
                for k in sorted({min(int(n), size) for n in words.counts if n}):
                    values, firsts = shingles(words, k, whole_when_shorter=False)
                    chosen = np.flatnonzero(np.minimum(words.counts, size) == k)
                    runs = firsts[chosen + 1] - firsts[chosen]
                    owner = np.repeat(chosen, runs)
                    at = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
                    for a in range(0, len(owner), ROWS):
                        row, place = owner[a:a + ROWS], at[a:a + ROWS]
                        first = words.rows[row] + place
                        low = np.maximum(first - around, words.rows[row])
                        high = np.minimum(first + around + 1, words.rows[row + 1])
                        here = pa.array(row)
                        yield pa.RecordBatch.from_arrays([
                            piece.column("item").take(here), piece.column("copy").take(here),
                            pa.array(words.counts[row].astype(np.int64)),
                            pa.array([[words.text(w) for w in range(x, y)]
                                      for x, y in zip(low, high)], pa.list_(pa.string())),
                            pa.array((first - low).astype(np.int32)),
                            pa.array(place.astype(np.int64)),
                            pa.array(np.full(len(row), k, np.int32)),
                            _long(values[firsts[row] + place])], schema=arrow)

    arrow = pa.schema([("item", pa.int64()), ("copy", pa.int64()), ("total", pa.int64()),
                       ("near", pa.list_(pa.string())), ("here", pa.int32()), ("at", pa.int64()),
                       ("size", pa.int32()), ("shingle", pa.int64())])
    return items.select(F.col(key).alias("item"), F.col(text).alias("text")).distinct().withColumn(
        "copy", F.monotonically_increasing_id()).mapInArrow(
        task, "item long, copy long, total long, near array<string>, here int, at long, size int, "
              "shingle long")


def segments(listed: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(item, shingle, size, span, at, high, item_words): the rarest shingle of some windows.

    ``item_words`` are the words of these windows, ``at`` the shingle's place among them, and
    ``high`` the last start of such a window, both counted from the first.
    """
    weighed = listed.drop("near", "here", "item").join(counts, ["shingle", "size"], "left").select(
        "copy", "total", "at", "size", "shingle", F.coalesce("n", F.lit(0)).alias("n"))
    span = F.least(F.lit(window).cast("long"), F.col("total"))
    starts = F.sequence(F.greatest(F.lit(0).cast("long"), F.col("at") + F.col("size") - span),
                        F.least(F.col("at"), F.col("total") - span))
    rarest = weighed.select("*", span.alias("span"), F.explode(starts).alias("start")).groupBy(
        "copy", "span", "start").agg(F.min(F.struct("n", "shingle", "at", "size")).alias("best"))
    places = rarest.groupBy("copy", "span", F.col("best.at").alias("at")).agg(
        F.min("start").alias("low"), F.max("start").alias("last"))
    first = F.col("low") - F.col("at") + F.col("here")  # of the windows' words, in ``near``
    return places.join(listed.drop("total"), ["copy", "at"]).select(
        "item", "shingle", "size", F.col("span").cast("int").alias("span"),
        (F.col("at") - F.col("low")).cast("int").alias("at"),
        (F.col("last") - F.col("low")).cast("int").alias("high"),
        F.slice("near", (first + 1).cast("int"),
                (F.col("last") - F.col("low") + F.col("span")).cast("int")).alias("item_words"))


def _scan(docs: DataFrame, wanted: dict[int, np.ndarray] | None, sizes: list[int], found):
    """Apply ``found(words, size, shingles, firsts, hit places)`` to each batch of documents."""

    def task(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = Words(piece.column("text"), ALNUM)
                for size in sizes:
                    values, firsts = shingles(words, size, whole_when_shorter=False)
                    values = values.view(np.int64)
                    if wanted is None:
                        hits = np.arange(len(values))
                    else:
                        keys = wanted[size]
                        near = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
                        hits = np.flatnonzero(keys[near] == values)
                    yield from found(piece, words, size, values, firsts, hits)
                yield from found(piece, words, None, None, None, None)

    return task


def _numbers(table: DataFrame, shipped: bool) -> tuple[list[int], dict[int, np.ndarray] | None]:
    sizes = sorted(r["size"] for r in table.select("size").distinct().collect())
    if not shipped:
        return sizes, None
    rows = table.select("size", "shingle").distinct().toPandas()
    return sizes, {s: np.sort(rows["shingle"][rows["size"] == s].to_numpy(np.int64))
                   for s in sizes}


def count_shingles(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """(shingle, size, n): occurrences in all documents of the benchmark's shingles."""
    wanted = listed.select("shingle", "size").distinct()
    sizes, keys = _numbers(wanted, is_small(wanted, SHIPPED_BYTES))

    def found(piece, words, size, values, firsts, hits):
        if size is not None and len(hits):
            distinct, counts = np.unique(values[hits], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(distinct), pa.array(np.full(len(distinct), size, np.int32)),
                 pa.array(counts.astype(np.int64))], names=["shingle", "size", "n"])

    counted = docs.select("text").mapInArrow(
        _scan(docs, keys, sizes, found), "shingle long, size int, n long")
    if keys is None:
        counted = counted.join(wanted, ["shingle", "size"], "left_semi")
    return counted.groupBy("shingle", "size").agg(F.sum("n").alias("n"))


def _matches(batches):
    """Longest agreement of item and document words around the shingle: the hit range."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            mine, theirs, at, here = r["item_words"], r["near"].split(" "), r["at"], r["here"]
            a = 0
            while a < min(at, here) and mine[at - a - 1] == theirs[here - a - 1]:
                a += 1
            b = 0
            while at + b < len(mine) and here + b < len(theirs) and \
                    mine[at + b] == theirs[here + b]:
                b += 1
            first, last = at - a, at + b - r["span"]  # starts of windows that agree in full
            first, last = max(first, 0), min(last, r["high"])
            if b >= r["size"] and first <= last:
                out.append({"row": r["row"], "item": r["item"], "start": r["pos"] - at + first,
                            "end": r["pos"] - at + last + r["span"]})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
            [("row", pa.int64()), ("item", pa.int64()), ("start", pa.int64()),
             ("end", pa.int64())]))


def hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
         item_key: str = "item_id", item_text: str = "text", window: int = WINDOW,
         size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(rows, ranges): every document with its number of words, and hit word ranges by row.

    rows: row, key, n_words; ranges: row, item, start, end (words, end exclusive).
    """
    listed = cut(item_shingles(items, item_key, item_text, window, size))
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    chosen = cut(segments(listed, count_shingles(source, listed), window))
    prefixes = chosen.select("shingle", "size").distinct()
    sizes, keys = _numbers(prefixes, is_small(prefixes, SHIPPED_BYTES))
    around = window - 1

    def found(piece, words, size, values, firsts, hits):
        rows, names = piece.column("row"), piece.column("key")
        if size is None:
            none = pa.nulls(piece.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rows, names, pa.array(words.counts.astype(np.int64)), none, none,
                 pa.nulls(piece.num_rows, pa.int32()), pa.nulls(piece.num_rows, pa.string()),
                 pa.nulls(piece.num_rows, pa.int32())], schema=schema)
        elif len(hits):
            owner = np.searchsorted(firsts, hits, "right") - 1
            pos = hits - firsts[owner]
            first = words.rows[owner] + pos
            low = np.maximum(first - around, words.rows[owner])
            high = np.minimum(first + around + 1, words.rows[owner + 1])
            near = [" ".join(words.text(w) for w in range(a, b)) for a, b in zip(low, high)]
            yield pa.RecordBatch.from_arrays(
                [rows.take(pa.array(owner)), names.take(pa.array(owner)),
                 pa.nulls(len(hits), pa.int64()), pa.array(pos.astype(np.int64)),
                 pa.array(values[hits]), pa.array(np.full(len(hits), size, np.int32)),
                 pa.array(near), pa.array((first - low).astype(np.int32))], schema=schema)

    schema = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()),
                        ("pos", pa.int64()), ("shingle", pa.int64()), ("size", pa.int32()),
                        ("near", pa.string()), ("here", pa.int32())])
    scanned = source.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _scan(source, keys, sizes, found),
        "row long, key long, n_words long, pos long, shingle long, size int, near string, here int")
    if keys is None:
        scanned = scanned.join(prefixes, ["shingle", "size"], "left_semi").unionByName(
            scanned.filter("n_words is not null"))
    scanned = cut(scanned)
    near_words = F.size(F.split("near", " "))
    candidates = (
        scanned.filter("pos is not null").join(chosen, ["shingle", "size"])
        # Position and length: the first or the last window of the segment must fit.
        .filter((F.col("here") >= F.col("at") - F.col("high"))
                & (near_words - F.col("here") >= F.col("span") - F.col("at")))
        .select("row", "pos", "near", "here", "item", "at", "high", "span", "size", "item_words"))
    ranges = candidates.mapInArrow(_matches, "row long, item long, start long, end long")
    return scanned.filter("pos is null").select("row", "key", "n_words"), ranges


def verdicts(rows: DataFrame, ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: words hit, items found, and whether 5 % of its words are hit."""
    earlier = (Window.partitionBy("row").orderBy("start", "end")
               .rowsBetween(Window.unboundedPreceding, -1))
    reached = F.greatest(F.col("start"), F.coalesce(F.max("end").over(earlier), F.lit(0)))
    listed = F.array_sort(F.collect_set(F.col("item").cast("string")))
    per_row = ranges.distinct().withColumn(
        "fresh", F.greatest(F.lit(0), F.col("end") - reached)).groupBy("row").agg(
        F.sum("fresh").alias("n_hit"), listed.alias("names"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    names = F.coalesce("names", F.array().cast("array<string>"))
    return rows.join(per_row, "row", "left").select(
        F.col("key").alias(key), "n_words", n_hit.cast("bigint").alias("n_hit"),
        F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"))
