"""Passages of 200 bytes that start anywhere else, by a logarithmic family of suffix arrays.

Every 200-byte window has an anchor: the start, within it, of its 100-byte gram with the smallest
number (the leftmost of equals). Equal windows have their anchor at the same place, so suffixes need
to be indexed at anchors only, about one byte in fifty.

1. One scan gives the anchors of each text. Windows with one anchor are a cell: a stretch of starts,
   known by a number for the bytes its windows cover.
2. A batch of texts gets a suffix array: its anchored suffixes in the order of their grams' numbers
   (equal beginnings are neighbours in that order too, and no letter fills a task). The array is
   merge-scanned against each level of the family: suffixes that share a gram are matches of 100
   bytes or more. Then it becomes a level; levels of equal size merge, so n batches leave about
   log2(n) levels and each suffix is rewritten that often.
3. Matches are lengthened. Cells whose bytes come twice are repeated as a whole. Cells that match in
   the gram only are compared window by window, with one example of each rival cell.
4. Spans of a text are merged and cut out.

A window repeats exactly if another one with its anchor has the same bytes, so 3. is complete. Numbers
have 64 bits and are compared within a gram, which has 64 bits of its own.

No step sends all suffixes of a gram to one task: grams, cells and windows are counted with partial
sums, and joined apart where one holds many rows. Cells that repeat within one block of a text are
settled there, so monotonous texts stay small.

Defined cases: a null text is empty; texts of fewer than 200 bytes are kept whole; rows are told
apart by key and text, and rows that repeat both count as two texts; null keys are allowed; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitwright.lineage import cut
from waitwright.llm.words import BYTE_VALUES, FACTOR, INVERSE, flat, mix, pieces, powers
from waitwright.skew import join_unique

LENGTH = 200
GRAM = 100
BATCHES = 4
BLOCK = 1 << 19       # window starts looked at together
#: Cells of a gram that are compared in one task (16 MB at most); of more, window by window.
MOST_CELLS = 20_000
PLACE = np.uint64((1 << 20) - 1)
_random = np.random.default_rng(1313)
OTHER_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
UP, DOWN = powers(FACTOR, BLOCK + LENGTH), powers(INVERSE, BLOCK + LENGTH)
CELL = ("d1", "d2", "start", "stop", "gram", "cell")
WINDOWS = ["d1", "d2", "start", "gram", "windows"]
SPAN = "d1 long, d2 long, start long, stop long"


def sums(values: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Running sums from which ``numbers`` reads the number of any range."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * UP[:len(data)], out=out[1:])
    return out


def numbers(running: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return mix((running[stops] - running[starts]) * DOWN[starts])


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    out, reach = values, 1
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[:len(out) - rest], out[rest:])


def union(start: np.ndarray, stop: np.ndarray, owner: np.ndarray):
    """Disjoint spans of each owner; spans come in the order of owner and start.

    Returns the place of each span's first part, and the stops.
    """
    if not len(start):
        return np.zeros(0, np.int64), stop
    shift = owner * (int(stop.max()) + 1)  # owners side by side on one line
    reach = np.maximum.accumulate(stop + shift)
    first = np.flatnonzero(np.r_[True, (start + shift)[1:] > reach[:-1]])
    last = np.r_[first[1:], len(start)] - 1
    return first, (reach - shift)[last]


def cells(data: np.ndarray):
    """(start, stop, gram, cell) of the cells of a block, and (start, stop) settled within it.

    ``stop`` ends the bytes that the cell's windows cover. Of cells that come more than twice two
    are returned; the others are certain to repeat and become spans.
    """
    running = sums(BYTE_VALUES, data)
    at = np.arange(len(data) - GRAM + 1)
    gram = numbers(running, at, at + GRAM)
    anchor = (lowest((gram & ~PLACE) | at.astype(np.uint64), LENGTH - GRAM + 1)
              & PLACE).astype(np.int64)
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    stop = np.r_[start[1:], len(anchor)] - 1 + LENGTH
    gram = gram[anchor[start]]
    cell = numbers(sums(OTHER_VALUES, data), start, stop)
    order = np.lexsort((start, cell, gram))
    same = (gram[order][1:] == gram[order][:-1]) & (cell[order][1:] == cell[order][:-1])
    more = np.zeros(len(start), bool)
    more[order[2:]] = same[1:] & same[:-1]
    first, stops = union(start[more], stop[more], np.zeros(int(more.sum()), np.int64))
    return (start[~more], stop[~more], gram[~more].view(np.int64), cell[~more].view(np.int64),
            start[more][first], stops)


def identified(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, and d1, d2: the row's number by key and text."""
    body, name = F.coalesce(F.col(text), F.lit("")), F.col(key).cast("string")
    return df.select(F.col(key).alias("key"), body.alias("text"),
                     F.xxhash64(name, body).alias("d1"),
                     F.xxhash64(F.lit(1), body, name, F.lit(2)).alias("d2"))


def anchors(rows: DataFrame) -> DataFrame:
    """Cells of all texts (d1, d2, start, stop, gram, cell); without a gram: settled spans."""
    def task(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, offsets = flat(piece.column("text"))
                row, found, known = [], [], []
                for i in range(len(offsets) - 1):
                    own = data[offsets[i]:offsets[i + 1]]
                    for first in range(0, len(own) - LENGTH + 1, BLOCK):
                        start, stop, gram, cell, s, e = cells(own[first:first + BLOCK + LENGTH - 1])
                        blank = np.zeros(len(s), np.int64)
                        row.append(np.full(len(start) + len(s), i))
                        found.append((np.r_[start, s] + first, np.r_[stop, e] + first,
                                      np.r_[gram, blank], np.r_[cell, blank]))
                        known.append(np.r_[np.zeros(len(start), bool), blank == 0])
                if row:
                    row, known = np.concatenate(row), np.concatenate(known)
                    start, stop, gram, cell = map(np.concatenate, zip(*found))
                    d1, d2 = (piece.column(c).to_numpy()[row] for c in ("d1", "d2"))
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, (d1, d2, start, stop)), pa.array(gram, mask=known),
                         pa.array(cell, mask=known)], names=CELL)

    return rows.select("d1", "d2", "text").mapInArrow(
        task, ", ".join(f"{name} long" for name in CELL))


class Family:
    """Suffix arrays of batches in levels of doubling size, each a written table of sorted grams."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Index the suffixes (gram) of a batch; grams among them that come twice so far."""
        self._merge()
        counted = cut(suffixes.groupBy("gram").agg((F.count("*") > 1).alias("again"))
                      .sortWithinPartitions("gram"))
        array = counted.select("gram")
        matches = counted.filter("again").select("gram")
        for _, level in self.levels:
            matches = matches.unionByName(array.hint("merge").join(level, "gram", "left_semi"))
        self.levels.append((1, array))
        return cut(matches.distinct())

    def _merge(self) -> None:
        """Merge levels of equal size until sizes are distinct powers of two."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, newer), (_, older) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, cut(
                older.unionByName(newer).distinct().sortWithinPartitions("gram"))))


def close(spans: DataFrame) -> DataFrame:
    """Neighbouring spans of a row joined as far as a batch of a task shows them."""
    def task(batches):
        for batch in batches:
            d1, d2, start, stop = (batch.column(c).to_numpy() for c in CELL[:4])
            order = np.lexsort((start, d2, d1))
            d1, d2, start, stop = d1[order], d2[order], start[order], stop[order]
            owner = np.cumsum(np.r_[0, (np.diff(d1) != 0) | (np.diff(d2) != 0)])[:len(d1)]
            first, stops = union(start, stop, owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a) for a in (d1[first], d2[first], start[first], stops)],
                names=CELL[:4])

    return spans.select(*CELL[:4]).mapInArrow(task, SPAN)


def windows(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(d1, d2, start, gram, windows): the numbers of all windows of the cells asked for.

    asked: d1, d2, cells (start, stop, gram); ``windows`` packs eight bytes per window.
    """
    def task(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, offsets = flat(piece.column("text"))
                out = []
                for i, (d1, d2, wanted) in enumerate(zip(*(
                        piece.column(c).to_pylist() for c in ("d1", "d2", "cells")))):
                    own = data[offsets[i]:offsets[i + 1]]
                    for cell in wanted:
                        part = own[cell["start"]:cell["stop"]]
                        at = np.arange(len(part) - LENGTH + 1)
                        packed = numbers(sums(OTHER_VALUES, part), at, at + LENGTH).tobytes()
                        out.append((d1, d2, cell["start"], cell["gram"], packed))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in zip(*out)], names=WINDOWS)

    wide = join_unique(rows.select("d1", "d2", "text"), asked, ["d1", "d2"], "inner")
    return wide.mapInArrow(task, "d1 long, d2 long, start long, gram long, windows binary")


def unpacked(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and number of each window of packed cells."""
    packed = batch.column("windows").to_pylist()
    counts = np.array([len(p) // 8 for p in packed], np.int64)
    row = np.repeat(np.arange(len(packed)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, batch.column("start").to_numpy()[row] + nth, np.frombuffer(b"".join(packed), np.int64)


def shared(packed: DataFrame) -> DataFrame:
    """Spans (d1, d2, start, stop) of windows that another cell of their gram has too.

    The cells of a gram come one after the other in a task, unless there are many: those are taken
    apart into windows, which are counted with partial sums.
    """
    many = cut(packed.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_CELLS)
               .select("gram"))

    def judged(table: pa.Table) -> pa.RecordBatch:
        row, start, number = unpacked(table)
        gram = table.column("gram").to_numpy()[row]
        order = np.lexsort((number, gram))
        same = (gram[order][1:] == gram[order][:-1]) & (number[order][1:] == number[order][:-1])
        twice = np.zeros(len(row), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        row, start = row[twice], start[twice]
        first, stops = union(start, start + LENGTH, row)
        d1, d2 = (table.column(c).to_numpy()[row[first]] for c in ("d1", "d2"))
        return pa.RecordBatch.from_arrays([pa.array(a) for a in (d1, d2, start[first], stops)],
                                          names=CELL[:4])

    def by_gram(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            gram = table.column("gram").to_numpy()
            open_ = int(np.flatnonzero(gram == gram[-1])[0])  # this gram may go on
            yield judged(table.slice(0, open_))
            held = table.slice(open_)
        if held is not None:
            yield judged(held)

    def singly(batches):
        for batch in batches:
            row, start, number = unpacked(batch)
            named = [batch.column(c).to_numpy()[row] for c in ("d1", "d2", "gram")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a) for a in (*named, start, number)],
                names=["d1", "d2", "gram", "start", "number"])

    few = packed.join(F.broadcast(many), "gram", "left_anti")
    met = few.repartition("gram").sortWithinPartitions("gram").select(*WINDOWS).mapInArrow(
        by_gram, SPAN)
    if many.isEmpty():
        return met
    single = cut(packed.join(F.broadcast(many), "gram", "left_semi").select(*WINDOWS).mapInArrow(
        singly, "d1 long, d2 long, gram long, start long, number long"))
    twice = cut(single.groupBy("gram", "number").agg(F.count("*").alias("n")).filter("n > 1")
                .select("gram", "number"))
    return met.unionByName(join_unique(single, twice, ["gram", "number"], "left_semi").select(
        "d1", "d2", "start", (F.col("start") + LENGTH).alias("stop")))


def spans(rows: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(d1, d2, start, stop): bytes of the rows that a repeated window covers, in parts."""
    found = cut(anchors(rows))
    indexed = found.filter("gram is not null")
    family, matches = Family(), None
    for number in range(batches):
        batch = indexed.filter(F.pmod("d1", F.lit(batches)) == number).select("gram")
        more = family.add(batch)
        matches = more if matches is None else matches.unionByName(more)
    matched = cut(join_unique(indexed, cut(matches.distinct()), ["gram"], "left_semi"))
    classes = cut(matched.groupBy("gram", "cell").agg(
        F.count("*").alias("n"), F.min(F.struct("d1", "d2", "start", "stop")).alias("at")))
    whole = cut(classes.filter("n > 1").select("gram", "cell"))
    repeated = join_unique(matched, whole, ["gram", "cell"], "left_semi")
    alone = classes.filter("n = 1")
    rivals = join_unique(classes.filter("n > 1"), cut(alone.select("gram").distinct()), ["gram"],
                         "left_semi")
    asked = cut(alone.select("gram", "at.*").unionByName(rivals.select("gram", "at.*"))
                .groupBy("d1", "d2").agg(F.collect_list(F.struct("start", "stop", "gram"))
                                         .alias("cells")))
    parts = shared(cut(windows(rows, asked)))
    return close(repeated.select(*CELL[:4]).unionByName(
        found.filter("gram is null").select(*CELL[:4])).unionByName(parts))


def remove(df: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES
           ) -> DataFrame:
    """Per row: key, n_bytes, removed (start, stop of each maximal run), kept (bytes left)."""
    rows = identified(df, key, text)
    kind = df.schema[key].dataType.simpleString()
    per_row = cut(spans(rows, batches).groupBy("d1", "d2").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans")))

    def task(source):
        for batch in source:
            for piece in pieces(batch, "text"):
                data, offsets = flat(piece.column("text"))
                counts, lows, highs, kept = [0], [], [], []
                for i, found in enumerate(piece.column("spans").to_pylist()):
                    own = data[offsets[i]:offsets[i + 1]]
                    if found:
                        start, stop = np.array(
                            sorted((s["start"], s["stop"]) for s in found), np.int64).T
                        first, stops = union(start, stop, np.zeros(len(start), np.int64))
                        stays = np.ones(len(own), bool)
                        for a, b in zip(start[first], stops):
                            stays[a:b] = False
                        lows.append(start[first])
                        highs.append(stops)
                        own = own[stays]
                    counts.append(len(first) if found else 0)
                    kept.append(own.tobytes())
                blank = [np.zeros(0, np.int64)]
                runs = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate(blank + lows)), pa.array(np.concatenate(blank + highs))],
                    ["start", "stop"])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("key"), pa.array(np.diff(offsets)),
                     pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), runs),
                     pa.array(kept, pa.binary())], names=["key", "n_bytes", "removed", "kept"])

    return join_unique(rows, per_row, ["d1", "d2"], "left").select("key", "text", "spans").mapInArrow(
        task, f"key {kind}, n_bytes long, removed array<struct<start:bigint,stop:bigint>>, "
              "kept binary").withColumnRenamed("key", key)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of the results of ``remove``."""
    gone = F.aggregate("removed", F.lit(0).cast("bigint"),
                       lambda total, r: total + r["stop"] - r["start"])
    return found.select(key, "n_bytes", gone.alias("n_removed"),
                        F.size("removed").cast("bigint").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
