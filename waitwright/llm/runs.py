"""Periodic runs of words: split by frequency until nothing changes, then scan at lags.

A run is a stretch of words with smallest period q and at least max(6, 4 q) words that no
neighbouring word extends. Each of its words comes at least four times in it. So, per document:

1. Words that come less than four times in their segment (at first: the document) cannot belong to
   a run. They split the segment; pieces shorter than six words go; the others are counted anew,
   until no segment changes.
2. The segments left are scanned, all of a batch together. For lags from L = 2^k to 2L - 1, a run
   with such a period holds a block of 2L words at a multiple of L whose next equal block starts one
   period later, since a block longer than the period cannot come again earlier. Blocks are compared
   by ranks, doubled from level to level; neighbouring blocks with one lag form a stretch, which is
   scanned on word by word to both sides, at most L words each. A level costs one sort, and only
   blocks that repeat reach the next, so long documents cost n log^2 n, not n^2.

One pass over the texts, without a shuffle. Words are told apart by 64-bit numbers.

Defined cases: a null text has no words; an empty text likewise, and both collapse to an empty
text; with ``repeat_tails`` a null key changes nothing; rows that repeat a key are answered singly;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitwright.llm.words import SPACED_AS_IS, Words, pieces

LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Rounds of splitting; segments that still change are scanned as they are (same runs).
ROUNDS = 64
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def repeated_tail(n: int, h: int) -> tuple[int, int]:
    """(first, period): words from ``first`` on are to repeat the first ``period`` of them."""
    g = h // 10
    first = g % n
    return first, 1 + (n - first) // (3 + g % 8)


def split_rare(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that survive splitting, ascending, and the segment of each."""
    at, segment = np.arange(len(ids)), owner.astype(np.int64)
    many = int(ids.max()) + 1 if len(ids) else 1
    settled, numbers, used = [], [], 0
    for _ in range(ROUNDS):
        if not len(at):
            break
        _, inverse, counts = np.unique(segment * many + ids[at], return_inverse=True,
                                       return_counts=True)
        common = counts[inverse] >= LEAST_PERIODS
        begins = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        sizes = np.diff(np.r_[begins, len(at)])
        whole = np.repeat(np.logical_and.reduceat(common, begins) & (sizes >= LEAST_WORDS), sizes)
        if whole.any():
            mine = np.cumsum(np.r_[0, np.diff(segment[whole]) != 0])
            settled.append(at[whole])
            numbers.append(mine + used)
            used += int(mine[-1]) + 1
        left = common & ~whole
        at, segment = at[left], segment[left]
        if len(at):
            segment = np.cumsum(np.r_[0, (np.diff(at) != 1) | (np.diff(segment) != 0)])
            fits = np.bincount(segment)[segment] >= LEAST_WORDS
            at, segment = at[fits], segment[fits]
    if len(at):
        settled.append(at)
        numbers.append(segment + used)
    if not settled:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, segment = np.concatenate(settled), np.concatenate(numbers)
    order = np.argsort(at)
    return at[order], np.cumsum(np.r_[0, np.diff(segment[order]) != 0])


def _extent(line: np.ndarray, low: int, high: int, lag: int, reach: int) -> tuple[int, int]:
    """Widen [low, high), where ``line`` equals itself ``lag`` later, by up to ``reach`` a side."""
    first = max(0, low - reach)
    other = np.flatnonzero(line[first:low] != line[first + lag:low + lag])
    low = first + int(other[-1]) + 1 if len(other) else first
    last = min(len(line) - lag, high + reach)
    other = np.flatnonzero(line[high:last] != line[high + lag:last + lag])
    return low, high + int(other[0]) if len(other) else max(high, last)


def scan(line: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in a line of numbers; ``longest`` bounds a run."""
    found = []
    rank, width, step = line, 1, 1
    at = np.arange(len(line))
    while LEAST_PERIODS * step <= longest:
        # From ranks of blocks of ``width`` to those of twice that; -1: comes once.
        at = at[at + width < len(line)]
        left, right = rank[at], rank[at + width]
        known = (left >= 0) & (right >= 0)
        at, left, right = at[known], left[known], right[known]
        if not len(at):
            break
        _, inverse, counts = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True,
                                       return_counts=True)
        again = counts[inverse] > 1
        at, inverse = at[again], inverse[again]
        rank = np.full(len(line), -1, np.int64)
        rank[at] = inverse
        width *= 2
        order = np.lexsort((at, inverse))
        here, there = at[order][:-1], at[order][1:]
        lag = there - here
        near = ((inverse[order][:-1] == inverse[order][1:]) & (here % step == 0)
                & (lag >= step) & (lag < 2 * step))
        here, lag = here[near], lag[near]
        order = np.argsort(here)
        here, lag = here[order], lag[order]
        if len(here):
            breaks = np.flatnonzero((np.diff(here) != step) | (np.diff(lag) != 0)) + 1
            firsts, lasts = np.r_[0, breaks], np.r_[breaks, len(here)] - 1
            least = np.maximum(LEAST_WORDS, LEAST_PERIODS * lag[firsts])
            hopeful = (here[lasts] + width + lag[firsts] - here[firsts] + 2 * step >= least)
            for a, b, most in zip(firsts[hopeful], lasts[hopeful], least[hopeful]):
                period = int(lag[a])
                low, high = _extent(line, int(here[a]), int(here[b]) + width, period, step)
                if high + period - low >= most:
                    found.append((low, high + period - low, period))
        step *= 2
    return found


def runs_of(ids: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, length, period) of all runs; words of different owners never meet."""
    at, segment = split_rare(ids, owner)
    if not len(at):
        return []
    # A number of its own after each segment keeps segments apart.
    place = np.arange(len(at)) + segment
    line = np.empty(int(place[-1]) + 2, np.int64)
    origin = np.zeros(len(line), np.int64)
    line[:] = np.arange(len(line)) + int(ids.max()) + 1
    line[place], origin[place] = ids[at], at
    longest = int(np.bincount(segment).max())
    return sorted((int(origin[s]), length, period) for s, length, period in scan(line, longest))


def find(df: DataFrame, key: str = "doc_id", text: str = "text", repeat_tails: bool = False
         ) -> DataFrame:
    """Per row: key, n_words, runs (start, length, period by start), collapsed (the words kept).

    Words of a run after its first period are not kept. ``repeat_tails`` first plants repetitions:
    where the key's checksum is a multiple of ten, the words from some place on are replaced by
    repetitions of those that follow it (see ``repeated_tail``).
    """
    kept_type = df.schema[key].dataType.simpleString()

    def task(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = Words(piece.column("text"), SPACED_AS_IS)
                source = np.arange(len(words.starts))
                planted = set()
                for row, h in enumerate(piece.column("h").to_pylist()):
                    a, n = int(words.rows[row]), int(words.counts[row])
                    if repeat_tails and n and h is not None and h % 10 == 0:
                        first, period = repeated_tail(n, h)
                        source[a + first:a + n] = a + first + np.arange(n - first) % period
                        planted.add(row)
                _, ids = np.unique(words.hashes, return_inverse=True)
                owner = words.row_of
                found = runs_of(ids[source], owner)
                keep = np.ones(len(source), bool)
                for start, length, period in found:
                    keep[start + period:start + length] = False
                rows = owner[[r[0] for r in found]] if found else np.zeros(0, np.int64)
                offsets = np.searchsorted(rows, np.arange(piece.num_rows + 1)).astype(np.int32)
                table = np.array(found, np.int64).reshape(-1, 3)
                table[:, 0] -= words.rows[rows]
                collapsed = []
                for row, value in enumerate(piece.column("text").to_pylist()):
                    mine = (value or "").encode().split()  # at the same bytes as Words
                    if row in planted or offsets[row] < offsets[row + 1]:
                        a, b = words.rows[row], words.rows[row + 1]
                        mine = [mine[i] for i in source[a:b][keep[a:b]] - a]
                    collapsed.append(b" ".join(mine).decode())
                fields = pa.StructArray.from_arrays(
                    [pa.array(table[:, i]) for i in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("key"), pa.array(words.counts.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), fields),
                     pa.array(collapsed, pa.string())],
                    names=["key", "n_words", "runs", "collapsed"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"),
                     F.crc32(F.col(key).cast("string").cast("binary")).alias("h"))
    return rows.mapInArrow(
        task, f"key {kept_type}, n_words long, runs array<{RUN}>, collapsed string"
    ).withColumnRenamed("key", key)


def longest_relative(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; then by start and period."""
    def better(best: Column, run: Column) -> Column:
        ours, theirs = run["length"] * best["period"], best["length"] * run["period"]
        return F.when(best.isNull() | (ours > theirs), run).otherwise(best)

    # Runs come by start and period, so the first of equals stays.
    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the strongest run and digests of the results of ``find``."""
    best = F.col("best")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                    r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", longest_relative(F.col("runs"))).select(
        key, F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
