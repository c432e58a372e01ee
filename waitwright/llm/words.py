"""Words of whole text batches as 64-bit numbers, without a Python loop over words.

A word is a maximal run of bytes that a 256-entry table keeps; the table also folds A-Z. Each
word gets a 64-bit polynomial hash over random byte values, so equal words get equal numbers and
two different ones share a number with a chance of about 2^-64. Nulls count as empty texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_random = np.random.default_rng(20240601)
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))
WINDOW = 1 << 16


def fold_table(kept: np.ndarray, lower: bool = True) -> np.ndarray:
    """Byte table: 0 for separators, else the byte, A-Z lower-cased if asked for."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[~kept] = 0
    return table


_codes = np.arange(256)
#: Everything but space and 09-0D.
_unspaced = ~((_codes == 32) | ((_codes >= 9) & (_codes <= 13)) | (_codes == 0))
SPACED = fold_table(_unspaced)
#: The same with the letters as they are.
SPACED_AS_IS = fold_table(_unspaced, lower=False)
#: Digits, letters and every byte of a character beyond ASCII.
ALNUM = fold_table(((_codes >= 48) & (_codes <= 57)) | ((_codes >= 65) & (_codes <= 90))
                   | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128))
# A NUL is part of a word between spaces; it must not read as a separator there.
NUL_STAND_IN = np.uint8(0xFF)  # no UTF-8 text holds this byte
SPACED[0] = SPACED_AS_IS[0] = NUL_STAND_IN


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the splitmix64 finaliser)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offset of each row, one more than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    first = offsets[0]
    data = np.frombuffer(data, np.uint8)[first:offsets[-1]] if data is not None else \
        np.zeros(0, np.uint8)
    return data, offsets - first


def powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    if count:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of a batch: ``starts``, ``ends`` (bytes), ``rows`` (first word of each row)."""

    def __init__(self, column, table: np.ndarray):
        raw, offsets = flat(column)
        self.offsets = offsets
        self.data = table[raw]
        inside = self.data != 0
        before = np.zeros(len(inside), bool)
        after = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        filled = offsets[1:] > offsets[:-1]
        before[offsets[:-1][filled]] = False
        after[offsets[1:][filled] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.rows = np.searchsorted(self.starts, offsets)
        self._hashes = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)

    def text(self, word: int) -> str:
        piece = self.data[self.starts[word]:self.ends[word]]
        return piece.tobytes().replace(b"\xff", b"\0").decode("utf-8", "replace")

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = self.range_hashes(self.starts, self.ends)
        return self._hashes

    def range_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of byte ranges, ordered by start, each within a word."""
        out = np.empty(len(starts), np.uint64)
        up = down = np.zeros(0, np.uint64)
        for a in range(0, len(out), WINDOW):
            s, e = starts[a:a + WINDOW], ends[a:a + WINDOW]
            low, span = s[0], int(e.max() - s[0])
            if len(up) < span:
                up, down = powers(FACTOR, span), powers(INVERSE, span)
            total = np.zeros(span + 1, np.uint64)
            np.cumsum(BYTE_VALUES[self.data[low:low + span]] * up[:span], out=total[1:])
            out[a:a + WINDOW] = (total[e - low] - total[s - low]) * down[s - low]
        return mix(out)


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Slices of a batch with about ``most`` bytes of text each, at least one row."""
    text = batch.column(column)
    lengths = np.asarray(
        pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False),
        np.int64)
    if not len(lengths):
        return
    group = (np.cumsum(lengths) - lengths) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(lengths)]):
        yield batch.slice(int(a), int(b - a))


def shingles(words: Words, size: int, whole_when_shorter: bool = True
             ) -> tuple[np.ndarray, np.ndarray]:
    """64-bit number of each run of ``size`` words in row order, and the first of each row.

    Runs never cross rows. A row with fewer words, but not none, has its whole sequence as one.
    """
    h, counts = words.hashes, words.counts
    total = len(h)
    value = np.zeros(total, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            shifted = np.zeros(total, np.uint64)
            shifted[:max(total - k, 0)] = h[k:]
            value = mix(value * FACTOR + shifted + np.uint64(k + 1))
        left = np.repeat(words.rows[1:], counts) - np.arange(total)
        keep = left >= size
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short) and whole_when_shorter:
            firsts = words.rows[short]
            for row, first in zip(short, firsts):
                run = np.uint64(0)
                for k in range(counts[row]):
                    run = mix(np.array([run * FACTOR + h[first + k] + np.uint64(k + 1)],
                                       np.uint64))[0]
                value[first] = run
            keep[firsts] = True
    per_row = np.add.reduceat(np.r_[keep, False].astype(np.int64), words.rows[:-1]) \
        if len(counts) else np.zeros(0, np.int64)
    per_row = np.where(counts > 0, per_row, 0)
    return value[keep], np.r_[0, np.cumsum(per_row)].astype(np.int64)
