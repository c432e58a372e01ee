"""Token ids in binary files of patched frame-of-reference blocks, written and read in parallel.

Rows are range-partitioned by id; each task encodes its rows in order and writes one file. File:

    b"PFOR1\\n", blocks, block index, row index, footer

A block holds up to 4096 ids. The smallest id is subtracted; the rest is packed at the width that
holds the 95th percentile; ids that need more bits keep their low bits there, and position and
high bits go to an exception list. Block: ids u32, smallest u32, width u8, exceptions u32; packed
bits (first id in the highest bits); positions u16; high parts u32. Block index: start of each
block u64. Row index: number of ids of each row u64, then the keys i64, then 1 for each key that is
not null, u8. Footer: blocks u64, rows u64, ids u64, index start u64, magic. All little-endian. A
block can be read alone through the index.

Encoding runs over distinct pieces between white space (space and 09-0D), each encoded once by the
tokenizer and remembered: the tokenizer must drop white space and never join characters across it,
so that the ids of a text are those of its pieces in order. Defined cases: a null or empty text has only the end id; a null id sorts first; rows
that repeat an id keep their number (ordered by text); an empty table writes nothing.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waitwright.lineage import cut
from waitwright.llm.files import Written, opened, shared_folder
from waitwright.llm.words import SPACED_AS_IS, Words, pieces

MAGIC = b"PFOR1\n"
BLOCK = 4096
PERCENTILE = 95
HEAD = struct.Struct("<IIBI")
FOOT = struct.Struct("<QQQQ")
REMEMBERED = 1_500_000  # pieces whose ids a worker keeps before it starts anew, some 60 MB
RECENT = 100_000
LEARN_STEP = 1024       # pieces given to the tokenizer at once
SEPARATOR = "~"


def pack(values: np.ndarray, width: int) -> bytes:
    if not width or not len(values):
        return b""
    bits = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(bits[:, 32 - width:]).tobytes()


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    if not width or not count:
        return np.zeros(count, np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width).reshape(count, width)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - width:] = bits
    return np.packbits(wide, axis=1).view(">u4").reshape(count).astype(np.uint32)


def encode_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    rest = ids - np.uint32(low)
    ordered = np.sort(rest)
    width = int(ordered[(len(ids) * PERCENTILE - 1) // 100]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    return b"".join((
        HEAD.pack(len(ids), low, width, len(over)),
        pack(rest & np.uint32((1 << width) - 1), width),
        over.astype("<u2").tobytes(), (rest[over] >> np.uint32(width)).astype("<u4").tobytes()))


def decode_block(data: bytes) -> np.ndarray:
    count, low, width, over = HEAD.unpack_from(data)
    at = HEAD.size + (count * width + 7) // 8
    ids = unpack(data[HEAD.size:at], count, width)
    where = np.frombuffer(data, "<u2", over, at).astype(np.int64)
    ids[where] |= np.frombuffer(data, "<u4", over, at + 2 * over) << np.uint32(width)
    return ids + np.uint32(low)


class IdWriter:
    def __init__(self, folder: str):
        self.file = Written(folder, ".pfor")
        self.file.write(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = 0
        self.starts: list[int] = []
        self.rows: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.known: list[np.ndarray] = []

    def add(self, ids: np.ndarray, lengths: np.ndarray, keys: pa.Array) -> None:
        self.rows.append(lengths.astype("<u8"))
        self.keys.append(keys.fill_null(0).to_numpy().astype("<i8"))
        self.known.append(keys.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
        self.ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self._flush(self.held - self.held % BLOCK)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.waiting)
        for a in range(0, count, BLOCK):
            self.starts.append(self.file.size)
            self.file.write(encode_block(ids[a:min(a + BLOCK, count)]))
        self.waiting, self.held = [ids[count:]], len(ids) - count

    def close(self) -> tuple[str, int, int]:
        if self.held:
            self._flush(self.held)
        index, rows = self.file.size, sum(map(len, self.rows))
        self.file.write(b"".join((
            np.array(self.starts, "<u8").tobytes(),
            *(x.tobytes() for part in (self.rows, self.keys, self.known) for x in part),
            FOOT.pack(len(self.starts), rows, self.ids, index), MAGIC)))
        self.file.close()
        return self.file.uri, rows, self.ids


class IdReader:
    def __init__(self, uri: str):
        self.file = opened(uri)
        size = self.file.size()
        tail = FOOT.size + len(MAGIC)
        end = self.file.read_at(tail, size - tail)
        blocks, rows, self.ids, index = FOOT.unpack_from(end)
        if end[FOOT.size:] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"not a whole id file: {uri}")
        table = self.file.read_at(8 * blocks + 17 * rows, index)
        self.starts = np.r_[np.frombuffer(table, "<u8", blocks), np.uint64(index)].astype(np.int64)
        self.lengths = np.frombuffer(table, "<u8", rows, 8 * blocks).astype(np.int64)
        known = np.frombuffer(table, np.uint8, rows, 8 * (blocks + 2 * rows))
        self.keys = pa.array(np.frombuffer(table, "<i8", rows, 8 * (blocks + rows)),
                             mask=known == 0)

    def block(self, number: int) -> np.ndarray:
        a, b = self.starts[number:number + 2]
        return decode_block(self.file.read_at(int(b - a), int(a)))

    def rows(self, first: int = 0) -> Iterator[np.ndarray]:
        """Ids of each row from row ``first``, in order; holds a block and the current row."""
        at = int(self.lengths[:first].sum())
        number = at // BLOCK
        rest = self.block(number)[at % BLOCK:] if number < len(self.starts) - 1 else \
            np.zeros(0, np.uint32)
        number += 1
        for length in self.lengths[first:]:
            parts, missing = [], int(length)
            while missing > len(rest):
                parts.append(rest)
                missing -= len(rest)
                rest = self.block(number)
                number += 1
            parts.append(rest[:missing])
            rest = rest[missing:]
            yield np.concatenate(parts) if len(parts) > 1 else parts[0]


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]):
    keys, values = np.r_[a[0], b[0]], np.r_[a[1], b[1]]
    order = np.argsort(keys)
    return keys[order], values[order]


class Encoder:
    """Ids of many texts, each distinct piece between white space encoded once.

    Pieces are known by 64-bit numbers (``words``). New ones go to the tokenizer many at a time,
    joined by a separator of one id; pieces that hold the separator go alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        probe = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.joint = probe[0] if len(probe) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.pool = np.zeros(1 << 20, np.uint32)
        self.bounds = np.zeros(1 << 18, np.int64)
        self.count = 0
        # Known numbers, sorted, and their places in ``bounds``: a large and a recent part.
        self.parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        first, last, total = int(self.bounds[self.count]), self.count + len(sizes), len(ids)
        while first + total > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros(len(self.pool), np.uint32)]
        while last >= len(self.bounds):
            self.bounds = np.r_[self.bounds, np.zeros(len(self.bounds), np.int64)]
        self.pool[first:first + total] = ids
        self.bounds[self.count + 1:last + 1] = first + np.cumsum(sizes)
        self.count = last

    def _learn(self, joined: list[str], alone: list[str]) -> None:
        encode = lambda text: np.array(
            self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        for at in range(0, len(joined), LEARN_STEP):
            ids = encode(f" {SEPARATOR} ".join(joined[at:at + LEARN_STEP]))
            joint = ids == self.joint
            self._add(ids[~joint], np.diff(np.r_[-1, np.flatnonzero(joint), len(ids)]) - 1)
        for piece in alone:
            ids = encode(piece)
            self._add(ids, np.array([len(ids)]))

    def _places(self, hashes: np.ndarray, words: Words, firsts: np.ndarray) -> np.ndarray:
        """Place in ``bounds`` of each distinct piece, learning those not known."""
        place = np.full(len(hashes), -1, np.int64)
        for known, at in self.parts:
            if len(known):
                near = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                place = np.where(known[near] == hashes, at[near], place)
        missing = np.flatnonzero(place < 0)
        texts = [words.text(w) for w in firsts[missing]]
        alone = np.array([self.joint is None or SEPARATOR in t for t in texts], bool)
        missing = np.r_[missing[~alone], missing[alone]]
        place[missing] = self.count + np.arange(len(missing))
        self._learn([t for t, a in zip(texts, alone) if not a],
                    [t for t, a in zip(texts, alone) if a])
        large, recent = self.parts
        recent = _merged(recent, (hashes[missing], place[missing]))
        if len(recent[0]) > RECENT:
            large, recent = _merged(large, recent), (recent[0][:0], recent[1][:0])
        self.parts = [large, recent]
        return place

    def encode(self, column, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in row order and the number of each row, end ids included."""
        if self.count > REMEMBERED:
            self.forget()
        words = Words(column, SPACED_AS_IS)
        distinct, firsts, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        place = self._places(distinct, words, firsts)[which]
        begins = self.bounds[place]
        sizes = self.bounds[place + 1] - begins
        ends = np.cumsum(sizes)
        per_row = np.diff(np.r_[0, ends][words.rows])
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(begins - (ends - sizes), sizes) + np.arange(total)]
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(per_row), np.uint32(end_id))
            per_row = per_row + 1
        return ids, per_row


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process: later tasks find the pieces of earlier ones known."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
          end_id: int | None = 2, folder: str | None = None,
          order: tuple[Column, ...] | None = None) -> DataFrame:
    """Write id files in ascending key order, or in ``order``; returns the manifest.

    Manifest, one row per file: part (its place), uri, rows, ids, and the ids of all files before it (``before``).
    """
    spark = df.sparkSession
    target = folder or shared_folder(spark, "ids")
    places = {f"_order{i}": c for i, c in enumerate(order or (F.col(key),))}
    ordered = (df.select(F.col(key).alias("key"), F.col(text).alias("text"),
                         *(c.alias(name) for name, c in places.items()))
               .repartitionByRange(*places)
               .sortWithinPartitions(*places, "text")
               .select("key", "text", F.spark_partition_id().alias("part")))

    def task(batches):
        writer, part = None, 0
        coder = encoder(tokenizer)
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                writer = writer or IdWriter(target)
                part = piece.column("part")[0].as_py()
                writer.add(*coder.encode(piece.column("text"), end_id), piece.column("key"))
        if writer is not None:
            uri, rows, ids = writer.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "uri": uri, "rows": rows, "ids": ids}])

    files = cut(ordered.mapInArrow(task, "part long, uri string, rows long, ids long"))
    # One row per file: the running total is over the list of files.
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    return files.join(F.broadcast(starts), "part")


def read(manifest: DataFrame) -> DataFrame:
    """One row per written row, from the files: key, start, n_ids, crc32 of its ids."""
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def task(batches):
        for batch in batches:
            for file in batch.to_pylist():
                reader = IdReader(file["uri"])
                starts = file["before"] + np.cumsum(reader.lengths) - reader.lengths
                sums = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in reader.rows()]
                yield pa.RecordBatch.from_arrays(
                    [reader.keys, pa.array(starts, pa.int64()),
                     pa.array(reader.lengths, pa.int64()), pa.array(sums, pa.int64())],
                    names=["key", "start", "n_ids", "crc32"])

    return (manifest.select("part", "uri", "before").repartitionByRange(tasks, "part")
            .mapInArrow(task, "key long, start long, n_ids long, crc32 long"))
