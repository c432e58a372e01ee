"""Web archives: WARC files, sorted capture runs, and their merge into one ordered index.

Each task writes one archive (one gzip member per record) and a run: its captures sorted by URL
key, timestamp and id. Runs are cut into segments by ranges of the whole order, down to the place
in the archive, so captures of one URL are split as well; there are as many ranges as the counted
captures need. All segments of one range meet in one task, where a loser tree merges them. Ranges
in order, rows in order of ``seq``, are the capture history of the whole table. Readers take
records back from the archives by the index alone.

A record whose payload (at least ``min_bytes`` long) also belongs to a larger id is a revisit of
the largest; its payload is not stored again. Defined cases: a null payload is empty; a null URL
has the key ""; rows with a null id are responses and nothing refers to them, unless every other
row of that payload has one: the largest id is the response; rows that repeat the largest id are
all responses; an empty table gives no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from datetime import UTC, datetime, timedelta
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitwright.lineage import broadcast_if_small, cut
from waitwright.llm.files import Written, opened, shared_folder

EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
LEVEL = 1
RANGE_ROWS = 1 << 17   # captures of a range, about; cut by a sample of the whole order
BATCH_ROWS = 1 << 14
HEAD_ROWS = 256        # captures of a segment that wait as Python objects
RUN = pa.schema([
    ("urlkey", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()),
    ("offset", pa.int64()), ("length", pa.int64())])
CAPTURE = "urlkey string, ts string, page_id long, uri string, offset long, length long"


def url_key(url: str | None) -> str:
    """Host labels reversed, no scheme, user, default port, www or fragment; lower-case host."""
    if not url:
        return ""
    m = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://)?(?:[^/@?#]*@)?([^/?#:]*)(:\d*)?([^#]*)",
                 url, re.S)
    host = re.sub(r"^www\d*\.", "", m[2].lower())
    port = "" if m[3] in (None, ":", ":80", ":443") else m[3]
    return ",".join(reversed(host.split("."))) + port + ")" + (m[4] or "/")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, name: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{name}>"), *fields,
        ("Content-Length", str(len(block)))])
    raw = f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"
    squeezed = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeezed.compress(raw) + squeezed.flush()


def page_record(page_id, url: str | None, ts: datetime, payload: bytes, refers_to) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [("WARC-Date", f"{ts:%Y-%m-%dT%H:%M:%SZ}"), ("WARC-Target-URI", uri),
              ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
              ("WARC-Payload-Length", str(len(payload))),
              ("Content-Type", "application/http; msgtype=response")]
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    if refers_to is None:
        return _record("response", str(page_id), fields, http + payload)
    fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"),
               ("WARC-Profile",
                "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return _record("revisit", str(page_id), fields, http)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one inflated record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    return fields, rest[:int(fields["content-length"])]


class LoserTree:
    """Merge sorted lists: an inner node keeps the loser of its match, the winner moves up."""

    END = (1, None)

    def __init__(self, runs: list[list], key):
        self.runs = [iter(run) for run in runs]
        self.key = key
        self.size = len(runs)
        self.heads = [self._next(i) for i in range(self.size)]
        self.losers = [-1] * max(self.size, 1)
        self.winner = self._play(1) if self.size > 1 else 0

    def _next(self, i: int):
        item = next(self.runs[i], None)
        return self.END if item is None else (0, (self.key(item), i), item)

    def _before(self, a: int, b: int) -> bool:
        return self.heads[a][:2] < self.heads[b][:2] if self.heads[a][0] == self.heads[b][0] == 0 \
            else self.heads[a][0] <= self.heads[b][0]

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._before(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self):
        while self.size and self.heads[self.winner][0] == 0:
            yield self.heads[self.winner][2]
            win = self.winner
            self.heads[win] = self._next(win)
            node = (win + self.size) // 2
            while node:
                if self._before(self.losers[node], win):
                    win, self.losers[node] = self.losers[node], win
                node //= 2
            self.winner = win


def _order(capture: dict) -> tuple:
    page = capture["page_id"]
    return capture["urlkey"], capture["ts"], page is not None, page or 0


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, print, refers_to) of rows whose payload a larger id has as well."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    thin = pages.select("page_id", F.sha2(payload, 256).alias("print"),
                        F.octet_length(payload).alias("size")).filter(F.col("size") >= min_bytes)
    largest = thin.groupBy("print").agg(F.max("page_id").alias("refers_to"),
                                        F.count("*").alias("n")).filter("n > 1").drop("n")
    return (thin.join(largest, "print").filter("page_id < refers_to")
            .select("page_id", "print", "refers_to").distinct())


def _segment(table: pa.Table, a: int, b: int):
    """Order and place of rows ``a`` to ``b``, a few at a time."""
    for i in range(a, b, HEAD_ROWS):
        part = table.slice(i, min(HEAD_ROWS, b - i))
        for k, (key, ts, page) in enumerate(zip(*(
                part.column(c).to_pylist() for c in ("urlkey", "ts", "page_id")))):
            yield (key, ts, page is not None, page or 0), i + k


def _merged(table: pa.Table, number: int):
    """Batches of one range in order, from its segments: rows that share ``uri``, each sorted."""
    if not table.num_rows:
        return
    run = table.column("uri").combine_chunks().dictionary_encode().indices.to_numpy()
    cuts = np.r_[0, np.flatnonzero(np.diff(run)) + 1, len(run)].tolist()
    places = (place for _, place in LoserTree(
        [_segment(table, a, b) for a, b in zip(cuts[:-1], cuts[1:])], lambda item: item[0]))
    for a in range(0, len(run), BATCH_ROWS):
        part = table.take(pa.array(islice(places, BATCH_ROWS), pa.int64())).combine_chunks()
        size = part.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, number, np.int32)), pa.array(np.arange(a, a + size)),
             *(c.chunk(0) for c in part.columns)], names=["range", "seq", *part.column_names])


def write(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write the archives; returns the merged index: range, seq, urlkey, ts, page_id, uri, offset,
    length. ``pages`` has page_id, url, html."""
    spark = pages.sparkSession
    target = folder or shared_folder(spark, "warc")
    pages = pages.select("page_id", "url", "html")
    again = broadcast_if_small(cut(revisits(pages, min_bytes)))
    print_ = F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256)
    decided = pages.withColumn("print", print_).join(again, ["page_id", "print"], "left")

    def task(batches):
        file, captures = None, []
        for batch in batches:
            if file is None:
                file = Written(target, ".warc.gz")
                file.write(_record("warcinfo", file.uri.rsplit("/", 1)[1], [
                    ("WARC-Date", f"{EPOCH:%Y-%m-%dT%H:%M:%SZ}"),
                    ("Content-Type", "application/warc-fields")], b"format: WARC/1.1\r\n"))
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in (
                    "page_id", "url", "html", "refers_to"))):
                ts = EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))
                record = page_record(page_id, url, ts, (html or "").encode(), refers_to)
                captures.append({"urlkey": url_key(url), "ts": f"{ts:%Y%m%d%H%M%S}",
                                 "page_id": page_id, "uri": file.uri, "offset": file.size,
                                 "length": len(record)})
                file.write(record)
        if file is None:
            return
        file.close()
        captures.sort(key=_order)
        for a in range(0, len(captures), BATCH_ROWS):
            yield pa.RecordBatch.from_pylist(captures[a:a + BATCH_ROWS], schema=RUN)

    runs = cut(decided.select("page_id", "url", "html", "refers_to").mapInArrow(task, CAPTURE))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                 -(-runs.count() // RANGE_ROWS))

    def merge(batches):
        table = pa.Table.from_batches(batches, schema=RUN)
        # Segments one after the other, each in the order of its run.
        table = table.sort_by(
            [(c, "ascending") for c in ("uri", "urlkey", "ts", "page_id", "offset")],
            null_placement="at_start").combine_chunks()
        yield from _merged(table, TaskContext.get().partitionId())

    # Nulls first, as in _order; what is equal there goes by archive and place.
    return runs.repartitionByRange(ranges, "urlkey", "ts", "page_id", "uri", "offset").mapInArrow(
        merge, f"range int, seq long, {CAPTURE}")


def read(index: DataFrame) -> DataFrame:
    """Every indexed record from its archive: page_id, url, record_type, refers_to,
    payload_digest, payload_bytes; the payloads of responses are checked against their digests."""
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                     ("refers_to", pa.int64()), ("payload_digest", pa.string()),
                     ("payload_bytes", pa.int64())])

    def number(value: str | None):
        digits = value[len("<urn:page:"):-1] if value else "None"
        return None if digits == "None" else int(digits)

    def task(batches):
        uri, file = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["uri"] != uri:
                    uri, file = r["uri"], opened(r["uri"])
                fields, block = parse_record(
                    zlib.decompress(file.read_at(r["length"], r["offset"]), 31))
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                size = int(fields["warc-payload-length"])
                if fields["warc-type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if len(payload) != size or base32_sha1(payload) != digest:
                        raise ValueError(f"damaged record at {r['offset']} of {uri}")
                rows.append({"page_id": number(fields["warc-record-id"]),
                             "url": fields["warc-target-uri"], "record_type": fields["warc-type"],
                             "refers_to": number(fields.get("warc-refers-to")),
                             "payload_digest": digest, "payload_bytes": size})
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    return (index.select("uri", "offset", "length").repartitionByRange(tasks, "uri", "offset")
            .sortWithinPartitions("uri", "offset")
            .mapInArrow(task, "page_id long, url string, record_type string, refers_to long, "
                              "payload_digest string, payload_bytes long"))
