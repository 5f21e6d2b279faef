"""WARC archives of pages, and an external merge of their capture index.

1. Equal payloads meet by SHA-256; all but the page with the smallest id become
   revisit records.  A task passes a payload on only with a page that may be the
   smallest, so a payload that many pages share travels a few times for a task.
2. Each task writes its records in the order of (URL key, timestamp, page) to
   archives of one gzip member a record, and gives the sorted run of their
   index.  Archives appear whole under names of their own; only those that the
   committed index names count, so a lost attempt leaves nothing behind but an
   unread file.
3. The runs are cut at common bounds, which Spark samples, and each range merges
   its pieces of all runs with a tree of losers, so the ranges in order are the
   capture histories of the whole collection.  Bounds are whole keys, so one URL
   may span ranges.
4. Records are read back through the merged index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from datetime import datetime, timedelta, timezone
from urllib.parse import parse_qsl, quote, urlencode, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import fsio
from tidewater.llm.common import Scratch, bound_batches, partitions_for, quoted, slices, tidy

ARCHIVE_BYTES = 16 << 20
#: Captures in a range of the merged index, and runs that one tree merges at once.
RANGE_ROWS, WAYS = 20_000, 256
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(rb"<urn:x-page:(-?\d+|null)>")

INDEX = T.StructType([T.StructField(n, T.LongType() if n in ("page_id", "offset", "length") else T.StringType()) for n in ("urlkey", "timestamp", "page_id", "archive", "offset", "length")])


def url_key(url: str | None) -> str:
    """Host parts reversed, then path and sorted query, lower-cased; the fragment and a leading www go."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url.lower()
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{'?' + query if query else ''}".lower()


def capture_time(page_id: int | None) -> str:
    """The timestamp of pages that have none: a second for each id from 2024 on."""
    at = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=(page_id or 0) % (1 << 31))
    return at.strftime("%Y%m%d%H%M%S")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, timestamp: str, payload: bytes | None, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC 1.1 record as a gzip member; a revisit keeps the HTTP headers alone and needs no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    date = f"{timestamp[:4]}-{timestamp[4:6]}-{timestamp[6:8]}T{timestamp[8:10]}:{timestamp[10:12]}:{timestamp[12:]}Z"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or 'urn:x-none', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(2, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """A record's page_id, type, refers_to, payload size and digest; a response's payload is digested anew."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = rest[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields[b"WARC-Type"].decode()
    number = lambda x: None if (m := _ID.fullmatch(x)[1]) == b"null" else int(m)
    size = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"record {fields[b'WARC-Record-ID']!r} is damaged")
    return {"page_id": number(fields[b"WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields[b"WARC-Refers-To"]) if kind == "revisit" else None}


class LoserTree:
    """Merges k sorted lists: each inner node keeps the loser, so a step replays one path of log2(k) matches."""

    def __init__(self, runs: list[list]):
        self.runs = [r for r in runs if r]
        self.at = [0] * len(self.runs)
        self.k = max(1, len(self.runs))
        self.tree = [-1] * self.k
        winners = [-1] * (2 * self.k)
        winners[self.k :] = range(self.k) if self.runs else [-1]
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._beats(a, b) else (b, a)
        self.top = winners[1] if self.k > 1 else (0 if self.runs else -1)

    def _beats(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def __iter__(self):
        while self.top >= 0 and self.at[self.top] < len(self.runs[self.top]):
            winner = self.top
            yield self.runs[winner][self.at[winner]]
            self.at[winner] += 1
            node = (winner + self.k) >> 1
            while node:
                other = self.tree[node]
                if self._beats(other, winner):
                    self.tree[node], winner = winner, other
                node >>= 1
            self.top = winner


def merge_runs(runs: list[list], ways: int = WAYS) -> list:
    """All entries of sorted runs in order; more runs than `ways` are merged in rounds."""
    while len(runs) > 1:
        runs = [list(LoserTree(runs[i : i + ways])) for i in range(0, len(runs), ways)]
    return runs[0] if runs else []


_PAGES = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("url", T.StringType()), ("urlkey", T.StringType()), ("timestamp", T.StringType()), ("sha", T.BinaryType()), ("digest", T.StringType()), ("size", T.LongType()), ("html", T.BinaryType()))])


def _digested(least_revisit: int):
    """Digests and sizes of payloads; the payload itself only where the page may be the response."""

    def run(batches):
        least: dict[bytes, int] = {}
        for whole in batches:
            for part in slices(whole, "html"):
                rows = []
                for page, url, html in zip(*(c.to_pylist() for c in part.columns)):
                    sha = hashlib.sha256(html).digest()
                    before = least.get(sha)
                    keep = before is None or (page is not None and page <= before) or len(html) < least_revisit
                    if page is not None and (before is None or page < before):
                        least[sha] = page
                    rows.append((page, url, url_key(url), capture_time(page), sha, payload_digest(html), len(html), html if keep else None))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_PAGES.names)
        tidy()

    return run


def write_archives(pages: DataFrame, scratch: Scratch, least_revisit: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row and gives the index, a sorted run for each archive.

    A null html is an empty payload; a null url has the empty URL key.  Of equal
    payloads of at least least_revisit bytes the page with the smallest id is
    the response.  Rows of that same id are all responses; a null id is never
    the smallest, and a response only if no page has an id.  An empty table
    writes no archive.  Other columns are not read.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(quoted(id_col).cast("long").alias("page_id"), quoted(url_col).cast("string").alias("url"), F.coalesce(quoted(html_col).cast("binary"), F.lit(b"")).alias("html"))
    rows = scratch.write(rows.mapInArrow(_digested(least_revisit), _PAGES), "pages", compression="zstd")
    firsts = rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = scratch.write(firsts, "firsts")  # so that Spark may split the join where a payload is hot
    joined = rows.join(firsts, "sha", "left")
    root = scratch.path("archives")
    revisit = F.coalesce((F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))) & F.col("first").isNotNull() & (F.col("size") >= least_revisit), F.lit(False))
    ordered = joined.withColumn("revisit", revisit).withColumn("html", F.when(~F.col("revisit"), F.col("html"))).sortWithinPartitions("urlkey", "timestamp", "page_id", "sha")

    def run(batches):
        held, index, size = [], [], 0

        def close():
            name = f"{root}/{uuid.uuid4().hex}.warc.gz"
            fsio.put(name, b"".join(held))
            cols = list(zip(*index))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array([name] * len(index), pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=INDEX.names)

        for whole in batches:
            for part in slices(whole, "html"):
                for page, url, html, first, urlkey, time, digest, n, again in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "first", "urlkey", "timestamp", "digest", "size", "revisit"))):
                    data = record(page, url, time, html, digest, n, first if again else None, again)
                    index.append((urlkey, time, page, size, len(data)))
                    held.append(data)
                    size += len(data)
                    if size >= ARCHIVE_BYTES:
                        yield close()
                        held, index, size = [], [], 0
        if held:
            yield close()
        tidy()

    return scratch.write(ordered.drop("sha").mapInArrow(run, INDEX), "runs")


def merge_index(index: DataFrame, scratch: Scratch, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The index with the place of each capture: range, then position; equal entries in the order of their archives."""
    ranges = max(1, index.count() // range_rows)
    out = T.StructType([T.StructField("range", T.LongType()), T.StructField("position", T.LongType()), *INDEX.fields])

    def merge(batches):
        runs: dict[str, list] = {}
        for b in batches:
            for u, t, p, a, o, n in zip(*(c.to_pylist() for c in b.columns)):
                runs.setdefault(a, []).append((u, t, -1 if p is None else p, a, o, n, p))
        rows = merge_runs([runs[a] for a in sorted(runs)])
        mine = TaskContext.get().partitionId()
        for k in range(0, len(rows), 4096):
            cols = list(zip(*rows[k : k + 4096]))
            at = range(k, k + len(cols[0]))
            yield pa.RecordBatch.from_arrays([pa.array([mine] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[6], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())], names=out.names)

    dealt = index.select(*INDEX.names).repartitionByRange(ranges, "urlkey", "timestamp", F.coalesce("page_id", F.lit(-1))).sortWithinPartitions("archive", "offset")
    return scratch.write(dealt.mapInArrow(merge, out), "captures")


def read_archives(captures: DataFrame) -> DataFrame:
    """The records that an index names, each read by its offset; an archive is opened by one task."""
    out = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("urlkey", T.StringType()), T.StructField("timestamp", T.StringType())])

    def run(batches):
        name, data = None, b""
        for b in batches:
            rows = []
            for archive, offset, length, urlkey, time in zip(*(b.column(n).to_pylist() for n in ("archive", "offset", "length", "urlkey", "timestamp"))):
                if archive != name:
                    name, data = archive, fsio.get(archive)
                rows.append(parse(data[offset : offset + length]) | {"urlkey": urlkey, "timestamp": time})
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], pa.int64() if f.dataType == T.LongType() else pa.string()) for f in out], names=out.names)
        data = b""
        tidy()

    n = partitions_for(captures, 1 << 20)
    return captures.repartition(n, "archive").sortWithinPartitions("archive", "offset").mapInArrow(run, out)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, the index merged, and each record read back through it."""
    scratch = Scratch(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    captures = merge_index(write_archives(pages, scratch), scratch)
    return read_archives(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
