"""WARC records in ZIP archives, written and read by range without extraction.

An archive is a ZIP file with two stored members: the records, each its own gzip member, and an index of their places.
The reader finds the end-of-directory record in the file's tail, follows the ZIP64 locator if there is one, parses the
central directory, locates a stored member's data by its local header, reads the index, and then fetches runs of
records by one range read each. Archives lie in the shared folder, written whole under a name of the task attempt's own
and listed in a table; only archives in that table are read, so lost or repeated tasks do no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, bitmap, load, materialize, scratch

# The members' names, and signatures of the ZIP format.
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records in an archive, and bytes fetched by one range read, about.
ARCHIVE, RANGE = 32 << 20, 4 << 20
#: Partitions of archives or ranges, at most.
MOST = 100_000
#: Payloads of fewer bytes are never revisits.
LEAST = 0
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _uri(url: str | None, page_id: object) -> str:
    """A header-safe target: control and non-ASCII characters and blanks are percent-encoded."""
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], (url or f"urn:page:{page_id}").encode()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One gzip member: a response record with the payload, or a revisit of page `first` without it."""
    head = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url, page_id)), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if first is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first)), ("X-Refers-To-Page", str(first)), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("X-Page", str(page_id)))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if first is None else b"")
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return gzip.compress(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a gzip member; raises ValueError for a broken record."""
    data = gzip.decompress(raw)
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(head["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length does not fit its block")
    return head, block.partition(b"\r\n\r\n")[2]


def archive(records: list[bytes]) -> bytes:
    """A ZIP file with the records and their index, both stored."""
    out, at, index = io.BytesIO(), 0, []
    for r in records:
        index.append(json.dumps({"offset": at, "length": len(r)}))
        at += len(r)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.writestr(RECORDS, b"".join(records))
        z.writestr(INDEX, "\n".join(index))
    return out.getvalue()


def directory(f) -> dict[str, tuple[int, int, int]]:
    """The central directory of a seekable ZIP file: name -> (local header's place, stored size, method)."""
    size = f.seek(0, 2)
    tail_at = max(0, size - 65_557 - 20)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at + 3)  # the signature may stand in the comment
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        f.seek(struct.unpack_from("<Q", tail, at - 12)[0])
        end = f.read(56)
        if end[:4] != END64:
            raise ValueError("broken ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    f.seek(start)
    data, at, out = f.read(length), 0, {}
    for _ in range(count):
        if data[at : at + 4] != ENTRY:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        stored, full, n, extra, comment = struct.unpack_from("<IIHHH", data, at + 20)
        place = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        x, stop = at + 46 + n, at + 46 + n + extra
        while x + 4 <= stop:
            kind, bytes_ = struct.unpack_from("<HH", data, x)
            if kind == 1:  # ZIP64: only the fields that did not fit, in this order
                y = x + 4
                if full == 0xFFFFFFFF:
                    y += 8
                if stored == 0xFFFFFFFF:
                    stored, y = struct.unpack_from("<Q", data, y)[0], y + 8
                if place == 0xFFFFFFFF:
                    place = struct.unpack_from("<Q", data, y)[0]
            x += 4 + bytes_
        out[name] = (place, stored, method)
        at = stop + comment
    return out


def member(f, entry: tuple[int, int, int]) -> tuple[int, int]:
    """Where a stored member's bytes begin, and how many there are."""
    place, stored, method = entry
    if method != 0:
        raise ValueError("only stored members can be read by range")
    f.seek(place)
    head = f.read(30)
    if head[:4] != LOCAL:
        raise ValueError("broken local header")
    return place + 30 + sum(struct.unpack_from("<HH", head, 26)), stored


def _decided(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """id, url, html, first: the page that a row revisits, null for responses. Only repeated payloads are shuffled."""
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("html"), F.sha1(F.encode(body, "UTF-8")).alias("sha"))
    narrow = materialize(rows.select("id", "sha", F.octet_length("html").alias("n")), "payloads")
    groups = narrow.filter(F.col("n") >= LEAST).groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    groups = materialize(groups, "repeated-payloads")
    if not (n := groups.count()):
        return rows.select("id", "url", "html", F.lit(None).cast("long").alias("first"))
    flagged = bitmap(groups, F.xxhash64("sha"), max(20, n.bit_length() + 4)).flag(rows, F.xxhash64("sha"), "again")
    met = attach(flagged.filter("again").drop("again"), groups, "sha", "size", narrow.count())
    first = F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first"))
    return flagged.filter("not again").select("id", "url", "html", F.lit(None).cast("long").alias("first")).unionByName(met.select("id", "url", "html", first.alias("first")))


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes one record for every page; returns the table of archives: path, records, bytes, root."""
    spark = pages.sparkSession
    root = scratch(spark, "warc")
    system, at = fs.FileSystem.from_uri(root)
    system.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = fs.FileSystem.from_uri(root)
        task = TaskContext.get()
        held, size, number = [], 0, 0

        def put() -> pa.RecordBatch:
            name = f"{at}/part-{task.partitionId():06d}-{number:06d}-{task.taskAttemptId()}.zip"
            data = archive(held)
            with system.open_output_stream(name) as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64())], names=["path", "records", "bytes"])

        for b in batches:
            for i, u, h, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(record(i, u, h.encode(), first))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield put()
                    held, size, number = [], 0, number + 1
        if held:
            yield put()

    table = materialize(_decided(pages, page_id, url, html).mapInArrow(run, "path string, records long, bytes long"), "archives")
    return table.withColumn("root", F.lit(root))


def read(archives: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, root in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.FileSystem.from_uri(root)[0].open_input_file(path) as f:
                    entries = directory(f)
                    at, size = member(f, entries[INDEX])
                    f.seek(at)
                    index = [json.loads(x) for x in f.read(size).decode().split("\n") if x]
                    base, _ = member(f, entries[RECORDS])
                runs: list[list[int]] = [[]]
                held = 0  # bytes of the last run
                for x in index:
                    if runs[-1] and held + x["length"] > RANGE:
                        runs.append([])
                        held = 0
                    runs[-1].append(x["length"])
                    held += x["length"]
                starts = [base]
                for r in runs[:-1]:
                    starts.append(starts[-1] + sum(r))
                n = len(runs)
                yield pa.RecordBatch.from_arrays([pa.array([root] * n), pa.array([path] * n), pa.array(starts, pa.int64()), pa.array(runs, pa.list_(pa.int64()))], names=["root", "path", "start", "lengths"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for root, path, start, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.FileSystem.from_uri(root)[0].open_input_file(path) as f:
                    data = f.read_at(sum(lengths), start)
                rows, at = [], 0
                for n in lengths:
                    head, payload = parse(data[at : at + n])
                    at += n
                    told, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                    if kind == "response" and told != digest(payload):
                        raise ValueError(f"{path}: a payload does not fit its digest")
                    size = len(payload) if kind == "response" else int(head["X-Payload-Length"])
                    page, first = head.get("X-Page"), head.get("X-Refers-To-Page")
                    rows.append((page and int(page), size, told, kind, first and int(first), payload.decode() if kind == "response" else None))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.large_string())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns[:5], columns[5].cast(pa.string())], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    # A row stands for megabytes: numbers of partitions are given, so that adaptive execution does not merge them.
    n, size = archives.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    runs = archives.select("path", "root").repartition(min(max(n, 1), MOST), "path").mapInArrow(places, "root string, path string, start long, lengths array<long>")
    dealt = runs.repartition(min(max(1, size // RANGE), MOST), "path", "start")
    return dealt.mapInArrow(fetch, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the pages as WARC records in ZIP archives and reads them back; one row per page.

    Of pages with equal payloads of LEAST bytes or more, the one with the smallest id is the response and the others
    revisit it; rows repeating that id are responses too. Null html is an empty payload. A page without id is a
    response if no page of its payload has one, else a revisit. Null urls get a target made from the id. Other columns
    are ignored; an empty table gives no rows.
    """
    return read(write(pages, page_id, url, html)).drop("payload")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(load(spark, sf_dir, "pages"))
