"""WARC archives of pages, and the reading back of records by range.

A record is one gzip member, so that it can be read alone by (archive, offset, length). Of equal payloads of at
least ``LEAST_SHARED`` bytes one page is stored as ``response``; the others are ``revisit`` records, which hold the
HTTP header and the payload's digest but not the payload. Each task writes archives of its own under a name that no
other attempt uses and returns the records' places; only places returned by a finished task enter the index, so the
files of a lost attempt are never read.

Cases: a null or empty text is an empty payload; small payloads are all responses; of repeated rows of one page with
equal payloads the one with the smallest address is the response, the others revisit it; null page ids come last, so
they are responses only where all equal payloads have none; a null address has the empty key; control characters of
addresses are percent-encoded; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketscope.llm import store
from docketscope.llm.runtime import columns
from docketscope.operators.joins import BROADCAST_ROWS
from docketscope.session import cut_lineage

LEAST_SHARED = 100
ARCHIVE_BYTES = 1 << 30
READ_BYTES = 4 << 20
TASK_BYTES = 64 << 20
LONGEST_KEY = 2048
DATE = "1970-01-01T00:00:00Z"

CAPTURE = "key string, page_id long, archive string, offset long, length long"
RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long,"
    " payload_digest string"
)


def plain_address(url: str) -> str:
    """An address without characters that end a header line or a word."""
    return quote(url, safe="".join(chr(c) for c in range(33, 127)), encoding="utf-8", errors="replace")


def sort_key(url: str | None) -> str:
    """Reversed host, then path and query: pages of a site and its subdomains sort together."""
    if url is None:
        return ""
    text = plain_address(url)
    try:
        parts = urlsplit(text)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        host, port = "", None
    key = text
    if host:
        default = {"http": 80, "https": 443}.get(parts.scheme)
        key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != default else "")
        key += ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    if len(key) > LONGEST_KEY:  # still a function of the address, and different for different ones
        key = f"{key[:LONGEST_KEY]}#{hashlib.sha256(key.encode()).hexdigest()}"
    return key


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def build_record(
    page_id: int | None, url: str | None, kind: str, refers_to: int | None, payload: bytes, size: int, digest: str
) -> bytes:
    """One record, compressed. A revisit carries the header of the response, with its length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": _name(page_id, digest if kind == "response" else f"{digest}:revisit:{url}"),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else plain_address(url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Page-ID": page_id,
    }
    if kind == "revisit":
        head |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": _name(refers_to, digest),
            "WARC-Refers-To-Page-ID": refers_to,
        }
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(member: bytes) -> dict:
    """The fields of RECORD from one compressed record; digests and lengths are recomputed and compared."""
    data = gzip.decompress(member)
    end = data.index(b"\r\n\r\n")
    version, *lines = data[:end].decode().split("\r\n")
    head = dict(line.split(": ", 1) for line in lines)
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    if version != "WARC/1.1" or data[end + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("damaged record")
    header, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in header.decode().split("\r\n")[1:])["Content-Length"])
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = head["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload does not match its record")

    def number(name: str) -> int | None:
        return int(head[name]) if name in head else None

    return {
        "page_id": number("WARC-Page-ID"), "url": head.get("WARC-Target-URI"), "record_type": kind,
        "refers_to": number("WARC-Refers-To-Page-ID"), "payload": payload if kind == "response" else None,
        "payload_bytes": size, "payload_digest": digest,
    }


def mark_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, size, digest, kind, refers_to): which pages are stored and which refer to one.

    Payloads are compared by digest. Counts are aggregated by (digest, page) first, so a payload that a
    third of all pages share is a few narrow rows per task; the list of shared payloads is broadcast up to a
    checked size and joined by shuffle beyond it, where Spark splits a hot digest.
    """
    rows = pages.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rows", "url")
    shared = cut_lineage(
        rows.where(F.col("size") >= LEAST_SHARED)
        .groupBy("digest", "page_id").agg(F.count("*").alias("rows"), F.min("url").alias("url"))
        .groupBy("digest").agg(F.sum("rows").alias("all_rows"), F.min(place).alias("first"))
        .where(F.col("all_rows") > 1)
        .select("digest", F.col("first.page_id").alias("first_id"), F.col("first.rows").alias("first_rows"),
                F.col("first.url").alias("first_url"))
    )
    listed = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
    joined = rows.join(listed, "digest", "left")
    ours = F.col("first_rows").isNotNull() & F.col("page_id").eqNullSafe(F.col("first_id"))
    revisit = F.col("first_rows").isNotNull() & ~ours
    result = ["page_id", "url", "payload", "size", "digest"]

    def kinds(is_revisit):
        return [
            F.when(is_revisit, "revisit").otherwise("response").alias("kind"),
            F.when(is_revisit, F.col("first_id")).alias("refers_to"),
        ]

    repeated = shared.where(F.col("first_rows") > 1)
    if repeated.isEmpty():
        return joined.select(*result, *kinds(revisit))
    # several rows of the stored page: equal ones are counted, and one copy of the smallest address is stored
    again = ours & (F.col("first_rows") > 1)
    copies = (
        joined.where(again).groupBy("page_id", "url", "digest", "size", "first_id", "first_url")
        .agg(F.first("payload").alias("payload"), F.count("*").alias("rows"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    )
    other = (F.col("copy") > 1) | ~F.col("url").eqNullSafe(F.col("first_url"))
    return joined.where(~again).select(*result, *kinds(revisit)).unionByName(copies.select(*result, *kinds(other)))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html"
) -> DataFrame:
    """Write every page's record into archives under ``folder``; returns the captures (CAPTURE), stored."""
    given = columns(
        pages, page_id=F.col(f"`{id_col}`").cast("long"), url=url_col,
        payload=F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, name, at = TaskContext.get().partitionId(), None, "", 0
        try:
            for batch in batches:
                found = []
                cells = [batch.column(c) for c in ("page_id", "url", "kind", "refers_to", "payload", "size", "digest")]
                for k in range(batch.num_rows):
                    row = [c[k].as_py() for c in cells]
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"pages-{task:06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.create(folder, name)
                    member = build_record(*row)
                    out.write(member)
                    found.append((sort_key(row[1]), row[0], name, at, len(member)))
                    at += len(member)
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)],
                    ["key", "page_id", "archive", "offset", "length"],
                )
        finally:
            if out is not None:
                out.close()

    return cut_lineage(mark_revisits(given).mapInArrow(run, CAPTURE))


@dataclass
class _Archive:
    """The archive a task reads at the moment."""

    folder: str
    name: str = ""
    file: object = None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.file, self.name = store.open_file(self.folder, name), name
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records (RECORD) at the given places.

    Places are dealt and sorted by (archive, offset); neighbouring ranges are read together, up to READ_BYTES.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[int]]]:
        name, start, lengths, size = None, 0, [], 0
        for batch in batches:
            for archive, offset, length in zip(*[batch.column(c).to_pylist() for c in ("archive", "offset", "length")], strict=True):
                if lengths and (archive != name or offset != start + size or size + length > READ_BYTES):
                    yield name, start, lengths
                    lengths, size = [], 0
                if not lengths:
                    name, start = archive, offset
                lengths.append(length)
                size += length
        if lengths:
            yield name, start, lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = _Archive(folder)
        try:
            for name, start, lengths in ranges(batches):
                data, at, found = source.read(name, start, sum(lengths)), 0, []
                for length in lengths:
                    found.append(parse_record(data[at : at + length]))
                    at += length
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
                names = list(found[0])
                yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], k) for n, k in zip(names, kinds, strict=True)], names)
        finally:
            source.close()

    places = cut_lineage(captures.select("archive", "offset", "length"))
    size = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    # by bytes to read: the places themselves are too small to tell how many tasks there should be
    tasks = max(places.sparkSession.sparkContext.defaultParallelism, ceil(size / TASK_BYTES))
    dealt = places.repartitionByRange(tasks, "archive", "offset")
    return dealt.sortWithinPartitions("archive", "offset").mapInArrow(run, RECORD)
