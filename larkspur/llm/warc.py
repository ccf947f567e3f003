"""WARC archives as a chunked record table.

A record's bytes (WARC head, HTTP head, payload) are a stream of rows (record, chunk_no, data).
The first chunk holds the heads and the first ``chunk`` bytes of the payload, each later one the
next ``chunk`` bytes, so writing and reading hold one chunk besides the row a payload came in.
Every row carries the SHA-1 of the payload up to its end: a reader checks each chunk as it comes
and needs no whole record. Records of one chunk are read where they lie; only the chunks of
larger ones are brought together by record and sorted by number.

Of records with equal payloads the one with the smallest id is a response and the others revisit
it, with the HTTP head but without the payload (profile identical-payload-digest), if the payload
has at least ``min_revisit_bytes``.

Defined results: a null payload is empty; a null URL is written as ``urn:page:<id>``; control
characters and blanks in a URL are percent-encoded; repeated rows of the smallest id are all
responses; a row without an id revisits a row with one, and is a response if there is none; an
empty table gives an empty archive; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import column, ship, staged

CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_TABLE = "record long, chunk_no int, last boolean, digest string, data binary"
_FOUND = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_ARROW = pa.schema([("record", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("digest", pa.string()), ("data", pa.binary())])
_BATCH_BYTES = 16 << 20


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def first_of_equals(pages: DataFrame, id_col: str, payload_col: str, min_revisit_bytes: int = 0) -> DataFrame:
    """(id, sha, first) of the rows that revisit; ``first`` is the smallest id of an equal payload.

    Digests are grouped with map-side partials; only those met twice come back to the rows, in
    a join of stored tables whose hot keys the adaptive skew join splits.
    """
    payload = F.coalesce(column(payload_col).cast("binary"), F.lit("").cast("binary"))
    ids = staged(pages.select(column(id_col).cast("long").alias("id"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("size")), "warc-ids")
    groups = ids.where(F.col("size") >= min_revisit_bytes).groupBy("sha", "size").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = staged(groups.where("n > 1 and first is not null").select("sha", "size", "first"), "warc-groups")
    later = ids.join(groups, ["sha", "size"]).where(~F.col("id").eqNullSafe(F.col("first")))
    return staged(later.select("id", "sha", "first").distinct(), "warc-revisits")


def _safe_url(url: str | None, page: int | None) -> str:
    if not url:
        return f"urn:page:{page}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def heads(page: int | None, url: str | None, size: int, digest: str, first: int | None, revisit: bool, date: str) -> bytes:
    """The WARC head and the HTTP head of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_safe_url(url, page)}", f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else size)}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[-1] or b"") if isinstance(row[-1], bytes) else 64
        if size >= _BATCH_BYTES or len(held) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes the archive of ``pages`` as a Parquet table of chunks in ``folder``."""
    ship(pages.sparkSession)
    later = first_of_equals(pages, id_col, payload_col, min_revisit_bytes)
    rows = pages.select(column(id_col).cast("long").alias("id"), column(url_col).cast("string").alias("url"), F.coalesce(column(payload_col).cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).alias("p").join(later.alias("r"), F.col("p.id").eqNullSafe(F.col("r.id")) & (F.col("p.sha") == F.col("r.sha")), "left")
    rows = rows.select("p.id", "p.url", "r.first", F.col("r.sha").isNotNull().alias("revisit"), "p.payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[tuple]:
            number = TaskContext.get().partitionId() << 40
            for batch in batches:
                for page, url, first, revisit, payload in zip(*[c.to_pylist() for c in batch.columns[:4]], batch.column(4), strict=True):
                    body = memoryview(payload.as_buffer())
                    whole = hashlib.sha1(body)
                    head = heads(page, url, len(body), base32(whole.digest()), first, revisit, date)
                    if revisit or len(body) <= chunk:
                        yield number, 0, True, whole.hexdigest(), head + (b"" if revisit else bytes(body)) + b"\r\n\r\n"
                    else:
                        so_far = hashlib.sha1()
                        for k, at in enumerate(range(0, len(body), chunk)):
                            piece, last = bytes(body[at : at + chunk]), at + chunk >= len(body)
                            so_far.update(piece)
                            yield number, k, last, so_far.hexdigest(), (head if k == 0 else b"") + piece + (b"\r\n\r\n" if last else b"")
                    number += 1

        yield from _batched(rows_of(), _ARROW)

    rows.mapInArrow(run, _TABLE).write.parquet(folder)


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}


class _Reader:
    """Follows the chunks of one record after another, keeping a running digest only."""

    def __init__(self) -> None:
        self.record = None

    def feed(self, record: int, number: int, last: bool, digest: str, data: bytes) -> tuple | None:
        """The record's row at its last chunk."""
        body = memoryview(data)
        if number == 0:
            end = data.index(b"\r\n\r\n")
            self.record, self.next, self.sha, self.size = record, 0, hashlib.sha1(), 0
            if not data.startswith(b"WARC/1.1\r\n"):
                raise ValueError("no WARC record")
            self.warc = _fields(data[:end])
            http_end = data.index(b"\r\n\r\n", end + 4)
            self.http = _fields(data[end + 4 : http_end])
            self.http_size = http_end + 4 - (end + 4)
            body = body[http_end + 4 :]
        if record != self.record or number != self.next:
            raise ValueError(f"chunk {number} of record {record} isn't the next one")
        self.next += 1
        if last:
            if bytes(body[-4:]) != b"\r\n\r\n":
                raise ValueError("a record doesn't end with two line ends")
            body = body[:-4]
        revisit = self.warc["warc-type"] == "revisit"
        if not revisit:
            self.sha.update(body)
            self.size += len(body)
            if self.sha.hexdigest() != digest:
                raise ValueError(f"record {record} is damaged before the end of chunk {number}")
        if not last:
            return None
        self.record = None
        told = self.warc["warc-payload-digest"].removeprefix("sha1:")
        size = int(self.http["content-length"])
        if int(self.warc["content-length"]) != self.http_size + self.size or not revisit and (self.size != size or base32(self.sha.digest()) != told):
            raise ValueError(f"record {record} isn't as its head says")
        page = lambda x: None if x == "None" else int(x)
        ident = self.warc["warc-record-id"][len("<urn:page:") : -1]
        refers = self.warc["warc-refers-to"][len("<urn:page:") : -1] if revisit else "None"
        return page(ident), self.warc["warc-target-uri"], size, told, self.warc["warc-type"], page(refers)


_FOUND_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each record, verified chunk by chunk."""
    ship(spark)
    chunks = spark.read.parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()

        def found() -> Iterator[tuple]:
            for batch in batches:
                for record, number, last, digest, data in zip(*[c.to_pylist() for c in batch.columns[:4]], batch.column(4), strict=True):
                    if (row := reader.feed(record, number, last, digest, data.as_py())) is not None:
                        yield row

        yield from _batched(found(), _FOUND_ARROW)

    alone = chunks.where("chunk_no = 0 and last")
    long = chunks.where("not (chunk_no = 0 and last)").repartition("record").sortWithinPartitions("record", "chunk_no")
    return alone.mapInArrow(run, _FOUND).unionByName(long.mapInArrow(run, _FOUND))
