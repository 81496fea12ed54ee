"""WARC archives: writing, reading, and assembly of transactions.

Every record is a gzip member of its own, so that it can be read from its offset alone.  Writing goes through Spark's text writer, which puts
bytes out as they are, so any storage Spark knows can hold the archives and a lost task is written again.  The writer ends each line with a separator, here a
zero byte: a member ends with the length of what it holds, smallest byte first, and below 16 MiB the last one is zero, so it is left to the
writer.  A longer record is followed by a member that holds nothing.  Members are put together to lines of about LINE_BYTES of records and these to files of
LINES_PER_FILE, so a file holds some hundred megabytes and its last record at most, whatever the pages' sizes.  Each page gives three records of
one transaction: a request, a response (or, where the same payload is stored already, a
revisit that refers to it), and a metadata record; request and metadata name the capture
in WARC-Concurrent-To.

Reading takes whole files as bytes, of one member or many, inflates them piece by piece and cuts records by
Content-Length, so payloads may hold anything.  ``index`` lists where each record's member stands.  Assembly joins the records
of one transaction through their concurrent-to identifiers into one nested row per capture.

Defined results: a null html is an empty payload; a null url is an empty one; of equal payloads
the row with the largest page_id is the response, a null page_id being smallest and equal ones
decided by their place in the input; every row of the input, repeated or not, is a capture;
requests and metadata without a capture are left out, and of several requests of a
capture the smallest identifier counts; a capture's metadata records are one list in its row, however many name it; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import gzip
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table

VERSION = "WARC/1.1"
#: Fixed value of the standard: the profile of a revisit with an identical payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: What follows every record.
END = b"\r\n\r\n"
#: The last byte of a member whose record is shorter than 16 MiB, which the text writer puts after each line.
SEPARATOR = b"\0"
#: Bytes of records that are written as one line, and lines of a file.
LINE_BYTES = 8 << 20
LINES_PER_FILE = 16
#: Payloads of at least this many bytes are stored once.
LEAST_PAYLOAD = 0
#: Compressed bytes given to the inflater at once; many members' bytes, as what follows one is copied.
PIECE = 1 << 16
#: Payload bytes of a batch of records that were read.
READ_BYTES = 1 << 20

RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, headers map<string,string>, payload binary"


def base32_sha1(payload: F.Column) -> F.Column:
    """Upper-case base32 of SHA-1: 20 bits, 5 hexadecimal digits, are 4 base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str, record_id, uri, body, *headers) -> F.Column:
    """The record as text, without the separator that ends it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    parts = [F.lit(f"{VERSION}\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\n"), line("WARC-Record-ID", record_id), line("WARC-Target-URI", uri)]
    parts += [line(n, v) for n, v in headers]
    return F.concat(*parts, line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body)


def write(pages: DataFrame, path: str, scratch: Scratch, codec: str = "gzip") -> None:
    """Archive every row of ``pages`` (page_id, url, html) under ``path``; ``codec`` is gzip or none."""
    if codec not in ("gzip", "none"):
        raise ValueError(f"archives are written with gzip or none, not {codec}")
    clean = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\\r\\n]", " ")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), clean.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    rows = scratch.save(rows, "captures", "zstd")
    # the stored one of each digest that recurs: Spark broadcasts these where they are few, and no payload is moved; else the
    # join deals both sides, and as they are written, adaptive execution can split a hot digest
    # null page_ids come first in a struct's order
    first = rows.groupBy("digest").agg(F.max(F.struct("page_id", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = scratch.save(first.where("n > 1").select("digest", "first"), "first")
    rows = rows.join(first, "digest", "left")
    name = lambda kind, at: F.concat(F.lit(f"<urn:weftline:{kind}:"), at.cast("string"), F.lit(">"))
    own, page = name("capture", F.col("at")), F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    stored = (F.octet_length("html") < LEAST_PAYLOAD) | F.col("first").isNull() | (F.col("first.at") == F.col("at"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    status = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    # url without control characters: any other byte may stand in a request line of an archive
    request = F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n"))
    capture = F.when(stored, _record("response", own, F.col("url"), F.concat(status, F.col("html")), http, digest)).otherwise(
        _record("revisit", own, F.col("url"), status, http, digest, ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", name("capture", F.col("first.at"))))
    )
    concurrent = ("WARC-Concurrent-To", own)
    records = F.array(
        _record("request", name("request", F.col("at")), F.col("url"), request, ("Content-Type", F.lit("application/http; msgtype=request")), concurrent),
        capture,
        _record("metadata", name("metadata", F.col("at")), F.col("url"), F.concat(F.lit("page-id: "), page, F.lit("\r\n")), ("Content-Type", F.lit("application/warc-fields")), concurrent),
    )
    members = codec == "gzip"
    out = rows.select(F.explode(records).alias("value")).mapInArrow(_lines(LINE_BYTES, members), "value binary").select(F.col("value").cast("string"))
    separator = SEPARATOR if members else END
    out.write.mode("overwrite").option("lineSep", separator.decode()).option("compression", "none").option("maxRecordsPerFile", LINES_PER_FILE).text(path)


def _lines(limit: int, members: bool):
    """Joins records, as members or as they are, to lines of ``limit`` bytes of records, or of one longer record."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for record in (r for part in slices(batch, 0) for r in part.column(0).cast(pa.binary()).to_pylist()):
                if size and size + len(record) > limit:
                    yield _line(held, members)
                    held, size = [], 0
                held.append(member(record + END) if members else record)
                size += len(record) + len(END)
        if held:
            yield _line(held, members)

    return run


def member(record: bytes) -> bytes:
    """A gzip member, or two where the second holds nothing, that ends with SEPARATOR."""
    out = gzip.compress(record, 6, mtime=0)
    return out if out.endswith(SEPARATOR) else out + gzip.compress(b"", mtime=0)


def _line(held: list, members: bool) -> pa.RecordBatch:
    line = b"".join(held)[: -len(SEPARATOR)] if members else END.join(held)
    return pa.RecordBatch.from_arrays([pa.array([line], pa.binary())], ["value"])


def parse(pieces):
    """Records of one archive, given as pieces of bytes: (headers, block)."""
    held = bytearray()
    at = 0
    pieces = iter(pieces)

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        del held[:at]
        at = 0
        held.extend(piece)
        return True

    while True:
        while held[at : at + 2] == b"\r\n":  # after the record before
            at += 2
        end = held.find(b"\r\n\r\n", at)
        if end < 0:
            if more():
                continue
            return
        headers = _headers(held[at:end])
        size = int(headers["content-length"])
        at = end + 4
        while len(held) < at + size:
            if not more():
                raise ValueError("an archive ends inside a record")
        yield headers, bytes(held[at : at + size])
        at += size


def _members(raw: bytes):
    """Members of a gzip file piece by piece: (offset, inflated bytes, length at the member's last piece and else None)."""
    view, start, at, machine = memoryview(raw), 0, 0, zlib.decompressobj(31)
    while at < len(raw):
        piece = view[at : at + PIECE]
        out = machine.decompress(piece)
        at += len(piece) - len(machine.unused_data)
        yield start, out, at - start if machine.eof else None
        if machine.eof:
            start, machine = at, zlib.decompressobj(31)
    if start < at:
        raise ValueError("an archive ends inside a member")


def _inflated(raw: bytes):
    """Pieces of a file, which may be gzip of one member or many, or plain."""
    if raw[:2] == b"\x1f\x8b":
        yield from (out for _, out, _ in _members(raw) if out)
    else:
        yield raw


def _headers(head: bytes) -> dict:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record here: {lines[0][:40]!r}")
    fields = (line.partition(":") for line in lines[1:])
    return {name.strip().lower(): value.strip() for name, _, value in fields}


def index(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives of a member a record under ``path``: its file and its member's offset and length.

    The bytes there are a gzip file of their own.  Files that are not gzip have no rows; a member that begins no record is an error unless it is empty.
    """

    def run(batches):
        names = ["path", "offset", "length", "record_id", "record_type", "target_uri", "payload_digest"]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw, rows, head = raw.as_py(), [], b""
                for offset, out, length in _members(raw) if raw[:2] == b"\x1f\x8b" else ():
                    if END not in head:
                        head += out
                    if length is None:
                        continue
                    if head:
                        h = _headers(head.partition(END)[0])
                        digest = h.get("warc-payload-digest", "").rpartition(":")[2] or None
                        rows.append((file, offset, length, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), digest))
                    head = b""
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    places = "path string, offset long, length long, record_id string, record_type string, target_uri string, payload_digest string"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, places)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives under ``path``."""

    def run(batches):
        names = ["record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "payload_digest", "headers", "payload"]
        kinds = [pa.string()] * 6 + [pa.map_(pa.string(), pa.string()), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for headers, block in parse(_inflated(batch.column(0)[i].as_py())):
                    kind = headers.get("warc-type", "")
                    if kind in ("response", "revisit", "request"):  # the payload follows the HTTP head
                        block = block.partition(b"\r\n\r\n")[2]
                    digest = headers.get("warc-payload-digest", "")
                    rows.append((headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), digest.rpartition(":")[2] or None, list(headers.items()), block))
                    size += len(block)
                    if size > READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


CAPTURE = ("record_type", "refers_to", "target_uri", "payload_digest", "payload")


def assemble(records: DataFrame, fields: tuple = CAPTURE) -> DataFrame:
    """capture_id, request, capture, metadata: one nested row for each response or revisit.

    The records that name a capture meet it by identifier, requests as the smallest one and metadata as a list.  ``fields`` are the
    columns of ``records`` that the capture has: one who needs facts of payloads only adds them to ``records`` and leaves the payloads where they are read.
    """
    captures = records.where(F.col("record_type").isin("response", "revisit"))
    captures = captures.select(F.col("record_id").alias("capture_id"), F.struct(*fields).alias("capture"))
    others = records.where(F.col("record_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    is_request = F.col("record_type") == "request"
    others = others.groupBy(F.col("concurrent_to").alias("capture_id")).agg(
        F.min(F.when(is_request, F.struct("record_id", "target_uri"))).alias("request"),
        F.sort_array(F.collect_list(F.when(~is_request, F.struct("record_id", "payload")))).alias("metadata"),
    )
    return captures.join(others, "capture_id", "left")


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op1")
    path = scratch.path("archive")
    write(table(spark, sf_dir, "pages"), path, scratch)
    records = read(spark, path).withColumn("n", F.length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    captures = assemble(records, ("record_type", "refers_to", "n", "digest"))
    page = F.regexp_extract(F.col("metadata")[0]["payload"].cast("string"), "page-id: (-?[0-9]+)", 1)
    captures = captures.select("capture_id", F.col("request.target_uri").alias("request_uri"), F.when(page != "", page.cast("long")).alias("page_id"), F.col("capture.record_type").alias("record_type"), F.col("capture.refers_to").alias("of"), "capture.n", "capture.digest")
    captures = scratch.save(captures, "assembled")
    # a revisit has the payload of the response it refers to
    stored = captures.where("record_type = 'response'").select(F.col("capture_id").alias("of"), F.col("page_id").alias("of_page"), F.col("n").alias("of_n"), F.col("digest").alias("of_digest"))
    responses = captures.where("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), "request_uri")
    revisits = captures.where("record_type = 'revisit'").join(stored, "of").select("page_id", F.col("of_n").alias("payload_bytes"), F.col("of_digest").alias("payload_digest"), "record_type", F.col("of_page").alias("refers_to"), "request_uri")
    return responses.union(revisits)


OP1_SQL = """
WITH p AS (SELECT page_id, trim(regexp_replace(coalesce(url, ''), '[\r\n]', ' ', 'g')) AS request_uri, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, request_uri, strlen(html) AS n, translate(
  lpad(to_base(('0x' || h[1:5])::BIGINT, 32), 4, '0') || lpad(to_base(('0x' || h[6:10])::BIGINT, 32), 4, '0') ||
  lpad(to_base(('0x' || h[11:15])::BIGINT, 32), 4, '0') || lpad(to_base(('0x' || h[16:20])::BIGINT, 32), 4, '0') ||
  lpad(to_base(('0x' || h[21:25])::BIGINT, 32), 4, '0') || lpad(to_base(('0x' || h[26:30])::BIGINT, 32), 4, '0') ||
  lpad(to_base(('0x' || h[31:35])::BIGINT, 32), 4, '0') || lpad(to_base(('0x' || h[36:40])::BIGINT, 32), 4, '0'),
  '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to, request_uri
FROM w
"""
