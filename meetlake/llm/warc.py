"""WARC archives of pages: written by Spark's text sink, read back whole, segmented records put together again.

A record's lines and block are one text value, and the two line ends that close a record are the sink's line separator, so
the files are WARC files, gzip-compressed as a whole. Payloads are framed as chunked HTTP responses; a block longer than
``segment`` bytes is cut into a first record and continuation records. Revisits of an equal payload have no body: they name the
response's page and address.

The reader takes the files as binaries (each holds a bounded number of bounded records), parses them by Content-Length, groups
continuation records by their origin's id, orders them by segment number, verifies the total length and decodes the chunked
framing. Only records that are cut send their blocks through that shuffle.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.llm.registry import query
from meetlake.llm.shared import shared_folder, staged, table

SEGMENT, CHUNK_BYTES = 1 << 14, 1 << 12
#: Records a file holds at most: with records of a segment, a file has at most 32 MB.
RECORDS_A_FILE = 2000
#: fixed values of the format
VERSION, END, LINE = b"WARC/1.1", b"\r\n\r\n", b"\r\n"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2024-01-01T00:00:00Z"


def digest(payload: bytes) -> bytes:
    return base64.b32encode(hashlib.sha1(payload).digest())


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at:at + size]
        parts += [b"%x\r\n" % len(piece), piece, LINE]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = body.index(LINE, at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2:end + 2 + size])
        if body[end + 2 + size:end + 4 + size] != LINE:
            raise ValueError("a chunk does not end where its size says")
        at = end + 4 + size


def _record(headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    lines = [VERSION, *(k + b": " + v for k, v in headers if v), b"Content-Length: %d" % len(block)]
    return LINE.join(lines) + END + block


def records(ident: bytes, page: bytes, url: bytes, payload: bytes, first: tuple[bytes, bytes] | None,
            segment: int = SEGMENT) -> list[bytes]:
    """The records of one page; ``first`` is the page and address of the response that it revisits."""
    common = [(b"WARC-Record-ID", ident), (b"WARC-Date", DATE), (b"WARC-Target-URI", url), (b"Page-Id", page),
              (b"WARC-Payload-Digest", b"sha1:" + digest(payload)), (b"Payload-Length", b"%d" % len(payload)),
              (b"Content-Type", b"application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if first is not None:
        return [_record([(b"WARC-Type", b"revisit"), *common, (b"WARC-Profile", REVISIT_PROFILE),
                         (b"Refers-To-Page", first[0]), (b"WARC-Refers-To-Target-URI", first[1])], head)]
    block = head + chunked(payload)
    if len(block) <= segment:
        return [_record([(b"WARC-Type", b"response"), *common], block)]
    cuts = range(0, len(block), segment)
    out = [_record([(b"WARC-Type", b"response"), *common, (b"WARC-Segment-Number", b"1")], block[:segment])]
    for number, at in enumerate(cuts[1:], 2):
        last = [(b"WARC-Segment-Total-Length", b"%d" % len(block))] if at + segment >= len(block) else []
        out.append(_record([(b"WARC-Type", b"continuation"), (b"WARC-Record-ID", ident[:-1] + b"#%d>" % number),
                            (b"WARC-Date", DATE), (b"WARC-Target-URI", url), (b"WARC-Segment-Origin-ID", ident),
                            (b"WARC-Segment-Number", b"%d" % number), *last], block[at:at + segment]))
    return out


_URI_BREAK = re.compile(rb"[\x00-\x20\x7f]")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  least: int = 0, segment: int = SEGMENT) -> None:
    """Write every row of pages as WARC records below ``path``.

    Of payloads of at least ``least`` bytes that are equal (by SHA-1 and length), the row with the least id is the response
    and the others revisit it. Null payloads are empty. Rows without an id are never the response if a row with an id
    is equal; rows without ids alone are responses all. Rows that repeat the response's id are responses as well. Control
    characters and blanks in addresses are written as percent codes.
    """
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page"), F.col(url_col).alias("url"), body.alias("payload"))
    digests = rows.where(F.octet_length("payload") >= least).select(
        "page", "url", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size"))
    # copies are found without their payloads; a payload that a third of all pages share is one small row a task
    firsts = (digests.where("page is not null").groupBy("sha", "size")
              .agg(F.min(F.struct("page", F.coalesce("url", F.lit("")).alias("url"))).alias("first")))
    copies = staged(digests.join(firsts, ["sha", "size"]).where("not page <=> first.page")
                    .select(F.coalesce("page", F.lit(-(2**63))).alias("of"), "sha", "first").distinct(), "copies")
    keyed = rows.select("*", F.coalesce("page", F.lit(-(2**63))).alias("of"), F.sha1("payload").alias("sha"))
    met = keyed.join(copies, ["of", "sha"], "left").select("page", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            held, size = [], 0
            for page, url, payload, first in zip(*(batch.column(c) for c in ("page", "url", "payload", "first")), strict=True):
                number = str(page.as_py()).encode() if page.is_valid else b""
                address = _URI_BREAK.sub(lambda m: b"%%%02X" % m[0][0], (url.as_py() or "").encode())
                # unique in one run of the job: a task that runs again writes its own file anew
                ident = b"<urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, f"{part}/{count}")).encode()
                count += 1
                known = first.as_py()
                of = known and (str(known["page"]).encode(), _URI_BREAK.sub(lambda m: b"%%%02X" % m[0][0], known["url"].encode()))
                for one in records(ident, number, address, payload.as_py(), of, segment):
                    held.append(one)
                    size += len(one)
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])

    # a string keeps the bytes of a binary as they are, so records can be cut within a character
    (met.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", (END).decode()).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_A_FILE).text(path))


def parse(raw: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Headers (names in lower case) and block of every record of an archive."""
    at = 0
    while at < len(raw):
        end = raw.index(END, at)
        lines = raw[at:end].split(LINE)
        if lines[0] != VERSION:
            raise ValueError("no WARC record where one should begin")
        headers = {k.lower(): v for k, v in (line.split(b": ", 1) for line in lines[1:])}
        start = end + 4
        at = start + int(headers[b"content-length"])
        yield headers, raw[start:at]
        if raw[at:at + 4] != END:
            raise ValueError("a record does not end where its length says")
        at += 4


_FIELDS = ("origin string, number int, total bigint, page_id bigint, url string, record_type string, refers_to bigint, "
           "declared_digest string, declared_bytes bigint, block binary, payload binary")


def _int(value: bytes | None) -> int | None:
    return int(value) if value else None


def _text(value: bytes | None) -> str | None:
    return value.decode() if value else None


def _payload(block: bytes) -> bytes:
    return dechunked(block[block.index(END) + 4:])


def _parsed(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _FIELDS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(),
                 pa.binary(), pa.binary()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for h, block in parse(gzip.decompress(content.as_py())):
                    number = _int(h.get(b"warc-segment-number"))
                    kind = h[b"warc-type"].decode()
                    declared = h.get(b"warc-payload-digest", b"").removeprefix(b"sha1:")
                    payload = None
                    if number is None and kind == "response":
                        payload, block = _payload(block), None
                        if digest(payload) != declared:
                            raise ValueError("a payload does not have its digest")
                        payload = payload if keep_payload else None
                    elif number is None:
                        block = None
                    rows.append((_text(h.get(b"warc-segment-origin-id") or h[b"warc-record-id"]), number,
                                 _int(h.get(b"warc-segment-total-length")), _int(h.get(b"page-id")),
                                 _text(h.get(b"warc-target-uri")), kind, _int(h.get(b"refers-to-page")), _text(declared),
                                 _int(h.get(b"payload-length")), block, payload))
                    size += len(block or b"") + len(payload or b"")
                    if size >= 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)
    return run


def _assembled(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            declared, payloads = batch.column("declared_digest").to_pylist(), []
            for k, (parts, whole) in enumerate(zip(batch.column("parts"), batch.column("payload"))):
                parts = parts.as_py()
                if not parts:
                    payloads.append(whole.as_py())
                    continue
                parts.sort(key=lambda p: p["number"])
                block = b"".join(p["block"] for p in parts)
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
                    raise ValueError("segments are missing or have another total length")
                payload = _payload(block)
                if digest(payload).decode() != declared[k]:
                    raise ValueError("a payload does not have its digest")
                payloads.append(payload if keep_payload else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (
                "page_id", "url", "record_type", "refers_to", "declared_digest", "declared_bytes")), pa.array(payloads, pa.binary())],
                ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])
    return run


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per page written: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload.

    The digest and length are those of the full payload, checked against the payload itself for responses; a revisit's are
    those that its record declares. ``payload`` is null for revisits, and for all rows without ``payloads``.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    fields = files.mapInArrow(_parsed(payloads), _FIELDS)
    origins = fields.groupBy("origin").agg(
        F.collect_list(F.when(F.col("block").isNotNull(), F.struct("number", "total", "block"))).alias("parts"),
        F.min(F.struct(F.coalesce("number", F.lit(1)), "page_id", "url", "record_type", "refers_to", "declared_digest",
                       "declared_bytes", "payload")).alias("head"))
    schema = ("page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, "
              "payload binary")
    return origins.select("head.*", "parts").mapInArrow(_assembled(payloads), schema)


@query("op5_warc")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
