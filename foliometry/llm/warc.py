"""WARC archives: writing captures as request, response or revisit, and metadata records,
and assembling the transactions again through their concurrent-to identifiers.

Records are text (headers, then UTF-8 HTML), so Spark's text writer makes the files:
its line separator is the blank lines that end a record. The files are committed by
Spark, compressed as one stream, of about FILE_BYTES each, and any WARC reader can read them. The reader
takes archives of one or many gzip members, or none, and holds one record at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitfilter import filter_of, marks
from .common import null_safe, shared_path, written

END = "\r\n\r\n"
#: The base-32 alphabet of RFC 4648.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes of a file before compression, by the mean size of a capture; bytes that the reader gives out together.
FILE_BYTES, BATCH = 32 << 20, 4 << 20
#: A record's header is broken if it is longer.
MOST_HEADER = 1 << 20
KINDS = {"response": "01", "revisit": "01", "request": "02", "metadata": "03"}


def base32(digits: Column) -> Column:
    """Upper-case base 32 of forty hex digits: five of them give four letters."""
    groups = []
    for i in range(8):
        value = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        groups += [F.substring(F.lit(ALPHABET), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*groups)


def record_id(page_id: Column, digest: Column, kind: str) -> Column:
    """A URN of the page id, the record's kind and the payload: repeated rows give equal ids."""
    known = F.when(page_id.isNull(), "8").otherwise("0")
    low = F.lpad(F.hex(F.coalesce(page_id, F.lit(0))), 16, "0")
    rest = F.concat(known, F.lit(KINDS[kind]), F.substring(F.sha1(digest.cast("binary")), 1, 13))
    digits = F.concat(low, rest)
    cut = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.lower(F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">")))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit("WARC/1.0\r\n")]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def with_decisions(pages: DataFrame) -> DataFrame:
    """page_id, url, html, bytes, digest, first_page: the smallest page_id of an equal payload.

    A null id comes after all others. Equal means equal SHA-1 and length. Only pages whose payload
    may be repeated, by a filter of bounded size, move to meet the smallest id.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha1(F.col("html").cast("binary"))})
    many = rows.groupBy("digest", "bytes").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    many = written(many, "payloads")
    mark = marks(filter_of(many, "digest"), F.col("digest"))
    alone = rows.where(~mark).withColumn("first_page", F.col("page_id"))
    met = rows.where(mark).join(many, ["digest", "bytes"], "left").withColumn("first_page", F.when(F.col("n").isNull(), F.col("page_id")).otherwise(F.col("first_page")))
    return alone.unionByName(met.drop("n"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes for each page a response or revisit record, a request and a metadata record."""
    n, size = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col("html").cast("string")).cast("long")), F.lit(0))).first()
    captures = max(1, FILE_BYTES // (size // max(1, n) + 1_000))
    rows = with_decisions(pages).withColumn("payload_digest", base32(F.col("digest")))
    page, digest = F.col("page_id"), F.col("payload_digest")
    clean = F.regexp_replace("url", r"[\x00-\x20\x7f]", "_")
    length = F.col("bytes").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit(END))
    own, date = record_id(page, digest, "response"), ("WARC-Date", F.lit("2024-01-01T00:00:00Z"))
    uri = ("WARC-Target-URI", clean)
    hashed = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest))
    answer = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _record([("WARC-Type", F.lit("response")), ("WARC-Record-ID", own), date, uri, hashed, answer], F.concat(http, F.col("html")))
    profile = ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))
    refers = ("WARC-Refers-To", record_id(F.col("first_page"), digest, "response"))
    revisit = _record([("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", own), date, uri, hashed, refers, profile, answer], http)
    together = ("WARC-Concurrent-To", own)
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", record_id(page, digest, "request")), date, uri, together, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.coalesce(clean, F.lit("/")), F.lit(" HTTP/1.1" + END)))
    meta = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", record_id(page, digest, "metadata")), date, uri, together, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("payloadLength: "), length, F.lit("\r\n")))
    main = F.when(page.eqNullSafe(F.col("first_page")), response).otherwise(revisit)
    records = rows.select(F.explode(F.array(request, main, meta)).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 3 * captures).text(path)


RECORD_SCHEMA = "record_id string, type string, concurrent_to string, refers_to string, uri string, payload_digest string, computed_digest string, payload_bytes long, body binary"


def _pieces(data: bytes) -> Iterator[bytes]:
    """An archive's content, unpacked if need be, a little at a time; it ends where a gzip stream is damaged."""
    step, at = 1 << 18, 0
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + step] for i in range(0, len(data), step))
        return
    member = zlib.decompressobj(31)
    while at < len(data):
        try:
            out = member.decompress(data[at : at + step])
        except zlib.error:
            return
        at += step
        if member.eof:  # the next member, if any, begins where this one ends
            at = min(at, len(data)) - len(member.unused_data)
            member = zlib.decompressobj(31)
        yield out


def parse(data: bytes) -> Iterator[dict]:
    """The records of one archive's content, read by their declared lengths.

    A record without a sound Content-Length, or cut short, is of type ``broken`` and has no block; reading
    goes on at the next record that follows.
    """
    pieces, held = _pieces(data), bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (at := held.find(b"WARC/1.")) < 0:
            del held[: max(0, len(held) - 6)]
            if not more():
                return
        del held[:at]
        while (stop := held.find(b"\r\n\r\n")) < 0 and len(held) < MOST_HEADER and more():
            pass
        head = {}
        for line in bytes(held[:stop] if stop >= 0 else b"").decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        length = head.get("content-length", "")
        if not (length.isascii() and length.isdecimal()):
            yield {"warc-type": "broken", "block": b""}
            del held[:7]
            continue
        begin, end = stop + 4, stop + 4 + int(length)
        while len(held) < end and more():
            pass
        if len(held) < end:
            yield {"warc-type": "broken", "block": b""}
            del held[:7]
            continue
        block = bytes(held[begin:end])
        del held[:end]
        yield head | {"block": block}


def _http(block: bytes) -> tuple[bytes, bytes]:
    """Head and body of a message; a block of another protocol is all body."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, _, body = block.partition(b"\r\n\r\n")
    return head, body


def _declared(head: bytes) -> int | None:
    """The Content-Length of a message's head; none if it is not there or not a number."""
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


def read_archives(spark: SparkSession, path: str, with_body: bool = True) -> DataFrame:
    """One row a record. ``with_body``: also the payload of responses, the block of the others, as bytes."""
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in RECORD_SCHEMA.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out: list[list] = [[] for _ in names]
                held = 0
                for r in parse(content.as_py()):
                    kind, block = r.get("warc-type"), r["block"]
                    length = computed = None
                    if kind in ("response", "revisit"):
                        head, block = _http(block)
                        length = len(block) if kind == "response" else _declared(head)
                    if kind == "response":
                        computed = b32encode(hashlib.sha1(block).digest()).decode()
                    row = (r.get("warc-record-id"), kind, r.get("warc-concurrent-to"), r.get("warc-refers-to"), r.get("warc-target-uri"), r.get("warc-payload-digest", "").removeprefix("sha1:") or None, computed, length, block if with_body and kind != "broken" else None)
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                    held += len(block)
                    if held > BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
                        out, held = [[] for _ in names], 0
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(rows, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, response, request, metadata.

    ``response`` is the response or revisit record; requests and metadata find it through
    their concurrent-to identifier. Repeated captures (equal record ids) stay as many rows;
    of several requests or metadata records for one capture the least counts. A capture
    without one has null there; one without a response is not a capture and goes.
    """
    fields = ["record_id", "type", "uri", "refers_to", "payload_digest", "computed_digest", "payload_bytes", "body"]
    main = records.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), F.struct(*fields).alias("response"))
    side = records.where(F.col("concurrent_to").isNotNull() & F.col("type").isin("request", "metadata"))
    part = F.struct("record_id", "uri", "body")
    side = side.groupBy(F.col("concurrent_to").alias("c")).agg(*(F.min(F.when(F.col("type") == t, part)).alias(t) for t in ("request", "metadata")))
    return main.join(side, null_safe((F.col("capture_id"), F.col("c"))), "left").drop("c")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, n_parts of each page,
    written to archives in the shared folder and read back. Bytes and digest of a response
    are those of the body that was read and assembled.

    Null html is the empty payload, and empty payloads are equal to each other. Of rows with
    equal payload and the same smallest page_id each is a response. A null page_id is kept,
    as larger than all. Null urls leave the header out. No rows give no rows.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    captures = assemble(read_archives(spark, path))
    return captures.select(*columns_of(captures))


def _page(urn: Column) -> Column:
    """The page id within a record's URN: sixteen hex digits in two's complement."""
    digits = F.translate(F.substring(urn, 11, 36), "-", "")
    half = lambda a: F.conv(F.substring(digits, a, 8), 16, 10).cast("long")
    value = F.shiftleft(half(1), 32).bitwiseOR(half(9))
    return F.when(F.substring(digits, 17, 1) == "0", value)


def columns_of(captures: DataFrame) -> list[Column]:
    r = F.col("response")
    whole = r["type"] == "response"
    return [
        _page(F.col("capture_id")).alias("page_id"),
        F.when(whole, F.octet_length(r["body"]).cast("long")).otherwise(r["payload_bytes"]).alias("payload_bytes"),
        F.when(whole, base32(F.sha1(r["body"].cast("binary")))).otherwise(r["payload_digest"]).alias("payload_digest"),
        r["type"].alias("record_type"),
        _page(r["refers_to"]).alias("refers_to"),
        (F.lit(1) + F.col("request").isNotNull().cast("int") + F.col("metadata").isNotNull().cast("int")).cast("int").alias("n_parts"),
    ]


ORACLE = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY d, payload_bytes) AS first_page FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(d, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to,
       3 AS n_parts
FROM m
"""
