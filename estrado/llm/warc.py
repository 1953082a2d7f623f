"""WARC archives: writing captures with identical-payload revisits, and transaction assembly on reading.

A capture is three records: a response (or a revisit of an earlier payload), its request and its metadata, the
latter two naming the first in WARC-Concurrent-To. Archives are written by Spark's text sink with the
record terminator as line separator, so they go to any store that Spark writes to, and read as binary files, record
by record by Content-Length, so payloads may hold any bytes.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stored
from .streams import few, keyed

CRLF = "\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits in four groups of 40, each 8 digits of 5 bits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 10 * g + 1, 10), 16, 32), 8, "0") for g in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}:"), key.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: Column, rid: Column, uri: Column, date: str, content_type: str, block: Column, more: list[tuple[str, Column]]) -> Column:
    """A record without its terminator; a field whose value is null is left out."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri), *more, ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string"))]
    head = F.concat_ws(CRLF, F.lit("WARC/1.1"), *(F.concat(F.lit(f"{k}: "), v) for k, v in fields))
    return F.concat(head, F.lit(END), block)


def plan_captures(pages: DataFrame, least: int = 0) -> tuple[DataFrame, int]:
    """pages (page_id, url, html) -> _key, page_id, url, payload, bytes, digest, head, head_page: what each capture refers to.

    Of equal payloads of at least ``least`` bytes the one with the largest page_id is the head (null ids come first; of
    repeated rows one is the head); head is null for captures that are written as responses. Also returns the bytes of all payloads.
    """
    p = keyed(pages.select("page_id", "url", "html"), id_col="page_id", text_col="html", nulls_first=True)
    p = p.select("_key", F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    # who revisits whom is found from digests; payloads stay where they lie
    slim = stored(p.select("_key", "page_id", "digest", "bytes"), "digests")
    total = slim.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    slim = slim.where(F.col("bytes") >= least)
    heads = slim.groupBy("digest").agg(F.max(F.struct("_key", "page_id")).alias("h"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "h")
    revisits = slim.select("_key", "digest").join(heads, "digest").where(F.col("h._key") != F.col("_key")).select("_key", F.col("h._key").alias("head"), F.col("h.page_id").alias("head_page"))
    joined = p.join(few(stored(revisits, "revisits"), 1_000_000), "_key", "left")
    return joined.select("_key", "page_id", "url", "payload", "bytes", "digest", "head", "head_page"), total


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z", bytes_per_file: int = 64 << 20, records_per_file: int = 100_000) -> None:
    """Writes the captures of ``pages`` (page_id, url, html, any more) as gzip-compressed WARC files below ``path``.

    Captures are dealt by a hash of their keys to as many files as give each about half of ``bytes_per_file`` before compression; a very long page adds its own length.
    Null html is an empty payload, a null url gives records without target. An empty table gives an empty archive.
    """
    p, total = plan_captures(pages, least)
    p = p.repartition(max(1, -(-2 * total // bytes_per_file)), F.xxhash64("_key"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    status = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: ")
    http = F.concat(status, F.col("bytes").cast("string"), F.lit(END))
    rid, digest = record_id("response", F.col("_key")), F.concat(F.lit("sha1:"), F.col("digest"))
    response = _record(F.lit("response"), rid, uri, date, "application/http;msgtype=response", F.concat(http, F.col("payload")), [("WARC-Payload-Digest", digest)])
    revisit = _record(F.lit("revisit"), rid, uri, date, "application/http;msgtype=response", http, [
        ("WARC-Payload-Digest", digest), ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", record_id("response", F.col("head"))), ("WARC-Truncated", F.lit("length"))])
    host = F.coalesce(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)", 1), F.lit("")), F.lit("unknown"))
    asked = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(END))
    request = _record(F.lit("request"), record_id("request", F.col("_key")), uri, date, "application/http;msgtype=request", asked, [("WARC-Concurrent-To", rid)])
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    facts = F.concat(F.lit("page-id: "), text("page_id"), F.lit(f"{CRLF}payload-bytes: "), text("bytes"), F.lit(f"{CRLF}refers-to-page: "), text("head_page"), F.lit(CRLF))
    metadata = _record(F.lit("metadata"), record_id("metadata", F.col("_key")), uri, date, "application/warc-fields", facts, [("WARC-Concurrent-To", rid)])
    lines = p.select(F.explode(F.array(request, F.when(F.col("head").isNull(), response).otherwise(revisit), metadata)).alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class _Reader:
    """Bytes of a possibly compressed archive, unpacked as they are asked for; several gzip members may follow each other."""

    def __init__(self, data: bytes, step: int = 1 << 20):
        self.data, self.at, self.step, self.have = data, 0, step, bytearray()
        self.unzip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def fill(self) -> bool:
        if self.unzip is None:
            part = self.data[self.at : self.at + self.step]
            self.at += len(part)
            self.have += part
            return bool(part)
        while True:
            if self.unzip.eof:
                rest = self.unzip.unused_data
                self.at -= len(rest)
                if self.at >= len(self.data):
                    return False
                self.unzip = zlib.decompressobj(31)
            part = self.unzip.unconsumed_tail or self.data[self.at : self.at + self.step]
            if not self.unzip.unconsumed_tail:
                self.at += len(part)
            if not part:
                return False
            got = self.unzip.decompress(part, 4 * self.step)
            if got:
                self.have += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.have.find(mark, start)) < 0:
            start = max(0, len(self.have) - len(mark))
            if not self.fill():
                return None
        out = bytes(self.have[:i])
        del self.have[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.have) < n:
            if not self.fill():
                raise ValueError("a WARC record ends before its Content-Length")
        out = bytes(self.have[:n])
        del self.have[:n]
        return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record of an archive."""
    src = _Reader(data)
    while (head := src.until(END.encode())) is not None:
        version, _, rest = head.decode("utf-8", "surrogateescape").lstrip(CRLF).partition(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest.split(CRLF))}
        yield fields, src.take(int(fields["content-length"]))
        src.take(len(END))


RECORDS = "kind string, rid string, concurrent_to string, refers_to string, uri string, digest string, bytes long, facts map<string,string>, payload binary"


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives below ``path``. For responses digest and bytes are those of the payload read, and a
    digest that differs from the recorded one is an error; for revisits digest is the recorded one. facts: a metadata record's fields."""

    def rows(data: bytes) -> Iterator[tuple]:
        for f, block in parse(data):
            kind, digest, size, facts, payload = f["warc-type"], None, None, None, None
            if kind in ("response", "revisit"):
                digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
            if kind == "response":
                payload = block.partition(END.encode())[2]
                size, real = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if digest is not None and digest != real:
                    raise ValueError(f"payload of {f['warc-record-id']} doesn't match its digest")
                digest = real
            elif kind == "metadata":
                facts = [(k, v.strip()) for k, _, v in (x.partition(":") for x in block.decode().split(CRLF) if x)]
            yield kind, f.get("warc-record-id"), f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), digest, size, facts, payload if payloads else None

    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [*[pa.string()] * 6, pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def pack(found: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                held, size = [], 0
                for r in rows(data.as_py()):
                    held.append(r)
                    size += 200 + len(r[-1] or b"")
                    if size > 8 << 20:
                        yield pack(held)
                        held, size = [], 0
                if held:
                    yield pack(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """records (as of ``read_records``) -> one nested row per capture: capture_id, response, request, metadata.

    Records are joined through concurrent-to identifiers: a request or metadata record belongs to the record it names, any
    other to itself. A capture has a handful of records, so this is one shuffle on unique identifiers. Parts that are missing are null.
    """
    r = records.withColumn("capture_id", F.coalesce("concurrent_to", "rid"))
    response = F.struct("kind", "uri", "digest", "bytes", "refers_to", "payload")
    return r.groupBy("capture_id").agg(
        F.any_value(F.when(F.col("kind").isin("response", "revisit"), response), True).alias("response"),
        F.any_value(F.when(F.col("kind") == "request", F.struct("rid", "uri")), True).alias("request"),
        F.any_value(F.when(F.col("kind") == "metadata", F.struct("rid", "facts")), True).alias("metadata"),
    )


def digest_captures(captures: DataFrame) -> DataFrame:
    """One row per assembled capture: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    fact = lambda k: F.nullif(F.col("metadata.facts")[k], F.lit("")).cast("long")
    return captures.where("response is not null").select(
        fact("page-id").alias("page_id"), F.coalesce("response.bytes", fact("payload-bytes")).alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"), F.col("response.kind").alias("record_type"), fact("refers-to-page").alias("refers_to"))
