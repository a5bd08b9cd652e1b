"""WARC archives: write captures, read records back, assemble transactions.

``write`` makes for each page a request, a response and a metadata record, joined by
``WARC-Concurrent-To``.  Of pages with equal payloads of at least ``REVISIT_FROM``
bytes the one with the largest key is the response; the others are revisits that refer
to it and hold no payload.  Equal means equal SHA-1 and length.  The archive is written
by Spark's text writer, one record a row, so it lands wherever Spark can write.

``read`` parses records by their Content-Length, whatever the payload holds.
``assemble`` joins records through their concurrent-to identifiers, in either
direction and over several steps, and gives one nested row per capture.  A capture has
one response or revisit; of several requests or metadata records with one, the one with
the least record id is kept and the numbers are in ``n_requests`` and ``n_metadata``.

Null html is an empty payload.  A null url is written as an empty target.  Repeated rows
are captures of their own: record ids hold the page key and a number that tells equal
keys apart.  Ties between equal keys go to the lower number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage, forget

REVISIT_FROM = 1000
RECORDS_PER_FILE = 1500  # keeps a file small enough to parse in one row

# Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"

RECORD = ("type string, id string, concurrent_to string, target string, date string, payload_digest string, refers_to string, "
          "content_type string, http_length bigint, payload_length bigint, payload_sha1 string, payload binary, fields string")


def _record(kind: Column, ident: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record as text: headers that are not null, an empty line, the block."""
    given = [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    return F.concat(
        F.concat_ws("\r\n", F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <urn:capture:"), ident, F.lit(">")), *given,
                    F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))),
        F.lit(END), block)


def _angled(ident: Column) -> Column:
    return F.concat(F.lit("<urn:capture:"), ident, F.lit(">"))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """One request, one response or revisit, and one metadata record per row, under ``path``."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(key).cast("bigint").alias("__key"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "[\r\n]", "").alias("__url"),
        body.alias("__body"), F.sha1(body.cast("binary")).alias("__digest"), F.octet_length(body).cast("bigint").alias("__size"),
        F.monotonically_increasing_id().alias("__copy"))
    rows = cut_lineage(rows, "captures")  # so that the number of a row stays what it is
    narrow = rows.select("__key", "__copy", "__digest", "__size")
    large = narrow.where(F.col("__size") >= REVISIT_FROM)
    first = large.groupBy("__digest", "__size").agg(F.max(F.struct(F.coalesce("__key", F.lit(-1 << 63)).alias("k"), (-F.col("__copy")).alias("c"))).alias("__top"))
    chosen = large.join(first, ["__digest", "__size"]).where(-F.col("__copy") != F.col("__top.c")).select("__copy", F.col("__top.k").alias("__origin"), (-F.col("__top.c")).alias("__origin_copy"))
    rows = rows.join(chosen, "__copy", "left")
    ident = F.concat_ws("-", F.coalesce(F.col("__key").cast("string"), F.lit("none")), F.col("__copy").cast("string"))
    origin = F.concat_ws("-", F.when(F.col("__origin") != -1 << 63, F.col("__origin").cast("string")).otherwise("none"), F.col("__origin_copy").cast("string"))
    again = F.col("__origin_copy").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("__size").cast("string"), F.lit(END))
    main, asked, about = (F.concat(ident, F.lit(s)) for s in ("/main", "/request", "/metadata"))
    common = [("WARC-Target-URI", F.col("__url")), ("WARC-Date", F.lit(DATE))]
    host = F.regexp_extract("__url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    records = F.array(
        _record(F.when(again, "revisit").otherwise("response"), main, [
            *common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("__digest"))),
            ("WARC-Profile", F.when(again, REVISIT_PROFILE)), ("WARC-Refers-To", F.when(again, _angled(F.concat(origin, F.lit("/main"))))),
            ("Content-Type", F.lit("application/http;msgtype=response"))], F.concat(http, F.when(again, "").otherwise(F.col("__body")))),
        _record(F.lit("request"), asked, [*common, ("WARC-Concurrent-To", _angled(main)), ("Content-Type", F.lit("application/http;msgtype=request"))],
                F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), host, F.lit(END))),
        _record(F.lit("metadata"), about, [*common, ("WARC-Concurrent-To", _angled(asked)), ("Content-Type", F.lit("application/warc-fields"))],
                F.concat(F.lit("via: "), F.col("__url"), F.lit("\r\npageId: "), F.coalesce(F.col("__key").cast("string"), F.lit("")))))
    (rows.select(F.array_join(records, END).alias("value"))
     .write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path))


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse(data: bytes) -> Iterator[dict]:
    """Records of an archive file, by their lengths."""
    import hashlib

    at, size = 0, len(data)
    while at < size:
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        named = {k.strip().lower(): v.strip().decode() for k, v in _HEADER.findall(data, data.index(b"\r\n", at) + 2, head + 2)}
        begin = head + 4
        end = begin + int(named[b"content-length"])
        if end > size:
            raise ValueError(f"the record at byte {at} is cut off")
        kind, out = named.get(b"warc-type", ""), {}
        block = data[begin:end]
        if kind in ("response", "revisit"):
            head_end = block.find(b"\r\n\r\n")
            http = {k.strip().lower(): v for k, v in _HEADER.findall(block, block.find(b"\r\n") + 2, head_end + 2)}
            payload = block[head_end + 4:]
            out = {"http_length": int(http[b"content-length"]) if b"content-length" in http else None, "payload": payload,
                   "payload_length": len(payload), "payload_sha1": hashlib.sha1(payload).hexdigest()}
        elif kind == "metadata":
            out = {"fields": block.decode("utf-8", "replace")}
        yield {"type": kind, "id": named.get(b"warc-record-id"), "concurrent_to": named.get(b"warc-concurrent-to"), "target": named.get(b"warc-target-uri"),
               "date": named.get(b"warc-date"), "payload_digest": named.get(b"warc-payload-digest"), "refers_to": named.get(b"warc-refers-to"),
               "content_type": named.get(b"content-type"), **out}
        at = end + 4


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records under ``path``; without ``payloads`` their lengths and digests only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        names = ["type", "id", "concurrent_to", "target", "date", "payload_digest", "refers_to", "content_type", "http_length", "payload_length", "payload_sha1", "payload", "fields"]
        kinds = [pa.int64() if n.endswith("_length") else pa.binary() if n == "payload" else pa.string() for n in names]
        for batch in batches:
            for value in batch.column(0):
                data = value.as_py()
                rows, held = [], 0
                for record in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    if not payloads:
                        record["payload"] = None
                    held += len(record.get("payload") or b"")
                    rows.append(record)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names=names)
                        rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names=names)

    # Small batches, as a row is a file.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``capture``, ``response`` (or revisit), ``request``, ``metadata``, ``n_requests``, ``n_metadata``.

    A request or metadata record belongs to the capture that its concurrent-to record
    belongs to, or to the response that names it.  Records that lead to no response
    form a capture of their own, with a null response; records that name each other in a
    ring are one, under the least id of the ring.
    """
    main = F.col("type").isin("response", "revisit")
    narrow = records.select("id", "type", "concurrent_to")
    named = narrow.where(main & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("id")).agg(F.min("id").alias("named_by"))
    # Where each record points: a response at itself, others at what they name or at what names them.
    links = narrow.join(named, "id", "left").select("id", F.when(main, F.col("id")).otherwise(F.coalesce("named_by", "concurrent_to", "id")).alias("at"))
    links = cut_lineage(links.withColumn("low", F.least("id", "at")).withColumn("root", F.col("id") == F.col("at")), "links")
    # Follow pointers twice as far each time: what still moves when all records have been passed is on a ring or leads to one.
    for _ in range(max(1, links.count()).bit_length() + 1):
        beyond = links.groupBy(F.col("id").alias("at")).agg(F.min("at").alias("next"), F.min("low").alias("lower"))
        moved = links.join(beyond, "at", "left").select(
            "id", F.coalesce("next", "at").alias("at"), F.least("low", "lower").alias("low"), "root", F.coalesce(F.col("next") != F.col("at"), F.lit(False)).alias("moved"))
        before, moved = links, cut_lineage(moved, "links")
        forget(before)
        links = moved
        if moved.where("moved").isEmpty():
            break
    # What ends at a record that does not point at itself has come round a ring.
    ends = links.groupBy(F.col("id").alias("at")).agg(F.bool_or("root").alias("ends"))
    links = links.join(ends, "at", "left").select("id", F.when(~F.col("ends"), F.col("low")).otherwise(F.col("at")).alias("at"))
    names = [c for c in records.columns]
    placed = records.join(links.groupBy("id").agg(F.min("at").alias("capture")), "id", "left")
    record = F.struct(*names)
    pick = lambda kind: F.min_by(F.when(kind, record), F.when(kind, F.col("id")))
    return placed.groupBy(F.coalesce("capture", "id").alias("capture")).agg(
        pick(main).alias("response"), pick(F.col("type") == "request").alias("request"), pick(F.col("type") == "metadata").alias("metadata"),
        F.count(F.when(F.col("type") == "request", 1)).alias("n_requests"), F.count(F.when(F.col("type") == "metadata", 1)).alias("n_metadata"))
