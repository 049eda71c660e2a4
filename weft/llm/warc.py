"""WARC: archives with one gzip member for each record, and a sequential reader that checks what it reads.

Writing: payload digests are compared in Spark. Of records with equal payloads of MIN_REVISIT bytes or more the one
with the largest page id is the response and the others revisit it; only digests, lengths and ids are grouped, and
the payloads move once, by page id. Each task packs its records into archives of about ARCHIVE_BYTES, rows of a
Parquet table that any store Spark knows can hold. Reading: each archive is inflated member by member with an
incremental zlib decompressor, a record's block is framed by Content-Length, and block and payload digests are
verified. Files of other origin come in through spark.read.format("binaryFile").

Null html is an empty payload. Null ids and repeated rows keep their records: among equal payloads and equal largest ids all are
responses; a null id revisits the largest id, and if all are null all are responses. An empty table gives no archives.
A damaged archive raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_REVISIT = 1000
ARCHIVE_BYTES = 16 << 20
PIECE = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the table has no time of capture


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, revisits) -> bytes:
    """A gzip member that holds one response or, if revisits is an id, one revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if revisits is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if revisits is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {'%20'.join(url.split())}"] if url and url.split() else []), f"WARC-Payload-Digest: {sha1_label(payload)}", f"WARC-Block-Digest: {sha1_label(block)}",
        *([f"WARC-Refers-To: <urn:page:{revisits}>", f"WARC-Profile: {PROFILE}"] if revisits is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(archive: bytes, piece: int = PIECE) -> Iterator[bytes]:
    """The inflated bytes of each gzip member, fed in pieces."""
    at, view = 0, memoryview(archive)
    while at < len(archive):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            fed = view[at : at + piece]
            if not fed:
                raise ValueError("archive ends within a member")
            try:
                out.append(inflate.decompress(fed))
            except zlib.error as e:
                raise ValueError(f"damaged member: {e}") from e
            at += len(fed) - len(inflate.unused_data)
        yield b"".join(out)


def read(archive: bytes, piece: int = PIECE) -> Iterator[dict]:
    """Header fields (lower-case names) of each record, with http fields, block and payload, after all checks."""
    for raw in members(archive, piece):
        head, cut, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not cut or not lines[0].startswith("WARC/"):
            raise ValueError("no WARC header")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = rest[:size]
        if len(block) != size or rest[size:] != b"\r\n\r\n":
            raise ValueError("block and Content-Length differ")
        if sha1_label(block) != fields["warc-block-digest"]:
            raise ValueError("block digest differs")
        http, _, payload = block.partition(b"\r\n\r\n")
        if fields["warc-type"] == "response" and sha1_label(payload) != fields["warc-payload-digest"]:
            raise ValueError("payload digest differs")
        served = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
        if fields["warc-type"] == "response" and int(served["content-length"]) != len(payload):
            raise ValueError("payload and its Content-Length differ")
        yield fields | {"payload_bytes": int(served["content-length"]), "payload": payload if fields["warc-type"] == "response" else None}


def revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, digest, holder) of the pages that revisit another."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    heads = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes")).where(F.col("bytes") >= least)
    holders = heads.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1 and holder is not null").select("digest", "holder")
    return heads.join(holders, "digest").where("not page_id <=> holder").select("page_id", "digest", "holder").distinct()


def archives(pages: DataFrame, least: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, warc): archives that hold one record for each row of pages (page_id, url, html)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    other = revisits(pages, least).withColumnRenamed("page_id", "of").withColumnRenamed("digest", "same")
    rows = own.join(other, own.page_id.eqNullSafe(other.of) & (own.digest == other.same), "left").select("page_id", "url", "payload", "holder")

    def run(batches):
        part, count, out, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for page_id, url, data, holder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append(record(page_id, url, data, holder))
                size += len(out[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"archive": [f"{part:06}-{count:04}"], "warc": [b"".join(out)]})
                    out, size, count = [], 0, count + 1
        if out:
            yield pa.RecordBatch.from_pydict({"archive": [f"{part:06}-{count:04}"], "warc": [b"".join(out)]})

    return rows.mapInArrow(run, "archive string, warc binary")


def records(stored: DataFrame, content: str = "warc") -> DataFrame:
    """record_id, record_type, url, payload_bytes, payload_digest (hex), refers_to and payload of every record in the archives."""

    def run(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows = []
                for f in read(archive):
                    refers = f.get("warc-refers-to")
                    rows.append((bare(f["warc-record-id"]), f["warc-type"], f.get("warc-target-uri"), f["payload_bytes"], base64.b32decode(f["warc-payload-digest"].partition(":")[2]).hex(), bare(refers) if refers else None, f["payload"]))
                names = ["record_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to", "payload"]
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)], names=names)

    return stored.select(content).mapInArrow(run, "record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def bare(urn: str) -> str:
    return urn.strip("<>").removeprefix("urn:page:")
