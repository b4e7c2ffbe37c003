"""Web archive records: parsing, reassembly of segmented records, chunked transfer framing.

A record too long for one file is split: the first segment is a record of its own kind with segment number 1,
the others are continuation records that name its id as their origin; the last one gives the total length.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import tune

_digits, _hexadecimal = re.compile(r"[0-9]+").fullmatch, re.compile(rb"[0-9A-Fa-f]+").fullmatch
RECORDS = "record_id string, kind string, target_uri string, segment_number int, origin_id string, total_length long, block binary"
_KINDS = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
_NAMES = ["record_id", "kind", "target_uri", "segment_number", "origin_id", "total_length", "block"]


def _inflated(data: bytes) -> tuple[bytes, int]:
    """All gzip members, and how many were damaged; anything else as it is.

    Of a damaged member what was inflated before the damage counts; the next one is looked for behind it.
    """
    if data[:2] != b"\x1f\x8b":
        return data, 0
    out, damaged, at = [], 0, 0
    while at >= 0 and data[at : at + 2] == b"\x1f\x8b":
        member, end = zlib.decompressobj(31), at
        try:
            # In pieces, so that what precedes the damage is kept.
            while end < len(data) and not member.eof:
                piece = data[end : end + (1 << 16)]
                end += len(piece)
                out.append(member.decompress(piece))
            out.append(member.flush())
            if not member.eof:
                raise zlib.error
            at = end - len(member.unused_data)
            if data[at : at + 2] != b"\x1f\x8b":
                break
        except zlib.error:
            damaged += 1
            at = data.find(b"\x1f\x8b\x08", at + 3)
    return b"".join(out), damaged


def _number(value: str | None) -> int | None:
    return int(value) if value and _digits(value.strip()) else None


def split_records(data: bytes) -> list[tuple]:
    """Rows of RECORDS from the bytes of one archive file.

    A record whose header lacks a length, whose block is cut short or runs into another record, and a gzip member
    that doesn't inflate, is a row of kind "damaged" with a null block; reading goes on at the next record.
    """
    (data, broken), at = _inflated(data), 0
    rows: list[tuple] = [(None, "damaged", None, None, None, None, None)] * broken
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        head = {}
        for line in data[at : len(data) if end < 0 else end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon:
                head.setdefault(name.strip().lower(), value.strip())
        size, begin = _number(head.get("content-length")), end + 4
        whole = end >= 0 and size is not None and begin + size <= len(data) and not data[begin + size : begin + size + 2].strip(b"\r\n")
        if whole:
            rows.append((head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), _number(head.get("warc-segment-number")), head.get("warc-segment-origin-id"), _number(head.get("warc-segment-total-length")), data[begin : begin + size]))
            at = begin + size
        else:
            rows.append((head.get("warc-record-id"), "damaged", head.get("warc-target-uri"), None, None, None, None))
            at += 5
            if (n := data.find(b"\nWARC/", at)) < 0:
                break
            at = n + 1
    return rows


def written_records(rows: list[tuple]) -> bytes:
    """The bytes of an archive file, a gzip member for each row of RECORDS; a null block is an empty one."""
    out = []
    for record, kind, uri, number, origin, total, block in rows:
        names = ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Segment-Number", "WARC-Segment-Origin-ID", "WARC-Segment-Total-Length", "Content-Length")
        head = "".join(f"{n}: {v}\r\n" for n, v in zip(names, (kind, record, uri, number, origin, total, len(block or b""))) if v is not None)
        member = zlib.compressobj(1, zlib.DEFLATED, 31)
        out += [member.compress(f"WARC/1.0\r\n{head}\r\n".encode() + (block or b"") + b"\r\n\r\n"), member.flush()]
    return b"".join(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=_NAMES)


def records_of(archives: DataFrame) -> DataFrame:
    """Records of archive files in a column content; a null or empty file has none, damage is as in split_records."""
    tune(archives.sparkSession)

    def stage(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield _batch(split_records(data or b""))

    return archives.select(F.col("content").cast("binary")).mapInArrow(stage, RECORDS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the (gzipped) archive files under path, as records_of has them."""
    return records_of(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def archives_of(records: DataFrame) -> DataFrame:
    """content: archive files of the records, one for each batch of a partition."""
    tune(records.sparkSession)

    def stage(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([written_records(list(zip(*(c.to_pylist() for c in batch.columns))))], pa.binary())], names=["content"])

    return records.select(*_NAMES).mapInArrow(stage, "content binary")


def dechunked(body: bytes) -> bytes | None:
    """The payload of a body in chunked framing; null where the framing is broken or doesn't end."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        digits = body[at:end].split(b";")[0].strip()
        if not _hexadecimal(digits):
            return None
        size = int(digits, 16)
        if size == 0:
            return b"".join(out)
        at = end + 2
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes | None:
    """The payload of an HTTP response, without its transfer framing; a block that is none is its own payload."""
    if not block.startswith(b"HTTP/"):
        return block
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"transfer-encoding" and b"chunked" in value.lower():
            return dechunked(body)
    return body


def joined(parts: list[tuple[int | None, int | None, bytes]]) -> bytes | None:
    """The block that sorted segments (number, total length, bytes) make up; null where they don't.

    Numbers must run from 1 on; equal segments count once, different ones of a number make none; the length
    must be the total that the last one gives.  A record without a number is whole by itself.  A single first
    segment without a total length waits for others, and isn't whole.
    """
    parts = [p for i, p in enumerate(parts) if not i or p != parts[i - 1]]
    if len(parts) == 1 and parts[0][0] is None:
        return parts[0][2]
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        return None
    block = b"".join(p[2] for p in parts)
    return block if parts[-1][1] == len(block) else None


def reassembled(records: DataFrame) -> DataFrame:
    """One row a whole record: record_id, target_uri, n_segments, n_bytes (of the block), complete, payload.

    complete tells that the segments make a block of the total length; payload has the transfer framing taken
    off, and is null where the record isn't complete or its framing is broken.  Records without an id and null
    blocks (damaged ones) are left out, continuations without an origin too; a continuation whose first segment
    lacks, or that has no number, is part of an incomplete record of its origin's id.  Repeated rows count once
    and are dropped before the exchange; of several URIs the least counts.  Other columns are not read.
    """
    tune(records.sparkSession)
    continues = (F.col("kind").eqNullSafe("continuation")) | (F.coalesce(F.col("segment_number"), F.lit(1)) > 1)
    number = F.when(F.col("kind").eqNullSafe("continuation"), F.coalesce("segment_number", F.lit(0))).otherwise(F.col("segment_number"))
    rows = records.select(F.when(continues, F.col("origin_id")).otherwise(F.col("record_id")).alias("whole_id"), "target_uri", number.alias("segment_number"), "total_length", "block").filter("whole_id is not null and block is not null")
    # A set, so repeats of one segment are one before they are sent: a record's own segments bound it.
    part = F.struct("segment_number", "total_length", "block")
    groups = rows.groupBy("whole_id").agg(F.min("target_uri").alias("target_uri"), F.sort_array(F.collect_set(part)).alias("parts"))

    def stage(batches):
        for batch in batches:
            sizes, lengths, complete, payloads = [], [], [], []
            for parts in batch.column(2).to_pylist():
                block = joined([(p["segment_number"], p["total_length"], p["block"]) for p in parts])
                sizes.append(len({p["segment_number"] for p in parts}))
                lengths.append(None if block is None else len(block))
                complete.append(block is not None)
                payloads.append(None if block is None else http_payload(block))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(lengths, pa.int64()), pa.array(complete, pa.bool_()), pa.array(payloads, pa.binary())],
                names=["record_id", "target_uri", "n_segments", "n_bytes", "complete", "payload"],
            )

    return groups.mapInArrow(stage, "record_id string, target_uri string, n_segments int, n_bytes long, complete boolean, payload binary")


HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
CHUNK, SEGMENT = 1000, 2048


def archived(pages: DataFrame, chunk: int = CHUNK, segment: int = SEGMENT) -> DataFrame:
    """Pages (page_id, url, html) as segmented response records in chunked framing; a null html is an empty body."""
    tune(pages.sparkSession)

    def stage(batches):
        for batch in batches:
            rows = []
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = (html or "").encode()
                framed = [HEAD]
                for k in range(0, len(data), chunk):
                    part = data[k : k + chunk]
                    framed += [b"%X\r\n" % len(part), part, b"\r\n"]
                block = b"".join([*framed, b"0\r\n\r\n"])
                first, n = f"<urn:page:{page}:1>", -(-len(block) // segment)
                for k in range(n):
                    part = block[k * segment : (k + 1) * segment]
                    rows.append((f"<urn:page:{page}:{k + 1}>", "continuation" if k else "response", url, k + 1, first if k else None, len(block) if k == n - 1 else None, part))
            yield _batch(rows)

    return pages.filter("page_id is not null").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(stage, RECORDS)


def op4_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page travels as segments in gzipped archive files, which are read and put together again."""
    found = reassembled(records_of(archives_of(archived(spark.read.parquet(f"{sf_dir}/pages.parquet")))))
    page = F.regexp_extract("record_id", r"page:(-?\d+):", 1).cast("long")
    return found.select(page.alias("page_id"), F.col("target_uri").alias("url"), "n_segments", "n_bytes", "complete", F.decode("payload", "UTF-8").alias("html"))


QUERIES = {"op4_warc_reassembly": op4_warc_reassembly}
ORACLE_SQL = {
    "op4_warc_reassembly": f"""
WITH s AS (SELECT page_id, url, html, octet_length(encode(html)) AS n FROM (SELECT page_id, url, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL)),
b AS (SELECT *, {len(HEAD)} + (n // {CHUNK}) * ({CHUNK} + 7) + CASE WHEN n % {CHUNK} = 0 THEN 0 WHEN n % {CHUNK} < 16 THEN 5 + n % {CHUNK} WHEN n % {CHUNK} < 256 THEN 6 + n % {CHUNK} ELSE 7 + n % {CHUNK} END + 5 AS size FROM s)
SELECT page_id, url, CAST((size + {SEGMENT} - 1) // {SEGMENT} AS INTEGER) AS n_segments, CAST(size AS BIGINT) AS n_bytes, TRUE AS complete, html FROM b
"""
}
