"""WARC archives in Zstandard: one dictionary for each archive, one frame for each record.

An archive starts with a skippable frame that holds its dictionary; every record is a frame of its own, so
a reader can stop and start at any record. Records of equal payloads are stored once: the one with the largest
id is the response, the others are revisit records that refer to it. The reader loads the dictionary from the
leading skippable frame, decodes frame by frame and validates headers and lengths.

Archives are rows of a table (archive, bytes), written and read by Spark itself, so that any store
Spark can reach will do. ``read_files`` reads archives that already are files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import checked_broadcast, prepare, written
from tamarack.session import table

MAGIC = 0x184D2A5D
#: An archive is closed at this many payload bytes or records; its dictionary is trained on its first records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 4 << 20, 512
DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES = 16 << 10, 64, 16 << 10
LEVEL = 3
#: Fixed value: the profile of revisit records whose payload digest is that of the record they refer to.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive or a record that does not hold what its headers say."""


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1, without padding."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, sha1_base32: str, original: int | None) -> bytes:
    """One WARC/1.1 record; ``original`` names the record that a revisit refers to."""
    revisit = original is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    safe = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {safe or 'about:blank'}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1_base32}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{original}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """Leading skippable frame with the dictionary, then one frame for each record."""
    samples = [r[:SAMPLE_BYTES] for r in records[:SAMPLE_RECORDS]]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL)
    except zstandard.ZstdError:  # too few or too short samples to train on: use them as they are
        trained = zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content = trained.as_bytes()
    packed = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True, write_checksum=True)
    return struct.pack("<II", MAGIC, len(content)) + content + b"".join([packed.compress(r) for r in records])


def frames(data: bytes) -> Iterator[bytes]:
    """Decoded records of an archive, one for each frame."""
    if len(data) < 8:
        raise WarcError("archive is cut off")
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC or len(data) < 8 + size:
        raise WarcError("no dictionary frame at the start")
    content = data[8 : 8 + size]
    if content[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary itself may be compressed
        content = zstandard.ZstdDecompressor().decompress(content)
    kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind))
    at = 8 + size
    while at < len(data):
        end = _frame_end(data, at)
        try:
            out = reader.decompressobj().decompress(memoryview(data)[at:end])
        except zstandard.ZstdError as error:
            raise WarcError(f"frame is damaged: {error}") from error
        yield out
        at = end


def _frame_end(data: bytes, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its header and the sizes of its blocks; nothing is decoded."""
    try:
        checked = zstandard.get_frame_parameters(memoryview(data)[at : at + 18]).has_checksum
        at += zstandard.frame_header_size(memoryview(data)[at : at + 18])
    except zstandard.ZstdError as error:
        raise WarcError(f"no frame header: {error}") from error
    last = False
    while not last:
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind = bool(head & 1), head >> 1 & 3
        if at + 3 > len(data) or kind == 3:
            raise WarcError("frame is cut off or damaged")
        at += 3 + (1 if kind == 1 else head >> 3)  # a repeated byte is one byte long
    at += 4 * checked
    if at > len(data):
        raise WarcError("frame is cut off")
    return at


def parse(raw: bytes) -> dict:
    """Validated headers and payload of one record."""
    head, gap, block = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"header line without a colon: {line[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"no {name}")
    length = int(fields["content-length"])
    if len(block) != length + 4 or block[length:] != b"\r\n\r\n":
        raise WarcError("block length does not match its header")
    http, gap, payload = block[:length].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise WarcError("no HTTP header")
    sizes = [int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    if len(sizes) != 1:
        raise WarcError("no HTTP length")
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response":
        if len(payload) != sizes[0] or digest(payload) != stated:
            raise WarcError("payload does not match its length or digest")
    elif kind == "revisit":
        if payload or fields.get("warc-profile") != PROFILE or "warc-refers-to" not in fields:
            raise WarcError("revisit without its profile or target, or with a payload")
    else:
        raise WarcError(f"record type {kind}")
    return {"fields": fields, "type": kind, "payload": payload, "payload_bytes": sizes[0], "payload_digest": stated}


def _page(urn: str | None) -> int | None:
    if urn is None:
        return None
    inner = urn.strip("<>").removeprefix("urn:page:")
    return int(inner) if inner else None


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    size = 0

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([len(held)], type=pa.int64()), pa.array([archive(held)], type=pa.binary())], names=["records", "archive"])

    for batch in batches:
        ids, urls, pages, sums, originals = (batch.column(i) for i in range(5))
        for i in range(batch.num_rows):  # one row at a time: only the open archive is held as Python objects
            made = record(ids[i].as_py(), urls[i].as_py(), pages[i].as_py(), base64.b32encode(bytes.fromhex(sums[i].as_py())).decode(), originals[i].as_py())
            held.append(made)
            size += len(made)
            if size >= ARCHIVE_BYTES or len(held) >= ARCHIVE_RECORDS:
                yield close()
                held, size = [], 0
    if held:
        yield close()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            found = [parse(raw) for raw in frames(batch.column(0)[i].as_py())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_page(r["fields"]["warc-record-id"]) for r in found], type=pa.int64()),
                    pa.array([r["fields"].get("warc-target-uri") for r in found], type=pa.string()),
                    pa.array([r["payload_bytes"] for r in found], type=pa.int64()),
                    pa.array([r["payload_digest"] for r in found], type=pa.string()),
                    pa.array([r["type"] for r in found], type=pa.string()),
                    pa.array([_page(r["fields"].get("warc-refers-to")) for r in found], type=pa.int64()),
                    pa.array([r["payload"] if r["type"] == "response" else None for r in found], type=pa.binary()),
                ],
                names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
            )


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(records, archive) table in the shared folder, one record for each row of ``pages`` (page_id, url, html).

    Rows of equal payloads of at least ``min_bytes`` bytes: those with the largest page_id (the same row repeated
    counts as itself) are responses, others revisit it. Null html is an empty payload; a null page_id
    counts as the smallest, a null url becomes ``about:blank``. Only digests, lengths and ids are grouped; the
    payloads do not move unless so many of them are repeated that their digests can't be broadcast. Empty in, empty out;
    other columns of ``pages`` are not read.
    """
    prepare(pages.sparkSession)
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("sum", F.sha1("payload"))
    keyed = pages.select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).select("page_id", F.octet_length("payload").alias("size"), F.sha1("payload").alias("twin"))
    twins = keyed.where(F.col("size") >= min_bytes).groupBy("twin", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("twin", "size", "last")
    marked = rows.join(checked_broadcast(written(twins, "twins")), (F.col("sum") == F.col("twin")) & (F.octet_length("payload") == F.col("size")), "left")
    original = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return written(marked.select("page_id", "url", "payload", "sum", original.alias("original")).mapInArrow(_pack, "records long, archive binary"), "warc")


def read_archives(archives: DataFrame, column: str = "archive") -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload of every record; fails on damage."""
    prepare(archives.sparkSession)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return archives.select(F.col(column).alias("archive")).where("archive is not null").mapInArrow(_unpack, schema)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``.warc.zst`` files under ``path`` (any store Spark reads)."""
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(path), "content")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: what the archives of all pages hold, read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return read_archives(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows in DuckDB; base32 is spelled out five bits at a time over the hexadecimal digest.
SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sum FROM pages),
t AS (SELECT sum, max(page_id) AS last FROM p GROUP BY sum)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(((CAST(concat('0x', substr(p.sum || '00', CAST((5 * i) // 4 AS INTEGER) + 1, 3)) AS INTEGER) >> CAST(7 - (5 * i) % 4 AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN p.page_id = t.last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> t.last THEN t.last END AS refers_to
FROM p JOIN t ON p.sum = t.sum
"""
