"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame per record.

``write`` turns pages into archives (rows of archive and content, like Spark's ``binaryFile`` rows); ``read`` turns
archives into one row per record. Records with equal payloads from a given size on are written once as a response;
the others are revisits that refer to it and hold headers alone.

Defined results: a null payload is the empty one; of equal payloads the largest id is the response (of rows that
repeat that id, each is a response); with only null ids all are responses; a null url is written as an urn of the id;
control characters and blanks of a url are percent-encoded; payloads of any length are whole records; an empty table gives no archives; a damaged archive
raises an error that names it. Columns beyond id, url and payload are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkobs.llm.common import slices, stored

DICTIONARY_FRAME, FRAME = 0x184D2A5D, 0xFD2FB528
#: Bounds of one archive, of the texts a dictionary is trained on, and of the dictionary itself.
ARCHIVE_BYTES, TRAIN_BYTES, DICTIONARY_BYTES, LEVEL = 8_000_000, 400_000, 16_384, 3
SALTS = 32
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def headers(lines: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"


def record(id_: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """A response, or a revisit that refers to another record."""
    http = b"HTTP/1.1 200 OK\r\n" + headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http + (payload if refers_to is None else b"")
    url = f"urn:page:{'null' if id_ is None else id_}" if url is None else UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'null' if id_ is None else id_}>"), ("WARC-Target-URI", url), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if refers_to is not None:
        lines += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + headers(lines) + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """Records as frames behind a dictionary that is trained on the first of them."""
    samples, held = [], 0
    for r in records:
        for i in range(0, min(len(r), 32_768), 4096):
            samples.append(r[i : i + 4096])
        held += len(r)
        if held > TRAIN_BYTES:
            break
    try:
        own = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
    except zstandard.ZstdError:  # too few or too small
        own = None
    lead = own.as_bytes() if own else b""
    made = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=True, write_content_size=True)
    return struct.pack("<II", DICTIONARY_FRAME, len(lead)) + lead + b"".join(map(made.compress, records))


def frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive: one frame each, decoded with the dictionary of the leading skippable frame."""
    own, at, view = None, 0, memoryview(content)
    while at < len(content):
        if at + 8 > len(content):
            raise ValueError(f"cut off at byte {at}")
        magic, size = struct.unpack_from("<II", content, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(content):
                raise ValueError(f"skippable frame at byte {at} is cut off")
            if magic == DICTIONARY_FRAME and not at and size:
                lead = content[8 : 8 + size]
                if lead[:4] == struct.pack("<I", FRAME):  # the dictionary may be a frame itself
                    lead = zstandard.ZstdDecompressor().decompressobj().decompress(lead)
                own = zstandard.ZstdCompressionDict(lead)
            at += 8 + size
        elif magic == FRAME:
            decoder = zstandard.ZstdDecompressor(dict_data=own).decompressobj() if own else zstandard.ZstdDecompressor().decompressobj()
            # the decoder stops at the frame's end; it is fed as much as the frame needs
            out, fed, step = [], at, 8192
            while not decoder.eof:
                if fed >= len(content):
                    raise ValueError(f"frame at byte {at} is cut off")
                out.append(decoder.decompress(bytes(view[fed : fed + step])))
                fed += step
            at = min(fed, len(content)) - len(decoder.unused_data)
            yield b"".join(out)
        else:
            raise ValueError(f"no frame at byte {at}")


def parse(raw: bytes) -> dict:
    """A record's headers and payload; ValueError where a header, a length or a digest is wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC record")
    named = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise ValueError(f"header without a colon: {line[:80]!r}")
        named[k.decode().lower()] = v.strip().decode("utf-8", "replace")
    for k in ("warc-type", "warc-record-id", "content-length"):
        if k not in named:
            raise ValueError(f"no {k}")
    n = int(named["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"{named['warc-record-id']}: Content-Length {n}, block {len(rest) - 4}")
    block = rest[:n]
    if (d := named.get("warc-block-digest", "")).startswith("sha1:") and d[5:] != digest(block):
        raise ValueError(f"{named['warc-record-id']}: block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    size = int(said[1]) if said else len(payload)
    sha = named.get("warc-payload-digest", "").removeprefix("sha1:")
    if named["warc-type"] == "response" and (size != len(payload) or sha and sha != digest(payload)):
        raise ValueError(f"{named['warc-record-id']}: payload")
    return named | {"payload": payload, "payload_bytes": size, "payload_digest": sha}


def number(urn: str | None) -> int | None:
    own = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(own[1]) if own else None


def digests(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """id, digest and bytes of each payload; no payload leaves its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "p"):
            own = [(t or "").encode() for t in b.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([digest(p) for p in own]), pa.array([len(p) for p in own], pa.int64())], names=["id", "sha", "n"])

    return pages.select(F.col(key).cast("long").alias("id"), F.col(payload).alias("p")).mapInArrow(run, "id long, sha string, n long")


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Archives (archive, content) with a record for each row; equal payloads of ``least`` bytes or more are stored once."""
    own = digests(pages, key, payload)
    # Rows of payloads that occur once need no partner: only ids of repeated payloads travel, in salted groups.
    leaders = own.where(F.col("n") >= least).groupBy("sha").agg(F.max("id").alias("leader"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and leader is not null")
    leaders = stored(leaders.select("sha", "leader").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "leaders")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "p"):
            raw = [(t or "").encode() for t in b.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(raw, pa.binary()), pa.array([digest(p) for p in raw])], names=["id", "url", "p", "sha"])

    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(payload).alias("p")).mapInArrow(hashed, "id long, url string, p binary, sha string")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(leaders, ["sha", "salt"], "left")
    rows = rows.select("id", "url", "p", "sha", F.when(F.col("id") != F.col("leader"), F.col("leader")).otherwise(F.when(F.col("id").isNull(), F.col("leader"))).alias("refers"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            content = archive(held)
            return pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha1(content).hexdigest()}.warc.zst"]), pa.array([content], pa.binary())], names=["archive", "content"])

        for b in slices(batches, "p"):
            for id_, u, p, sha, refers in zip(*(b.column(c).to_pylist() for c in ("id", "url", "p", "sha", "refers")), strict=True):
                held.append(record(id_, u, p, sha, refers))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return rows.mapInArrow(packed, "archive string, content binary")


RECORDS = "archive string, position long, record_type string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read(archives: DataFrame, name: str = "archive", content: str = "content", payloads: bool = True) -> DataFrame:
    """One row per record of each archive; ``payloads`` false leaves the payload column null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "content", 1):
            for title, data in zip(b.column("archive").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = []
                try:
                    for i, raw in enumerate(frames(data or b"")):
                        r = parse(raw)
                        rows.append((title, i, r["warc-type"], number(r["warc-record-id"]), r.get("warc-target-uri"), r["payload"] if payloads else None, r["payload_bytes"], r["payload_digest"], number(r.get("warc-refers-to"))))
                except (ValueError, zstandard.ZstdError) as error:
                    raise ValueError(f"{title}: {error}") from error
                if rows:
                    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])

    return archives.select(F.col(name).alias("archive"), F.col(content).alias("content")).mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to archives in the shared folder, reads them back and returns what each record says."""
    return read(stored(write(pages), "warc"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


__all__ = ["archive", "frames", "parse", "read", "record", "round_trip", "write"]
