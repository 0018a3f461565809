"""Media columns in Matroska: variable-length EBML elements, clusters, lacing and cues as packet tables.

``write`` muxes one PCM track of 8-bit samples; ``packets`` parses any Matroska bytes into one row per packet with
track, timestamp and byte range. All of a file stays in its row; no file meets another.

Defined results: a null text is the empty text, whose payload is one block of bytes 255; texts of any length are stored
whole; equal texts give equal files;
bytes that are null, truncated or not Matroska give no packets and a status that says why; an element of unknown
size ends where an element of a higher level begins or at the end; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkobs.llm.common import slices

# Fixed values of the container format: element ids.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMECODE_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMECODE, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACING = ("none", "xiph", "fixed", "ebml")

UNIT = 576  # bytes of a packet: 72 ms of 8-bit samples at 8 kHz
RATE, LACED, CLUSTER_BLOCKS = 8000, 8, 16


def size_bytes(n: int, width: int = 0) -> bytes:
    """A variable-length size, the shortest unless ``width`` is given; all ones is kept for the unknown size."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(id_: int, body: bytes) -> bytes:
    return id_.to_bytes((id_.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(id_: int, n: int) -> bytes:
    return element(id_, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: str) -> bytes:
    """Frames behind a block's header."""
    if kind == "none":
        return frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if kind == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == "ebml":
        head += size_bytes(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += size_bytes(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def block(track: int, relative: int, frames: list[bytes], kind: str, key: bool = True) -> bytes:
    return size_bytes(track) + struct.pack(">hB", relative, 0x80 * key | LACING.index(kind) << 1) + lace(frames, kind)


def write(payload: bytes, lacing: str = "fixed") -> bytes:
    """``payload``, a positive multiple of UNIT bytes, as a Matroska file with one PCM track, laced blocks and cues."""
    unit_ms = UNIT * 1000 // RATE
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ, 2))
    count = len(payload) // UNIT
    body = [element(INFO, number(TIMECODE_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", count * unit_ms)) + element(MUXING_APP, b"media columns") + element(WRITING_APP, b"media columns"))]
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    body.append(element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, unit_ms * 1_000_000) + audio)))
    at, cues = sum(map(len, body)), []
    step = LACED * CLUSTER_BLOCKS if lacing != "none" else CLUSTER_BLOCKS
    for first in range(0, count, step):
        parts = [number(TIMECODE, first * unit_ms)]
        each = LACED if lacing != "none" else 1
        for i in range(first, min(first + step, count), each):
            frames = [payload[k * UNIT : (k + 1) * UNIT] for k in range(i, min(i + each, first + step, count))]
            parts.append(element(SIMPLE_BLOCK, block(1, (i - first) * unit_ms, frames, lacing if len(frames) > 1 else "none")))
        cues.append(element(CUE_POINT, number(CUE_TIME, first * unit_ms) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        body.append(element(CLUSTER, b"".join(parts)))
        at += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


@dataclass
class Media:
    """A parsed file. packets: (track, timestamp in ns, offset, size, key, lacing, cluster)."""

    packets: list[tuple[int, int, int, int, bool, str, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    duration_ms: float = 0.0
    codecs: dict[int, str] = field(default_factory=dict)


def vint(data: bytes, at: int, end: int, keep: bool = False) -> tuple[int, int]:
    """The variable-length number at ``at`` (with its marker if ``keep``) and where it ends; -1 for the unknown size."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"cut off at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    bare = n & (1 << 7 * width) - 1
    return (n if keep else -1 if bare == (1 << 7 * width) - 1 else bare), at + width


def elements(data: bytes, at: int, end: int, ends: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """Id, start and end of each element's body; ``ends``: ids that end a parent of unknown size."""
    while at < end:
        id_, body = vint(data, at, end, keep=True)
        if id_ in ends:
            return
        n, body = vint(data, body, end)
        stop = end if n < 0 else body + n
        if stop > end:
            raise ValueError(f"element {id_:#x} at byte {at} is cut off")
        if n < 0:
            higher = frozenset((CLUSTER, CUES, INFO, TRACKS)) if id_ == CLUSTER else frozenset()
            stop = body
            for _, _, inner in elements(data, body, end, higher):
                stop = inner
        yield id_, body, stop
        at = stop


def unlace(data: bytes, at: int, end: int, kind: str) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if kind == "none":
        return [(at, end - at)]
    if at >= end:
        raise ValueError(f"empty lace at byte {at}")
    count, at, sizes = data[at] + 1, at + 1, []
    if kind == "fixed":
        if (end - at) % count:
            raise ValueError(f"uneven fixed lace at byte {at}")
        sizes = [(end - at) // count] * count
    else:
        for i in range(count - 1):
            if kind == "xiph":
                n = 0
                while at < end and data[at] == 255:
                    n, at = n + 255, at + 1
                if at >= end:
                    raise ValueError(f"cut off lace at byte {at}")
                n, at = n + data[at], at + 1
            else:
                start, (n, at) = at, vint(data, at, end)
                if i:
                    n = sizes[-1] + n - ((1 << 7 * (at - start) - 1) - 1)
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lace sizes exceed the block at byte {at}")
    starts = np.cumsum([at, *sizes[:-1]]).tolist()
    return list(zip(starts, sizes, strict=True))


def parse(data: bytes) -> Media:
    """Packets, clusters and cues of a file; ValueError if it is malformed."""
    out, scale, durations, top = Media(), 1_000_000, {}, list(elements(data, 0, len(data)))
    uint = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")

    def take(a: int, b: int, time: int, simple: bool, reference: bool, cluster: int) -> None:
        track, at = vint(data, a, b)
        if at + 3 > b:
            raise ValueError(f"block cut off at byte {a}")
        relative, flags = struct.unpack(">hB", data[at : at + 3])
        kind = LACING[flags >> 1 & 3]
        for k, (start, n) in enumerate(unlace(data, at + 3, b, kind)):
            out.packets.append((track, (time + relative) * scale + k * durations.get(track, 0), start, n, bool(flags & 0x80) if simple else not reference, kind, cluster))

    for id_, a, b in top:
        if id_ != SEGMENT:
            continue
        for kind, c, d in elements(data, a, b):
            if kind == INFO:
                for k, e, f in elements(data, c, d):
                    if k == TIMECODE_SCALE:
                        scale = uint(e, f)
                    elif k == DURATION:
                        out.duration_ms = real(e, f) * scale / 1e6
            elif kind == TRACKS:
                for k, e, f in elements(data, c, d):
                    if k == TRACK_ENTRY:
                        own = {x: (g, h) for x, g, h in elements(data, e, f)}
                        track = uint(*own[TRACK_NUMBER]) if TRACK_NUMBER in own else 0
                        durations[track] = uint(*own[DEFAULT_DURATION]) if DEFAULT_DURATION in own else 0
                        out.codecs[track] = data[slice(*own[CODEC_ID])].decode("ascii", "replace") if CODEC_ID in own else ""
            elif kind == CLUSTER:
                time, n = 0, len(out.clusters)
                out.clusters.append(c)
                for k, e, f in elements(data, c, d, frozenset((CLUSTER, CUES))):
                    if k == TIMECODE:
                        time = uint(e, f)
                    elif k == SIMPLE_BLOCK:
                        take(e, f, time, True, False, n)
                    elif k == BLOCK_GROUP:
                        own = {x: (g, h) for x, g, h in elements(data, e, f)}
                        if BLOCK in own:
                            take(*own[BLOCK], time, False, REFERENCE_BLOCK in own, n)
            elif kind == CUES:
                for k, e, f in elements(data, c, d):
                    if k == CUE_POINT:
                        own = {x: (g, h) for x, g, h in elements(data, e, f)}
                        for x, g, h in elements(data, e, f):
                            if x == CUE_TRACK_POSITIONS:
                                place = {y: uint(i, j) for y, i, j in elements(data, g, h)}
                                out.cues.append((uint(*own[CUE_TIME]) if CUE_TIME in own else 0, place.get(CUE_TRACK, 0), a + place.get(CUE_CLUSTER_POSITION, 0)))
    return out


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled up with 255 to a positive multiple of UNIT, and their number before."""
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT), len(raw)


def feature(data: bytes, media: Media, payload: bytes) -> str:
    """Counts of the container, and mean, root mean square and zero crossings of the samples about 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    laced = sum(p[5] != "none" for p in media.packets)
    return f"packets={len(media.packets)};laced={laced};clusters={len(media.clusters)};cues={len(media.cues)};ms={media.duration_ms:.0f};mean={x.sum() / max(1, len(x)):.4f};rms={(np.square(x).sum() / max(1, len(x))) ** 0.5:.4f};crossings={int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))}"


def mux(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and media, the file that holds each row's text."""
    schema = df.select(*keep).schema.add("media", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            media = pa.array([write(padded(t)[0]) for t in b.column(text).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), media], names=[*keep, "media"])

    return df.select(*keep, text).mapInArrow(run, schema)


PACKETS = "status string, packet long, track long, time_ns long, start long, size long, key boolean, lacing string, cluster long"


def packets(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per packet of each file: the columns ``keep``, track, timestamp and byte range; a malformed file has one row with its status alone."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, media):
            whose, rows = [], []
            for i, data in enumerate(b.column(media).to_pylist()):
                try:
                    own = [("ok", n, *p) for n, p in enumerate(parse(data or b"").packets)]
                except (ValueError, struct.error) as error:
                    own = [(str(error), *[None] * 8)]
                whose, rows = whose + [i] * len(own), rows + own
            names = [x.split()[0] for x in PACKETS.split(", ")]
            types = [pa.string(), *[pa.int64()] * 5, pa.bool_(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(whose, pa.int64())) for k in keep), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*keep, *names])

    return df.select(*keep, media).mapInArrow(run, f"{kinds}, {PACKETS}")


def digest(docs: DataFrame) -> DataFrame:
    """Stores every text as media, reads the bytes back through the packet table, and returns digests of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = []
            for t in b.column("text").to_pylist():
                stored, n = padded(t)
                data = write(stored)
                media = parse(data)
                back = b"".join([data[p[2] : p[2] + p[3]] for p in media.packets])
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(data, media, back)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
