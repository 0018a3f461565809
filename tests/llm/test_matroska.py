import hashlib
import struct
import zlib

import pytest

from sparkobs.llm import matroska as M


@pytest.mark.parametrize("lacing", M.LACING)
@pytest.mark.parametrize("units", [1, 2, 7, 8, 9, 128, 129, 400])
def test_round_trip(lacing, units):
    payload = bytes(i * 7 % 256 for i in range(units * M.UNIT))
    data = M.write(payload, lacing)
    media = M.parse(data)
    assert b"".join(data[p[2] : p[2] + p[3]] for p in media.packets) == payload
    assert [p[1] for p in media.packets] == [72_000_000 * i for i in range(units)] and media.duration_ms == 72 * units
    assert [data[at : at + 4] for _, _, at in media.cues] == [M.CLUSTER.to_bytes(4, "big")] * len(media.clusters)
    assert media.codecs == {1: "A_PCM/INT/LIT"} and {p[0] for p in media.packets} == {1}


@pytest.mark.parametrize("kind", M.LACING[1:])
def test_uneven_laces_and_unknown_sizes(kind):
    frames = [b"a" * 300, b"b", b"", b"c" * 70000, b"d" * 255] if kind != "fixed" else [b"ab", b"cd"]
    unknown = lambda id_: id_.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    group = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, M.block(200, -3, frames, kind)) + M.number(M.BLOCK_DURATION, 9) + M.element(M.REFERENCE_BLOCK, b"\xff"))
    cluster = unknown(M.CLUSTER) + M.number(M.TIMECODE, 1000) + group
    data = M.element(M.EBML, b"") + unknown(M.SEGMENT) + cluster + cluster
    media = M.parse(data)
    assert [data[p[2] : p[2] + p[3]] for p in media.packets] == frames * 2
    assert {(p[0], p[1], p[4], p[5]) for p in media.packets} == {(200, 997_000_000, False, kind)} and len(media.clusters) == 2


def test_dataframes(spark):
    texts = [None, "", "é" * 288, "x" * 577, "long " * 40000, "same", "same"]
    df = spark.createDataFrame([(i if i else None, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = M.digest(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = (texts[r.doc_id or 0] or "").encode()
        p = t + b"\xff" * (-len(t) % 576 or (576 if not t else 0))
        data = M.write(p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest()) and f"packets={len(p) // 576};" in r.feature
    muxed = M.mux(df)
    table = M.packets(muxed).collect()
    assert len(table) == sum(r.payload_bytes for r in rows) // 576 and {r.status for r in table} == {"ok"}
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"nonsense")), (3, bytearray(M.write(b"x" * 576)[:-9]))], "doc_id long, media binary")
    assert all(r.status != "ok" and r.packet is None for r in M.packets(bad).collect()) and M.packets(bad).count() == 3
    assert M.digest(df.limit(0)).count() == 0 and M.packets(muxed.limit(0)).count() == 0
    assert struct.calcsize(">hB") == 3


def test_a_file_written_by_hand():
    """Bytes from the format's description: an 8-byte size, a void element, and Xiph and EBML lacing with explicit sizes."""
    info = "1549A966 87 2AD7B1 83 0F4240"
    tracks = "1654AE6B 96 AE 94 D7 81 01 83 81 02 86 85 415F414143 23E383 83 0F4240"
    void = "EC 82 0000"
    xiph = "A3 410D 81 000A 82 02 03 FF01" + "61" * 3 + "62" * 256 + "63" * 2
    ebml = "A3 93 81 FFF6 06 02 85 BD" + "64" * 5 + "65" * 3 + "66" * 4
    cluster = "1F43B675 4129 E7 82 01F4" + xiph + ebml
    data = bytes.fromhex("1A45DFA3 84 4286 81 01" + "18538067 010000000000015A" + info + tracks + void + cluster)
    media = M.parse(data)
    assert [(p[0], p[1], data[p[2] : p[2] + p[3]], p[4], p[5]) for p in media.packets] == [
        (1, 510_000_000, b"a" * 3, True, "xiph"), (1, 511_000_000, b"b" * 256, True, "xiph"), (1, 512_000_000, b"c" * 2, True, "xiph"),
        (1, 490_000_000, b"d" * 5, False, "ebml"), (1, 491_000_000, b"e" * 3, False, "ebml"), (1, 492_000_000, b"f" * 4, False, "ebml"),
    ]
    assert media.codecs == {1: "A_AAC"} and len(media.clusters) == 1 and not media.cues


def test_feature_values():
    text = "a" * 575 + "\x7f" + "b" * 100
    payload, _ = M.padded(text)
    data = M.write(payload)
    samples = [x - 128 for x in payload]
    mean, rms = sum(samples) / len(samples), (sum(x * x for x in samples) / len(samples)) ** 0.5
    crossings = sum((a >= 0) != (b >= 0) for a, b in zip(samples, samples[1:]))
    assert M.feature(data, M.parse(data), payload) == f"packets=2;laced=2;clusters=1;cues=1;ms=144;mean={mean:.4f};rms={rms:.4f};crossings={crossings}"
