import base64
import hashlib

import pytest

from sparkobs.llm import warc


def b32(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"<p>page {i % 7}</p>" * (i % 5 + 1), "x") for i in range(120)]
    rows += [(500, None, None, "x"), (501, "http://a b\r\nX: y", "", "x"), (502, "u", "é😀" * 90000, "x"), (502, "u", "é😀" * 90000, "x"), (None, "n", "<p>page 1</p>", "x"), (None, "n", "alone", "x"), (None, "n", "alone", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=str)
    most = {}
    for i, _, h, _ in rows:
        if i is not None:
            most[h or ""] = max(most.get(h or "", i), i)
    want = [(i, len((h or "").encode()), b32(h), "response" if most.get(h or "") in (i, None) else "revisit", None if most.get(h or "") in (i, None) else most[h or ""]) for i, _, h, _ in rows]
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0
    whole = warc.read(warc.write(df, least=10**9)).collect()
    assert sorted(bytes(r.payload) for r in whole) == sorted((h or "").encode() for _, _, h, _ in rows) and {r.record_type for r in whole} == {"response"}


def test_damage_is_found(spark):
    good = warc.archive([warc.record(i, "u", b"body %d" % i * 50, warc.digest(b"body %d" % i * 50), None) for i in range(40)])
    assert len(list(warc.frames(good))) == 40
    raw = next(warc.frames(good))
    assert warc.parse(raw)["payload"] == b"body 0" * 50
    for bad in (raw[:-1], raw.replace(b"body 0", b"body 1", 1), raw.replace(b"WARC/1.1", b"WARC/9"), raw.replace(b"Content-Length: ", b"Content-Length: 1", 1)):
        with pytest.raises(ValueError):
            warc.parse(bad)
    for cut in (good[:-5], good[:6], good + b"junkjunkjunk"):
        with pytest.raises(ValueError):
            list(warc.frames(cut))
    with pytest.raises(Exception, match="a.warc.zst"):
        warc.read(spark.createDataFrame([("a.warc.zst", bytearray(good[:-5]))], "archive string, content binary")).collect()
