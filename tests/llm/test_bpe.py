import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from sparkobs.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", "a", " ", "  two  spaces\n\n tabs\t x ", "it's Grüße, naïve 漢字 😀! 123 4567", "x" * 3000, "ab" * 700 + " " + "é" * 400, "\x1c\x1d a\x85b \xa0 c　 d", "a \n b", "\n\n\n", "!!! ??? $$$", "ab" * 50]


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(7)
    alphabet = "abcde  \n\t'stAé漢😀.,!0123 \x1c"
    return TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(300)] + TEXTS


def test_codec_matches_the_library(oracle):
    own = bpe.codec(open(PATH, "rb").read(), P.PATTERN)
    given = [t or "" for t in texts()]
    for _ in range(2):  # learnt, then remembered
        ids, counts = own.encode(given)
        at = 0
        for t, n, s, d in zip(given, counts, own.decimal(ids, counts), own.decode(ids, counts), strict=True):
            assert ids[at : at + n].tolist() == oracle.encode_ordinary(t) and s.decode() == " ".join(map(str, ids[at : at + n])) and d == t.encode()
            at += n


def test_forgetting_and_other_patterns_change_nothing(oracle, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    given = [t or "" for t in texts()]
    own = bpe.Codec(open(PATH, "rb").read(), P.PATTERN)
    for i in range(0, len(given), 7):
        ids, counts = own.encode(given[i : i + 7])
        assert ids.tolist() == [x for t in given[i : i + 7] for x in oracle.encode_ordinary(t)]
    other = r"\S+ \S+|\s+|\S+"  # a blank need not start a piece
    plain = tiktoken.Encoding("other", pat_str=other, mergeable_ranks=oracle._mergeable_ranks, special_tokens={})
    ids, _ = bpe.Codec(open(PATH, "rb").read(), other).encode(given)
    assert ids.tolist() == [x for t in given for x in plain.encode_ordinary(t)]


def test_very_long_pieces(oracle):
    own = bpe.codec(open(PATH, "rb").read(), P.PATTERN)
    rng = random.Random(3)
    given = ["".join(rng.choice("etaoinshrdlu") for _ in range(60_000)), "=" * 50_001, "漢字" * 9000, "aab" * 9001, "".join(rng.choice("ab") for _ in range(20_000))]
    ids, _ = own.encode(given)
    assert ids.tolist() == [x for t in given for x in oracle.encode_ordinary(t)]


def test_long_pieces_merge_as_short_ones():
    own = bpe.codec(open(PATH, "rb").read(), P.PATTERN)
    for p in (b"thethermometerly" * 12, b"a" * 200, bytes(range(200))):
        want = own.merge([p])[0].tolist()
        assert own._merge_long(np.frombuffer(p, np.uint8)).tolist() == want


def test_dataframes(spark, oracle):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts())] + [(None, "again", "x"), (None, "again", "x")], "doc_id long, text string, n_tokens string")
    rows = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert all(r.ids == oracle.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() for r in rows)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    got = sorted(map(tuple, bpe.round_trip(df, PATH, P.PATTERN).collect()), key=str)
    assert got == sorted(((r.doc_id, len(r.ids), sha(" ".join(map(str, r.ids)).encode()), sha((r.text or "").encode())) for r in rows), key=str)
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).count() == 0
