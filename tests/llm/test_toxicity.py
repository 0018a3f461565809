import math
import re
import zlib

import numpy as np
import xxhash

from sparkobs.llm import toxicity


def corpus(n=240):
    rng = np.random.default_rng(3)
    words = [f"wort{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        own, bad = list(rng.choice(words, 40)), i % 3 == 0
        if bad:
            own[5], own[20] = "grumblor" + "abcdefgh"[i % 8], "zankify"
        docs.append((i, " ".join(own), "x"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(None, None, "x"), (9001, "", "x"), (9002, "word " * 30000 + "zankify", "x"), (9002, "word " * 30000 + "zankify", "x"), (9003, None, "x")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, score string")
    t = spark.createDataFrame([*labels, (None, 1, 1), (9001, 1, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.classify(d, t).collect()
    assert len(rows) == len(docs) + len(odd)
    truth = {i: y for i, _, y in labels}
    held = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[9001] == by[9003] == by[None] and by[9002] > 0.5


def test_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.classify(d, none).collect()] == [(0.5, 0)]
    assert toxicity.classify(d.limit(0), none).count() == 0


def test_features_are_sets():
    of, f = toxicity.Features()(["Abc abc ABC", "", "x"])
    assert len(set(zip(of, f))) == len(f) and set(of) == {0, 2}


def plain_fit(rows, labels):
    """FTRL-proximal as published, feature by feature over dictionaries."""
    z, n, bias = {}, {}, [0.0, 0.0]
    rate = lambda n: (toxicity.BETA + n**0.5) / toxicity.ALPHA + toxicity.L2

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= toxicity.L1 else ((1 if zi > 0 else -1) * toxicity.L1 - zi) / rate(n[i])

    order = np.random.default_rng(toxicity.SEED)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(rows)):
            w, b = {i: weight(i) for i in rows[k]}, -bias[0] / rate(bias[1])
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w.values()) + b)))) - labels[k]
            for i in rows[k]:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / toxicity.ALPHA * w[i]
                n[i] = old + g * g
            bias = [bias[0] + g - ((bias[1] + g * g) ** 0.5 - bias[1] ** 0.5) / toxicity.ALPHA * b, bias[1] + g * g]
    return {i: x for i in z if (x := weight(i))}, -bias[0] / rate(bias[1])


def plain_features(t):
    """Words, their first letters, and words up to three apart, hashed one by one."""
    of, top, mask = xxhash.xxh64_intdigest, 64 - toxicity.BITS, (1 << 64) - 1
    words = re.findall(r"\w+", t.lower())
    out = {of(w) >> top for w in words} | {of(w[:k], k) >> top for w in words for k in toxicity.STEMS if len(w) >= k and of(w[:k], k)}
    for gap in toxicity.GAPS:
        for a, b in zip(words, words[gap:]):
            mixed = (of(a) * 0x9E3779B97F4A7C15 & mask) ^ (of(b) * 0xC2B2AE3D27D4EB4F & mask)
            out.add((mixed * (2 * gap + 1) * 0x165667B19E3779F9 & mask) >> top)
    return sorted(out)


def test_fit_against_a_plain_version():
    docs, labels = corpus(90)
    texts, own = [t for _, t, _ in docs] + ["", "one"], np.array([y for *_, y in labels] + [0, 1])
    weights, bias = toxicity.fit(texts, own)
    want, want_bias = plain_fit([plain_features(t) for t in texts], own)
    assert set(np.flatnonzero(weights)) == set(want) and 0 < len(want) < 2000
    assert max(abs(weights[i] - x) for i, x in want.items()) < 1e-9 and abs(bias - want_bias) < 1e-9
