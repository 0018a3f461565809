import random

import numpy as np
import pytest

from sparkobs.llm import jaccard as J


def words(t):
    return (t or "").encode().lower().split()


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """n and component of every (id, text), by all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]) or rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] == sets[j]:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), len(s), str(least.get(root(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, groups, size, vocabulary=4000, length=(3, 90), edits=6):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    passage = " ".join(rng.choice(vocab) for _ in range(30))
    rows = []
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randrange(*length))]
        for _ in range(rng.randrange(1, size)):
            own = list(base)
            for _ in range(rng.randrange(edits)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            if rng.random() < 0.3:
                own.insert(rng.randrange(len(own) + 1), passage)
            if rng.random() < 0.2:
                own = own[: rng.randrange(1, len(own) + 1)]
            rows.append(" \n"[rng.random() < 0.2].join(own).upper() if rng.random() < 0.1 else " ".join(own))
    return rows


ODD = [None, "", " \t\n", "one", "One", "one two three four", "one two three four five", "ONE two\nthree four  five", "a b c d é", "a b c d É", "x " * 9000, "x " * 8999]


@pytest.mark.parametrize("block, pivots, shingle_cap, finish", [(200, 16, 500_000, 500_000), (6, 2, 500_000, 0), (200, 16, 60, 500_000)])
def test_against_all_pairs(spark, monkeypatch, block, pivots, shingle_cap, finish):
    monkeypatch.setattr(J, "FINISH", finish)
    monkeypatch.setattr(J, "BLOCK_DOCS", block)
    monkeypatch.setattr(J, "PROFILE_DOCS", 2 * block)
    monkeypatch.setattr(J, "PIVOTS", pivots)
    monkeypatch.setattr(J, "BLOCK_SHINGLES", shingle_cap)
    texts = ODD + corpus(1, 40, 6) + corpus(2, 3, 60, length=(60, 90), edits=4) + ODD[:5]
    rows = list(enumerate(texts, 10)) + [(None, texts[20]), (None, "nobody else says this at all today"), (11, texts[30])]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.join(df.repartition(5)).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    assert J.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trie_finds_what_all_pairs_find():
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(3)]
        sets = [np.unique(np.where(rng.random(len(b)) < 0.07, rng.integers(0, 60, len(b)), b)) for b in base for _ in range(8)]
        trie = J.Trie(sets)
        for q in sets:
            marked, hits = np.zeros(60, bool), []
            marked[q] = True
            trie.search(q, marked, lambda a, b: False, hits.append)
            want = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 80 * len(np.union1d(q, s))}
            assert {trie.order[i] for i in hits} == want and len(hits) == len(want)


@pytest.mark.parametrize("finish", [0, 1000])
def test_components(spark, monkeypatch, finish):
    monkeypatch.setattr(J, "FINISH", finish)
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 100), (300, 300), (7, 1000), (-5, 400), (400, 401)]
    got = {r.node: r.root for r in J.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {i: 0 for i in range(51)} | {1000: 0, 100: 100, 200: 100, -5: -5, 400: -5, 401: -5}
    assert J.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_profiles_never_part_similar_sets():
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 40, 300, 2500):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            keep = a[rng.random(len(a)) > rng.choice([0, 0.05, 0.12])]
            b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, n // 9 + 1), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            rows = [len(x).to_bytes(4, "little") + J.profile(x).tobytes() for x in (a, b)]
            links = J.Links()
            if len(b):
                J.bounded([1, 2], rows, links, [True, True])
            found = links.edges()
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                assert found == [(2, 1)]


def test_parted_components_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(J, "CROWDED", 0)
    monkeypatch.setattr(J, "PROFILE_DOCS", 8)
    for members in (100, 5):
        monkeypatch.setattr(J, "MEMBERS", members)
        texts = ODD + corpus(3, 40, 6) + corpus(4, 3, 60, length=(60, 90), edits=9) + ODD[:5]
        rows = list(enumerate(texts, 10)) + [(None, texts[20]), (None, "nobody else says this at all today"), (11, texts[30])]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.join(df.repartition(5)).collect())
        assert got == brute(rows)


def test_a_crowded_sketch_makes_no_large_components(spark, monkeypatch):
    monkeypatch.setattr(J, "BITS", (14, 14))
    monkeypatch.setattr(J, "PROFILE_DOCS", 40)
    rng = random.Random(7)
    passages = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(16)) for _ in range(1200)]
    rows = []
    for i in range(3000):  # each text shares passages with a few strangers; one in ten has a near copy
        own = [f"w{rng.randrange(10**6)}" for _ in range(170)]
        for p in rng.sample(passages, 3):
            own.insert(rng.randrange(len(own)), p)
        rows.append((2 * i, " ".join(own)))
        if i % 10 == 0:
            rows.append((2 * i + 1, rows[-1][1] + " end"))
    met, meet = [], J.meet
    monkeypatch.setattr(J, "meet", lambda placed, *how: met.append(placed.count()) or meet(placed, *how))
    got = {r.doc_id: r.component_id for r in J.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {d: d // 2 * 2 for d, _ in rows}
    assert sum(met) <= 3 * len(rows)
