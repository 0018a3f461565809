import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from sparkobs.llm import mixing


def test_quotas_reshare_the_excess():
    got = mixing.quotas({"a": 100, "b": 1000, None: 10}, {"a": 5, "b": 2, None: 1}, 1665, 2)
    assert got == {"a": 200, "b": pytest.approx(1445), None: 20}
    assert mixing.quotas({"a": 1}, {"a": 1}, 50, 2) == {"a": 2} and mixing.quotas({}, {}, 0, 2) == {}


KEYS = (("ma",), ("ma", "mb"), ("mb",))


def brute_cost(capacity, quota, layers):
    """Least cost of the largest flow, over all ways to give whole words."""
    best = None
    keys = sorted(capacity)
    for gives in itertools.product(*(range(layers * capacity[p] + 1) for p in keys)):
        # can the sources take exactly these? greedy over all splits of the shared pattern
        a, ab, b = (dict(zip(keys, gives)).get(k, 0) for k in KEYS)
        if any(a + x <= quota["a"] and b + ab - x <= quota["b"] for x in range(ab + 1)):
            cost = sum(max(0, g - i * capacity[p]) for p, g in zip(keys, gives) for i in range(1, layers))
            best = max(best or (0, 0), (sum(gives), -cost))
    return best


def test_flow_is_largest_and_cheapest():
    for caps, quota in (((3, 4, 2), (6, 5)), ((1, 5, 1), (2, 9)), ((4, 0, 1), (8, 8)), ((2, 3, 4), (0, 7))):
        capacity = dict(zip(KEYS, caps))
        own = {"a": quota[0], "b": quota[1]}
        got = mixing.route(capacity, own, 2)
        cost = sum(max(0, g - capacity[p]) for p, g in got.items())
        assert (sum(got.values()), -cost) == brute_cost(capacity, own, 2)


def plain_flow(capacity, quota, layers):
    """Words in all and least cost, by one word at a time along the cheapest path (Bellman-Ford)."""
    arcs = {}
    for p, n in capacity.items():
        for i in range(layers):
            arcs["S", (p, i)], arcs[(p, i), p] = (n, i), (n, 0)
        for s in mixing.members(p):
            arcs[p, ("s", s)] = (10**9, 0)
    for s, n in quota.items():
        arcs[("s", s), "T"] = (n, 0)
    for (a, b), (_, c) in list(arcs.items()):
        arcs.setdefault((b, a), (0, -c))
    room, total, cost = {k: v[0] for k, v in arcs.items()}, 0, 0
    while True:
        far, by = {"S": 0}, {}
        for _ in range(len(arcs)):
            changed = False
            for (a, b), (_, c) in arcs.items():
                if room[a, b] and a in far and far[a] + c < far.get(b, 10**9):
                    far[b], by[b], changed = far[a] + c, a, True
            if not changed:
                break
        if "T" not in far:
            return total, cost
        at = "T"
        while at != "S":
            room[by[at], at] -= 1
            room[at, by[at]] += 1
            at = by[at]
        total, cost = total + 1, cost + far["T"]


def test_flow_over_overlapping_patterns_is_as_cheap_as_word_by_word():
    rng = random.Random(2)
    for _ in range(25):
        names = ["ma", "mb", "mc", "md", "n"]
        capacity = {tuple(sorted(rng.sample(names, rng.randrange(1, 4)))): rng.randrange(6) for _ in range(rng.randrange(1, 7))}
        quota = {s: rng.randrange(12) for s in ("a", "b", "c", "d", None)}
        got = mixing.route(capacity, quota, 2)
        assert all(0 <= g <= 2 * capacity[p] for p, g in got.items())
        assert (sum(got.values()), sum(max(0, g - capacity[p]) for p, g in got.items())) == plain_flow(capacity, quota, 2)


def test_flow_at_the_bound_of_patterns():
    rng = random.Random(4)
    names = [f"m{i:03}" for i in range(300)]
    capacity = {}
    while len(capacity) < mixing.MAX_PATTERNS:
        capacity[tuple(sorted(rng.sample(names, 3)))] = rng.randrange(1, 10**6)
    quota = {s[1:]: rng.randrange(10**9) for s in names}
    start = time.perf_counter()
    got = mixing.route(capacity, quota, 2)
    assert sum(got.values()) <= sum(quota.values()) and time.perf_counter() - start < 60


def test_names_may_hold_any_character(spark):
    rows = [(1, "w " * 3, "a\x1fb"), (2, "w " * 4, "a"), (3, "w " * 5, "b"), (4, "w", "")]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.array("source")).collect()}
    assert [got[i].source_size for i in (1, 2, 3, 4)] == [3, 4, 5, 1]
    sizes = {"": 1, "a": 4, "a\x1fb": 3, "b": 5}
    want = mixing.quotas(sizes, dict(zip(sorted(sizes), (5, 2, 1, 5))), 1.5 * 13, 2)
    assert all(got[i].target == pytest.approx(want[s]) and abs(got[i].taken - want[s]) <= 1 for i, _, s in rows)


def test_taken_against_a_plain_walk(spark):
    """Whole rounds of a source's documents, then words in the seeded order up to its rest."""
    df = spark.createDataFrame([(i, "w " * (i % 13), f"s{i % 3}") for i in range(400)], "doc_id long, text string, source string")
    order = {r.doc_id: r.h & (1 << 64) - 1 for r in df.select("doc_id", F.xxhash64("doc_id", F.size(F.filter(F.split("text", " "), lambda x: x != "")).cast("long"), F.lit(11)).alias("h")).collect()}
    sizes = {s: sum(i % 13 for i in range(400) if i % 3 == k) for k, s in enumerate(("s0", "s1", "s2"))}
    target = {s: round(t) for s, t in mixing.quotas(sizes, {"s0": 5, "s1": 2, "s2": 1}, 1.5 * sum(sizes.values()), 2).items()}
    got = {r.doc_id: r.taken for r in mixing.mix(df, F.array("source")).collect()}
    for k, s in enumerate(("s0", "s1", "s2")):
        rounds, rest = divmod(target[s], sizes[s])
        for i in sorted((i for i in range(400) if i % 3 == k and i % 13), key=order.get):
            more = min(rest, i % 13)
            assert got[i] == rounds * (i % 13) + more
            rest -= more


def docs(spark):
    rows = [(i, "word " * (i * 37 % 50), ["b", "a", "ä", None, "hot", "hot", "hot"][i % 7], i, "x") for i in range(900)]
    rows += [(1000, None, "a", 1, "x"), (1001, "", "empty", 1, "x"), (1002, "w w\x1cw " * 3000, "big", 1, "x"), (None, "null id here", "a", 1, "x"), (7, "twice the same", "b", 1, "x"), (7, "twice the same", "b", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, size string")


def test_mix(spark):
    df = docs(spark)
    got = mixing.mix(df, F.array("source")).collect()
    source = [(r.doc_id, len((r.text or "").encode().split()), r.source) for r in df.collect()]
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, n) for i, n, _ in source)
    sizes = {}
    for _, n, s in source:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = mixing.quotas(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), 2)
    by = {(i, n): s for i, n, s in source}
    total = {}
    for r in got:
        s = by[r.doc_id, r.size]
        total[s] = total.get(s, 0) + r.taken
        assert (r.source_size, r.target) == (sizes[s], pytest.approx(target[s])) and 0 <= r.taken <= 2 * r.size
    assert all(abs(total[s] - target[s]) <= 3 for s in names)
    again = mixing.mix(df.repartition(7), F.array("source")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(df.limit(0), F.array("source")).count() == 0


def test_overlap_and_selection(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate([["a"], ["a", "b"], ["b"], ["b", "a", "a"], ["c"], []] * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    got = mixing.mix(df, F.col("sources"), share=0.5).collect()
    assert abs(sum(r.taken for r in got) - 1500) <= 3 and all(r.taken == 0 for r in got if r.doc_id % 6 == 5)
    chosen = mixing.select(docs(spark), F.array("source"))
    assert chosen.columns == docs(spark).columns
    times = {}
    for r in chosen.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    want = {r.doc_id: (2 * r.taken + r.size) // (2 * r.size) for r in mixing.mix(docs(spark), F.array("source")).collect() if r.size and r.doc_id not in (None, 7)}
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in times.items() if k not in (None, 7)}
