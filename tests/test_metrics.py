"""Metric kinds and functions on hand-made rows."""

import re
from functools import reduce

from pyspark.sql import functions as F

from sparkobs.functions import text
from sparkobs.operators import metrics as K
from sparkobs.operators import predicates as P
from sparkobs.plans import panels as V

S = 1_000_000


def test_null_truth_table(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "f string")
    f = F.col("f")
    kept = lambda p: {r.f for r in df.where(p).collect()}
    assert kept(f != "a") == {"b"} and kept(P.negated(f == "a")) == {"b", None} and kept(~f.isin("a")) == {"b"}
    assert kept(P.negated(P.negated(f == "a"))) == {"a"} and kept(P.negated(P.either(f == "a", f == "b"))) == {None}
    assert kept(P.lacks(f, "A")) == {"b", None} and kept(P.negated(P.exists(f))) == {None}
    assert P.variable(lambda v: f == v, P.ALL) is None and kept(P.variable(lambda v: f.isin(v), [])) == set()


def test_resets_gaps_and_spread(spark):
    rows = [(1, 0, 0, 10, 0), (1, 90 * S, 1, 40, 0), (1, 150 * S, 2, 5, 0), (1, 2000 * S, 3, 25, 0), (1, 2060 * S, 4, 30, 2000 * S)]
    df = spark.createDataFrame(rows, "series int, time_us long, ingested long, value long, start_us long")
    inc = K.increases(df)
    assert [(r.inc, r.reset, r.elapsed_us) for r in inc.orderBy("time_us").collect()] == [(30, False, 90 * S), (5, True, 60 * S), (20, False, 1850 * S), (30, True, 60 * S)]
    parts = {}
    for r in K.spread(inc, 60).collect():
        parts[r.bucket_ms] = parts.get(r.bucket_ms, 0) + r.part
    assert {k: round(v, 6) for k, v in parts.items()} == {0: 20.0, 60_000: 12.5, 120_000: 2.5, 1_980_000: 40.0, 2_040_000: 10.0}


def test_last_and_carry(spark):
    df = spark.createDataFrame([(1, 10 * S, 0, 1.0), (1, 60 * S, 1, 2.0), (1, 1000 * S, 2, 3.0)], "series int, time_us long, ingested long, value double")
    got = {r.bucket_ms: r.value for r in K.last_at(df, 60, 0, 1200 * S).collect()}
    assert got == {0: 1.0} | {60_000 * i: 2.0 for i in range(1, 6)} | {60_000 * i: 3.0 for i in range(16, 20)}
    carry = {(r.bucket_ms, r.is_carried): r.mean for r in K.carried(df, 60).collect()}
    assert carry == {(0, 0): 1.0, (60_000, 0): 2.0, (960_000, 0): 3.0} | {(60_000 * i, 1): 2.0 for i in range(2, 7)} | {(60_000 * i, 1): 3.0 for i in range(17, 22)}


def test_histogram_rebin_and_quantile(spark):
    rows = [(1, 0, 0, [10.0, 20.0, 50.0], [1, 1, 1, 0], 50), (1, 60 * S, 1, [20.0, 50.0], [4, 2, 1], 120), (1, 120 * S, 2, [15.0, 50.0], [4, 3, 1], 130), (1, 180 * S, 3, [15.0, 50.0], [0, 1, 0], 30)]
    df = spark.createDataFrame(rows, "series int, time_us long, ingested long, bounds array<double>, counts array<long>, sum long")
    got = [(r.gained, r.reset, r.sum_inc) for r in K.histogram_increases(df).orderBy("time_us").collect()]
    assert got == [([2, 1, 1], False, 70), ([4, 3, 1], True, 130), ([0, 1, 0], True, 30)]
    w = spark.createDataFrame([(10.0, 2), (20.0, 2), (None, 1)], "hi double, n long").withColumn("g", F.lit(1))
    value = lambda q: K.bucket_quantile(w, q, "g").first().value
    assert (value(0.5), value(0.2), value(0.99)) == (12.5, 5.0, 20.0)


def test_exponential_decode(spark):
    df = spark.createDataFrame([(1, 2, 0.0, 0, [3, 0, 5], 0, [7]), (0, 0, 0.5, -1, [1], 0, [])], "scale int, zero_count long, zero_threshold double, positive_offset int, positive_counts array<long>, negative_offset int, negative_counts array<long>")
    a, b = K.decoded(df).orderBy(F.desc("scale")).collect()
    assert [round(x, 6) for x in a.bounds] == [-1.0, 0.0, 1.414214, 2.0, 2.828427] and a.counts == [7, 2, 3, 0, 5, 0]
    assert b.bounds == [0.5, 1.0] and b.counts == [0, 1, 0]


def test_dedup_and_distribution(spark):
    df = spark.createDataFrame([(1, 5, 1, 1.0), (1, 5, 2, 9.0), (1, 5, 2, 7.0), (2, 5, 0, 3.0)], "series int, time_us long, ingested long, value double")
    assert {(r.series, r.value) for r in K.deduped(df).collect()} == {(1, 9.0), (2, 3.0)}
    d = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (3.9,), (2.0**40,), (float("nan"),), (None,), (-1.0,)], "v double")
    assert {(r.lo, r.n) for r in V.histogram(d, "v").collect()} == {(0.0, 2), (1.0, 1), (2.0, 1), (2.0**32, 1)}
    assert V.interval(3600) == 30 and V.interval(86_400, 240) == 1800


def test_redaction_templates_and_severity(spark):
    bodies = ["GET /a?api_key=abc&x=1", "Authorization: Bearer abc.def", 'token = "s p"; password: hunter2, ok', '{"password": "a\\"b", "n": 1}', "mon secret: é", "user 12 at 10.0.0.1:80 /a/b/c?q=1 a@b.co 0xDEADBEEF 2024-01-01T00:00:00Z", None, "", "é12 x", "z" * 498 + "éé"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")

    def by_re(b, pairs):
        return reduce(lambda s, p: re.sub(p[0], p[1].replace("$1", r"\1"), s, flags=re.ASCII), pairs, b)

    got = df.select(text.redacted(F.col("body")).alias("r"), text.template(F.col("body")).alias("t")).collect()
    for b, r in zip(bodies, got):
        assert r.r == (None if b is None else by_re(b, text.REDACTIONS))
        if b and not b.startswith("{"):
            assert r.t == by_re(b.encode()[:500].decode("utf-8", "ignore"), text.TEMPLATES)
    sev = spark.createDataFrame([("Information", None), ("WARN3", 0), (None, 24), ("x9", None), (None, None), ("a", 9)], "t string, n int")
    assert [r.s for r in sev.select(text.severity(F.col("t"), F.col("n")).alias("s")).collect()] == ["INFO", "WARN", "FATAL", "X", "UNSPECIFIED", "INFO"]


def test_exponential_histograms_count_zeros_and_both_signs(spark):
    rows = [(1, 1.0), (1, 3.0), (1, 0.0), (1, -0.0), (1, -1.0), (2, 0.0), (3, float("nan")), (3, float("inf")), (3, None), (4, 2.0), (4, None)]
    own = K.exponential(spark.createDataFrame(rows, "g int, value double"), 1, "g")
    by = {r.g: r for r in own.collect()}
    assert set(by) == {1, 2, 4}
    assert [(r.positive_offset, r.positive_counts, r.negative_offset, r.negative_counts, r.zero_count) for r in map(by.get, (1, 2, 4))] == [(0, [1, 0, 0, 1], 0, [1], 2), (0, [], 0, [], 1), (2, [1], 0, [], 0)]
    seen = {r.g: ([round(x, 6) for x in r.bounds], r.counts) for r in K.decoded(own).collect()}
    assert seen[1] == ([-1.0, 0.0, 1.414214, 2.0, 2.828427, 4.0], [1, 2, 1, 0, 0, 1, 0])
    assert (seen[2], seen[4]) == (([0.0], [1, 0]), ([0.0, 2.828427], [0, 1, 0]))
