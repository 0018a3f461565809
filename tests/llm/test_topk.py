import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkobs.llm import topk


def brute(rows, k):
    own = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            own.setdefault((i, tuple(v)), np.floor(256 * np.array(v, np.float64)).astype(np.int64))
    out = []
    for (q, _), v in own.items():
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for (i, _), w in own.items() if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_threshold_algorithm_stops_early_and_is_exact():
    rng = np.random.default_rng(1)
    block = rng.integers(-50, 50, (4000, 4))
    order = np.argsort(block, axis=0, kind="stable").astype(np.int32)
    for q in (np.array([9, -3, 0, 1]), np.array([1, 1, 1, 1]), np.array([0, 0, 0, -5]), np.zeros(4, np.int64)):
        rows, scores, depth = topk.threshold_topk(block, order, q, 5)
        want = np.sort(block @ q)[::-1][:5]
        assert np.array_equal(np.sort(scores)[::-1][:5], want) and set(np.flatnonzero(block @ q >= want[-1])) == set(rows)
        assert depth < 4000


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "LEAST_ROWS", 20)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)]) for i in range(400)]
    rows += [(i, rows[50][1]) for i in range(1000, 1060)] + [(50, rows[50][1])]
    rows += [(2000, None), (2050, [0.1, None]), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, []), (2250, [1.0, 2.0]), (2251, [3.0, 1.0]), (None, [0.5] * 8), (2300, [0.0] * 8), (-50, [1e6] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    as_float = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute(as_float, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_products_beyond_64_bits_raise(spark):
    df = spark.createDataFrame([(0, [1e6, 1.0]), (1, [1e6, 2.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(df, F.col("vec_id") == 0).first().score == 256 * 256 * (10**12 + 2)
    for big in (1e10, 1e30):
        with pytest.raises(ValueError, match="64 bits"):
            topk.top_k(df.withColumn("embedding", F.array(F.lit(big), F.lit(1.0))), F.col("vec_id") == 0)


def test_no_list_is_collected_before_its_limit(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(200)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 3)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got.collect()) == [(q, i + 1, x) for q in (0, 50, 100, 150) for i, x in enumerate([x for x in range(4) if x != q][:3])]
    assert got._jdf.queryExecution().toString().count("WindowGroupLimit") >= 2 and "collect_set" not in got._jdf.queryExecution().toString()
