import itertools
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkobs.llm import queries, sharding


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_each_cell_once_by_single_steps(spark, dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    df = spark.createDataFrame(cells, ", ".join(f"d{i} int" for i in range(dims)))
    path = [tuple(r)[:-1] for r in df.withColumn("h", sharding.hilbert_index([F.col(f"d{i}") for i in range(dims)], bits)).orderBy("h").collect()]
    assert sorted(path) == cells
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_ROWS", 50)
    rows = [(i, "text" * (i % 9), "en" if i % 3 else None, f"s{i % 5}", 4 * (i % 9), "x") for i in range(403)] + [(None, None, None, None, None, "x")] * 3 + [(7, "", "de", "s1", None, "x"), (8, "é" * 9000, "de", "s1", -4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string")
    got = queries.hilbert_shards(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
    curve = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert curve == sorted(curve)
    assert len({r.shard for r in queries.hilbert_shards(df.limit(5)).collect()}) == 5 and queries.hilbert_shards(df.limit(0)).count() == 0


def test_boxes_prune(spark):
    rows = [(i, "t", ["en", "de", "fr", "es"][i % 4], f"s{i // 4 % 8}", i % 977) for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    own = queries.hilbert_shards(df).join(df, "doc_id").groupBy("shard").agg(F.countDistinct("lang").alias("lang"), F.countDistinct("source").alias("source")).collect()
    assert sum(r.lang < 4 for r in own) > 20 and sum(r.source for r in own) / len(own) < 6


def test_written_shards_hold_all_rows_and_prune(spark, tmp_path):
    rows = [(i, f"text {i}", ["en", "de", "fr", "es"][i % 4], f"s{i // 4 % 8}", i % 977) for i in range(4000)] + [(None, None, "en", "s1", 5), (3, "text 3", "es", "s0", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    dims = [sharding.cell_of_text(F.col("lang")), sharding.cell_of_text(F.col("source")), sharding.cell_of_number(F.col("n_chars"))]
    sharding.write(df, dims, 16, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert Counter(map(str, back.drop("shard").collect())) == Counter(map(str, df.collect()))
    own = sharding.bounds(back, ["lang", "n_chars"]).collect()
    assert sum(r.rows for r in own) == 4002 and sum(r.least_lang <= "fr" <= r.most_lang and r.least_n_chars <= 900 <= r.most_n_chars for r in own) < 14


def test_index_at_production_size(spark):
    """8 bits in three dimensions: neighbours on the curve are neighbours in space, and the index is one to one, over whole planes and runs of it."""
    df = spark.range(1 << 24).where("id < 40000 or id between 8388608 - 20000 and 8388608 + 20000 or id >= (1 << 24) - 20000").selectExpr("int(id & 255) a", "int(shiftright(id, 8) & 255) b", "int(shiftright(id, 16)) c")
    df = spark.range(64 * 64 * 64).selectExpr("int(id & 63) + 96 a", "int(shiftright(id, 6) & 63) + 96 b", "int(shiftright(id, 12)) + 96 c").unionAll(df)
    rows = df.distinct().withColumn("h", sharding.hilbert_index([F.col("a"), F.col("b"), F.col("c")])).orderBy("h").collect()
    hs = [r.h for r in rows]
    assert len(set(hs)) == len(hs) and min(hs) >= 0 and max(hs) < 1 << 24
    near = [(p, q) for p, q in zip(rows, rows[1:]) if q.h == p.h + 1]
    assert len(near) > 250_000 and all(abs(p.a - q.a) + abs(p.b - q.b) + abs(p.c - q.c) == 1 for p, q in near)
