"""Queries over tables of a shape that the driver's small ones lack: large ids, long times, and groups that outgrow a value."""

import duckdb
import pytest

from sparkobs.queries import ORACLE_SQL, QUERIES
from sparkobs.queries import source_queries as S


def write_events(spark, folder, first, n):
    """``n`` events from id ``first`` on, as the driver's."""
    own = spark.range(first, first + n).selectExpr(
        "id AS event_id", "timestamp_micros(1704067200000000 + id * 1000000)::timestamp_ntz AS ts", "id % 10 AS user_id", "element_at(array('click', 'error', 'purchase', 'signup', 'view'), int(id % 5) + 1) AS event_type",
        "(id * 37 % 1000) / 10.0D AS value", "concat('{\"k\": ', id * 31 % 100, '}') AS props",
    )
    own.write.parquet(f"{folder}/events.parquet")


def against_twin(spark, folder, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    res = db.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, str(folder)).select(*res.columns)
    got, want = (sorted(tuple(str(x) for x in r) for r in rows) for rows in (map(tuple, df.collect()), res.fetchall()))
    assert got == want and want


FIRST = ["metric_counter_increase", "metric_rate_spread", "metric_counter_rate", "metric_hist_buckets", "metric_hist_quantile", "metric_hist_avg", "metric_delta_sum", "win_lag_delta"]


@pytest.mark.parametrize("name", FIRST)
def test_points_past_the_millionth_event(spark, tmp_path, name):
    write_events(spark, tmp_path, 998_000, 6000)
    against_twin(spark, tmp_path, name)


def test_last_values_past_the_first_day(spark, tmp_path):
    write_events(spark, tmp_path, 0, 30_000)
    ends = [r.bucket_ms for r in QUERIES["metric_last_asof"](spark, str(tmp_path)).collect()]
    last = 1_704_067_200_000 + 29_999 * 7000
    assert last - 60_000 <= max(ends) <= last + 310_000
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    day = "1704067200000000 + 86400000000 + 1"
    assert day in ORACLE_SQL["metric_last_asof"]
    want = db.sql(ORACLE_SQL["metric_last_asof"].replace(day, "1704067200000000 + 3 * 86400000000 + 1")).fetchall()
    got = QUERIES["metric_last_asof"](spark, str(tmp_path)).select("bucket_ms", "series", "total").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_no_export_outgrows_its_chunk(spark, tmp_path):
    write_events(spark, tmp_path, 0, 70_000)  # 14,000 of a service and day
    folder = str(tmp_path)
    most = lambda exports, item: exports.selectExpr(f"size(split(value, '{item}')) - 1 AS n").agg({"n": "max"}).first()[0]
    assert most(S.exported(spark, folder), '"traceId"') <= 10_000
    assert most(S.exported_points(spark, folder), '"asDouble"') <= 20_000
    for name in ("otlp_spans", "otlp_points"):
        against_twin(spark, tmp_path, name)


def test_top_two_keep_no_lists(spark, tmp_path):
    write_events(spark, tmp_path, 0, 3000)
    assert "collect_list" not in QUERIES["agg_top_two"](spark, str(tmp_path))._jdf.queryExecution().toString()
    against_twin(spark, tmp_path, "agg_top_two")


def test_every_document_has_a_template(spark, tmp_path):
    rows = [(1, "took 5 ms"), (2, "é" * 300 + " 7"), (3, "x" * 499 + "é tail"), (4, "no digits " * 80), (5, None), (6, "")]
    own = spark.createDataFrame([(i, t, "web") for i, t in rows], "doc_id long, text string, source string")
    own.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.event_id: r.template for r in QUERIES["log_template_all"](spark, str(tmp_path)).collect()}
    short = {r.event_id: r.template for r in QUERIES["log_template"](spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _ in rows} and short == got
    assert (got[2], got[3], got[4], got[5]) == ("é" * 250, "x" * 499, ("no digits " * 80)[:500], None)


def test_exponential_histograms_hold_every_value(spark, tmp_path):
    write_events(spark, tmp_path, 0, 3000)  # some values are 0
    values = spark.read.parquet(f"{tmp_path}/events.parquet").groupBy("user_id").count()
    want = {r.user_id: r["count"] for r in values.collect()}
    assert {r.user_id: sum(r.counts) for r in QUERIES["metric_exp_hist"](spark, str(tmp_path)).collect()} == want


def test_repaired_edges_are_at_rest_by_day(spark, tmp_path):
    write_events(spark, f"{tmp_path}/one", 0, 30_000)  # 58 hours; seven users send all types
    spark.read.parquet(f"{tmp_path}/one/events.parquet").selectExpr("* EXCEPT (user_id)", "event_id % 7 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    days = {x.split("/")[-2] for x in QUERIES["rollup_repair"](spark, str(tmp_path)).inputFiles()}
    assert days == {f"hour={(1_704_067_200 // 3600) + 24 * i}" for i in range(3)}
    against_twin(spark, tmp_path, "rollup_repair")
