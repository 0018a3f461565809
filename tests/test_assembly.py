"""Metric panels, routed panels, measure expressions, receivers and folds on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from sparkobs.operators import assembly as B
from sparkobs.operators import insight as I
from sparkobs.operators import measures as M
from sparkobs.operators import metrics as K
from sparkobs.operators import predicates as P
from sparkobs.operators import receivers as V
from sparkobs.operators import rollups as R
from sparkobs.operators import rows as O
from sparkobs.operators.quantiles import narrowed
from sparkobs.plans import panels, routing, sql
from sparkobs.queries import ORACLE_SQL
from sparkobs.sources import adapters as A
from sparkobs.sources import dataset

S, SF = 1_000_000, "/root/testdata/sf0.001"
POINT = "name string, type string, temporality string, series string, host string, time_us long, ingested long, value double, start_us long, bounds array<double>, counts array<long>, sum double, count long"


def points(spark, *rows):
    names = [x.split()[0] for x in POINT.replace("array<double>", "x").replace("array<long>", "x").split(", ")]
    return spark.createDataFrame([tuple(({"ingested": i} | r).get(n) for n in names) for i, r in enumerate(rows)], POINT)


def gauge(t, v, series="a", **more):
    return {"name": "g", "type": "gauge", "series": series, "host": f"h{series}", "time_us": t * S, "value": v} | more


def test_null_is_one_of_the_top_values(spark):
    df = spark.createDataFrame([(x,) for x in [None, None, None, "a", "a", "b", ""]], "d string")
    count = lambda top: {r.d: r["count"] for r in panels.folded(df, "d", [F.desc("n"), F.asc("d")], top, n=F.count(F.lit(1))).groupBy("d").count().collect()}
    assert count(1) == {"": 4, "Other (2)": 3} and count(2) == {"": 4, "a": 2, "Other (1)": 1} and count(6) == {"": 4, "a": 2, "b": 1}


def test_measures_of_one_scan_by_kind(spark):
    rows = [gauge(5, 1.0), gauge(5, 9.0), gauge(10, 3.0), gauge(20, 5.0, "b"), gauge(130, 7.0, "b"), gauge(140, float("nan")), {"name": "other", "type": "gauge", "series": "z", "time_us": 0, "value": 99.0}]
    rows += [{"name": "c", "type": "counter", "temporality": "cumulative", "series": "c", "host": "h", "time_us": t * S, "value": v} for t, v in ((0, 1.0), (60, 61.0), (90, 5.0))]
    rows += [{"name": "d", "type": "counter", "temporality": "delta", "series": "d", "host": "h", "time_us": 50 * S, "start_us": 20 * S, "value": 30.0}]
    df = points(spark, *rows)
    measures = {"n": B.Measure("count"), "seen": B.Measure("count_distinct", "series"), "mean": B.Measure("avg"), "total": B.Measure("sum"), "latest": B.Measure("last"), "most": B.Measure("max"), "p50": B.Measure("quantile"), "sent": B.Measure("max", "ingested")}
    got = {r.bucket_ms: r for r in B.assembled(df, measures, 60, 0, 240 * S, name="g").collect()}
    # of the two points at 5 s the later one counts; NaN is a point as sent and no value; 9 is carried until the next point
    assert [(k, got[k].n, got[k].seen, got[k].mean, got[k].total, got[k].latest, got[k].most, got[k].p50, got[k].sent) for k in sorted(got)] == [
        (0, 4.0, 2.0, 5.5, 11.0, 8.0, 9.0, 5.0, 3.0), (60_000, 0.0, 0.0, 4.0, 8.0, 8.0, None, None, None), (120_000, 2.0, 2.0, 5.0, 10.0, 10.0, 7.0, 7.0, 5.0), (180_000, 0.0, 0.0, 5.0, 10.0, 10.0, None, None, None),
    ]
    rates = {"rate": B.Measure("rate"), "total": B.Measure("sum")}
    own = {(r.name, r.bucket_ms): (r.rate, r.total) for r in B.assembled(df.where("type = 'counter'"), rates, 60, 0, 180 * S, by=("name",)).collect()}
    assert own == {("c", 0): (1.0, 60.0), ("c", 60_000): (5 / 30, 5.0), ("c", 120_000): (5 / 30, None), ("d", 0): (1.0, 30.0), ("d", 60_000): (1.0, None), ("d", 120_000): (1.0, None)}
    with pytest.raises(ValueError, match="name of one metric"):
        B.assembled(df, {"mean": B.Measure("avg")}, 60, 0, S)
    assert B.lookback(measures) == K.LOOKBACK_US and B.lookback({"n": B.Measure("count"), "x": B.Measure("max", "ingested")}) == 0
    kinds = {r["name"]: (r.rate, r.mean) for r in B.diagnosed(df, {"rate": B.Measure("rate"), "mean": B.Measure("avg")}).collect()}
    assert kinds == {"g": (False, True), "other": (False, True), "c": (True, False), "d": (True, False)}
    assert [B.unit(x) for x in ("By", "%", "{request}", "1", "s", "")] == ["bytes", "percent", "count", "", "s", ""]


def test_points_before_the_window_only_help(spark):
    df = points(spark, *({"name": "c", "type": "counter", "temporality": "cumulative", "series": "c", "time_us": t * S, "value": float(t)} for t in (0, 540, 630)))
    got = {r.bucket_ms: (r.n, r.rate) for r in B.assembled(df, {"n": B.Measure("count"), "rate": B.Measure("rate")}, 60, 600 * S, 720 * S, name="c").collect()}
    assert got == {600_000: (1.0, 1.0), 660_000: (0.0, 1.0)}


def test_histogram_starts_deltas_and_bad_sums(spark):
    own = {"name": "h", "type": "histogram", "temporality": "cumulative", "series": "a", "bounds": [1.0]}
    rows = [own | x for x in ({"time_us": 0, "counts": [1, 1], "sum": 5.0, "start_us": 0}, {"time_us": S, "counts": [2, 2], "sum": float("inf"), "start_us": 0}, {"time_us": 2 * S, "counts": [3, 1], "sum": 7.0, "start_us": 0}, {"time_us": 3 * S, "counts": [4, 2], "sum": 9.0, "start_us": 2 * S}, {"time_us": 4 * S, "counts": [1], "sum": 1.0, "start_us": 2 * S})]
    rows.append(own | {"series": "d", "temporality": "delta", "time_us": 9 * S, "counts": [1, 0], "sum": 0.5, "start_us": 8 * S})
    got = [(r.series, r.gained, r.sum_inc, r.count_inc, r.reset, r.elapsed_us) for r in K.histogram_increases(points(spark, *rows).drop("count")).orderBy("series", "time_us").collect()]
    assert got == [("a", [2, 0], 2.0, 2, False, 2 * S), ("a", [4, 2], 9.0, 6, True, S), ("d", [1, 0], 0.5, 1, False, S)]
    kept = K.valid(points(spark, *rows)).count()
    assert kept == 4


PANELS = lambda: [
    routing.Panel("spans", {"n": ("count", None, 0), "bad": ("error_rate", None, 0), "mean": ("avg", "duration_ms", 0), "lo": ("min", "duration_ms", 0), "hi": ("max", "duration_ms", 0), "total": ("sum", "duration_ms", 0)}, by=("service", "status")),
    routing.Panel("spans", {"rate": ("rate", None, 0), "part": ("share", None, 0), "p90": ("quantile", "duration_ms", 0.9)}, "timeseries", ("kind",), ((F.col("service").isin("click", "view"), ("service",)),), 3600),
    routing.Panel("spans", {"n": ("count", None, 0), "p50": ("quantile", "duration_ms", 0.5)}, "stat", seconds=600),
]


@pytest.mark.parametrize("which", range(3))
def test_rollup_answers_as_rows_do(spark, which):
    spans, panel = A.spans(spark, SF, "dense_us"), PANELS()[which]
    assert routing.routable(panel)
    keys = [*(["at_ms"] if panel.seconds else []), *panel.by]
    a = {tuple(r[k] for k in keys): r for r in routing.over_rows(panel, spans, "start_us").collect()}
    b = {tuple(r[k] for k in keys): r for r in routing.answered(panel, spans, R.span_rollup(spans)).collect()}
    assert a.keys() == b.keys() and a
    for k, r in a.items():
        for name, (fn, _, _) in panel.measures.items():
            if fn != "quantile":
                assert b[k][name] == pytest.approx(r[name])
    # quantiles: those of a group lie within a bin of the rank's neighbours
    rows = spans.collect()
    for k, r in b.items():
        for name, (fn, _, q) in panel.measures.items():
            if fn == "quantile" and not panel.by:
                own = sorted(x.duration_ms for x in rows if x.start_us // 600_000_000 * 600_000 == k[0])
                at = max(0, -(-int(q * len(own) * 1000) // 1000) - 1)
                assert own[max(0, at - 1)] / 1.1 <= r[name] <= own[min(len(own) - 1, at + 1)] * 1.1


def test_what_no_rollup_answers(spark):
    n = {"n": ("count", None, 0)}
    bad = [routing.Panel("spans", n, by=("operation",)), routing.Panel("spans", n, "heatmap"), routing.Panel("spans", n, seconds=30), routing.Panel("spans", {"x": ("count_distinct", "trace_id", 0)}), routing.Panel("logs", {"x": ("error_rate", None, 0)}), routing.Panel("spans", n, filters=((F.lit(True), ("peer_service",)),)), routing.Panel("metrics", n), routing.Panel("spans", {"x": ("avg", "k", 0)})]
    assert not any(map(routing.routable, bad)) and routing.routable(routing.Panel("logs", n, by=("severity",)))


def test_expressions_units_and_directions(spark):
    n, bad = M.counted(), M.counted_if(F.lit(True), errors=True)
    ratio = bad / n
    assert (ratio.unit, (100 * ratio).unit, (ratio * 100).unit, (n + n).unit, (n + ratio).unit, (n * n).unit, (n / 60).unit) == ("ratio", "percent", "percent", "count", "none", "none", "count")
    assert ((1 - ratio).better, (-(1 - ratio)).better, (n / n).better, n.better, M.counted(True).better, M.failed().better) == ("higher", "lower", "", "higher", "lower", "lower")
    line = 3 - 2 * (n / 4)
    assert (line.root, line.a, line.b) == (n, -0.5, 3.0)
    assert M.aliases([M.measured("avg", "a"), M.measured("avg", "b"), n]) == ["avg_a", "avg_b", "count"]
    with pytest.raises(ValueError):
        M.aliases([n, n])


def test_log_errors_by_name_or_number(spark):
    df = spark.createDataFrame([("error", 0), ("x", 17), (None, None), ("info", 9), ("FATAL", None)], "severity string, number int")
    assert [r.x for r in df.select(M.log_error(F.col("number")).alias("x")).collect()] == [True, True, False, False, True]


def test_roles_and_caps(spark):
    df = spark.sql("SELECT 'a' AS name, timestamp'2024-01-01' AS t, date'2024-01-01' AS d, 1.5D AS v, 2 AS n, true AS ok")
    assert panels.roles(df) == {"name": "dimension", "t": "time", "d": "dimension", "v": "measure", "n": "measure", "ok": "dimension"}
    cells = spark.createDataFrame([(t, float(x), 1) for t in range(4) for x in range(3)], "bucket_ms long, lo double, n long")
    assert panels.capped_distribution(cells, 12).count() == 12 and {r.bucket_ms for r in panels.capped_distribution(cells, 8).collect()} == {2, 3}
    series = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, None)], "bucket_ms long, value double")
    assert [panels.reduced(series, how).first().value for how in ("last", "mean", "min", "max", "sum")] == [4.0, 3.0, 2.0, 4.0, 6.0]


def test_attributes_by_column_map_or_json(spark):
    df = spark.createDataFrame([("a", {"x.y": "1"}, '{"x.y": 2, "z": {"q": 1}}'), ("b", None, "broken"), ("c", {}, None)], "service string, attributes map<string,string>, bag string")
    rows = df.select(P.attribute(df, "service.name").alias("s"), P.attribute(df, "x.y").alias("m"), P.attribute(df, "x.y", "bag").alias("j")).collect()
    assert [tuple(r) for r in rows] == [("a", "1", "2"), ("b", None, None), ("c", None, None)]


def test_carry_forward_over_runs(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), t * 7, t, rng.random() < 0.1) for t in range(400)]
    df = spark.createDataFrame(rows, "by string, t long, id long, hit boolean").repartition(3)
    got = {r.id: r.last for r in O.carried_forward(df, "by", ["t", "id"], F.when(F.col("hit"), F.col("id")), F.floor(F.col("t") / 500), "last").collect()}
    last = {}
    for by, _, i, hit in rows:
        last[by] = i if hit else last.get(by)
        assert got[i] == last[by]


def test_episodes_that_span_days_merge(spark):
    day = I.DAY_US
    rows = [("n", "s", "k", a, b, t) for a, b, t in ((0, 5, "a"), (3, 3 * day, "b"), (day, day + 1, "c"), (2 * day, 2 * day + 1, "d"), (3 * day, 3 * day + 9, "e"), (3 * day + 10, 3 * day + 11, "f"))]
    got = sorted((r.start_us, r.end_us, r.title) for r in I.merged_episodes(spark.createDataFrame(rows, "namespace string, service string, kind string, start_us long, end_us long, title string")).collect())
    assert got == [(0, 3 * day + 9, "e"), (3 * day + 10, 3 * day + 11, "f")]


def test_receiver_witnesses(spark):
    schema = "namespace string, service string, name string, type string, temporality string, unit string, scope_name string, resource map<string,string>, attributes map<string,string>, time_us long, value double, start_us long, ingested long"
    cpu = lambda t, v, i=0, start=None: ("n", "s", "system.cpu.time", "counter", "cumulative", "s", "x", {"host.name": "h"}, {"cpu": "0"}, t * S, v, start, i)
    check = lambda t, v, cls: ("n", "s", "httpcheck.status", "gauge", None, "1", "x", {"host.name": "h"}, {"http.url": "u", "http.method": "GET", "http.status_class": cls}, t * S, v, None, 0)
    rows = [cpu(1, 5.0), cpu(10, 9.0), cpu(10, 8.0, 1), cpu(20, float("nan")), cpu(30, 2.0), cpu(40, 4.0, 0, 35 * S), check(5, 1.0, "2xx"), check(25, 0.0, "2xx"), check(45, 1.0, "5xx"), ("n", "s", "own.metric", "gauge", None, "1", "x", {}, {}, 0, 1.0, None, 0)]
    own = V.receiver_rollup(spark.createDataFrame(rows, schema))
    r = own.where("name = 'system.cpu.time'").first()
    assert (r.first_point.value, r.last_point.value, r.previous_point.value, r.previous_finite_point.value, r.counter_increase, r.counter_seconds) == (5.0, 4.0, 2.0, 2.0, 3.0 + 2.0 + 2.0, 39.0)
    assert [p.value for p in V.receiver_points(own).where("name = 'system.cpu.time'").orderBy("time_us").collect()] == [5.0, 2.0, 4.0]
    e = V.receiver_entities(own).where("receiver = 'check'").first()
    assert (tuple(e.first_observation), tuple(e.previous_observation), tuple(e.last_observation)) == ((5 * S, 1), (25 * S, 0), (45 * S, 0))
    states = {r.bucket_ms: r.failure for r in V.reachability(V.receiver_entities(own), 10, 120 * S).collect()}
    assert states == {0: 2, 10_000: 2, 20_000: 1, 30_000: 1, 40_000: 1, 50_000: 1, 60_000: 1, 70_000: 1} | {t: 2 for t in range(80_000, 120_000, 10_000)}


def test_hours_are_rewritten_alone(spark, tmp_path):
    root, h = f"{tmp_path}/d", dataset.HOUR_US
    dataset.replace(spark.createDataFrame([(1, "a"), (h + 1, "b")], "t long, v string"), root, "t", ["t"])
    dataset.replace(spark.createDataFrame([(h + 2, "c")], "t long, v string"), root, "t", ["t"])
    assert sorted(tuple(r) for r in dataset.read(spark, root, "t").collect()) == [(1, "a"), (h + 2, "c")]
    plan = dataset.read(spark, root, "t", h, 2 * h)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(hour" in plan and "PushedFilters: [IsNotNull(t)" in plan


def test_every_query_reads_a_table_and_few_are_without_twin():
    from sparkobs.queries import QUERIES

    assert set(QUERIES) - set(ORACLE_SQL) == {"alert_states"}


def test_macros_and_shapes():
    assert sql.expanded("SELECT $__bucket(t) FROM x WHERE $__window( a.t )") == "SELECT (floor(t / :width_us) * :width_us) FROM x WHERE (a.t >= :from_us AND a.t < :to_us)"
    for bad in ("SELECT 1", "SELECT $__window(t), $__nothing(t)"):
        with pytest.raises(ValueError):
            sql.expanded(bad)
    assert panels.compatible(1, 1, True) == ["timeseries", "state_timeline"] and panels.compatible(2, 1, False) == ["bar", "table"] and "bar" not in panels.compatible(2, 2, False)


def test_narrowed_quantiles_over_signs_ties_and_nulls(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.0, -1.5, 1e-9, 3.0, 3.0, rng.gauss(0, 50)])) for _ in range(500)] + [("a", None), ("a", float("nan")), ("c", None), ("d", 7.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    qs = {"p0": 0.0, "p50": 0.5, "p93": 0.93, "p100": 1.0}
    got = {r.k: r for r in narrowed(df, ["k"], "x", qs).collect()}
    assert set(got) == {"a", "b", None, "d"}
    for k, r in got.items():
        own = sorted(x for y, x in rows if y == k and x is not None and x == x)
        for name, q in qs.items():
            at = q * (len(own) - 1)
            low = int(at)
            assert r[name] == pytest.approx(own[low] + (own[min(low + 1, len(own) - 1)] - own[low]) * (at - low))


def test_blocks_of_hours_are_rewritten_and_read_whole(spark, tmp_path):
    root, h = f"{tmp_path}/d", dataset.HOUR_US
    put = lambda *rows: dataset.replace(spark.createDataFrame(rows, "t long, v string"), root, "t", ["t"], 24)
    put((1, "a"), (23 * h, "b"), (24 * h, "c"), (-1, "z"))
    put((25 * h, "d"))
    read = lambda *window: sorted(tuple(r) for r in dataset.read(spark, root, "t", *window, width=24).collect())
    assert read() == [(-1, "z"), (1, "a"), (23 * h, "b"), (25 * h, "d")]
    assert read(5 * h, 24 * h) == [(23 * h, "b")] and read(25 * h, 26 * h) == [(25 * h, "d")] and read(-h, 1) == [(-1, "z")]
