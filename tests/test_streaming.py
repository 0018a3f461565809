import json

import pytest
from pyspark.sql import functions as F

from sparkobs.operators import alerts, graph, rollups
from sparkobs.queries import QUERIES
from sparkobs.sources import adapters as A
from sparkobs.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_stream_of_late_batches_equals_the_batch_rollup(spark, tmp_path):
    spans, logs = A.spans(spark, SF, "dense_us"), A.logs(spark, SF, "dense_us")
    own = spans.select("namespace", "service", "kind", "status", "start_us", "duration_ms", "event_id")
    for k in (2, 0, 1):  # rows of old minutes come late
        own.where(f"event_id % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = jobs.service_rollup(stream, lambda: (spark.read.parquet(f"{tmp_path}/in"), logs), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert q.awaitTermination(240)
    got = jobs.current(spark, f"{tmp_path}/out")
    want = rollups.service_rollup(own, logs).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_late_parents_and_children_repair_edges(spark, tmp_path):
    own = A.spans(spark, SF, "ts_us").select("namespace", "trace_id", "span_id", "parent_span_id", "service", "status", "start_us", "duration_ms", "event_id")
    for k in (2, 0, 1):
        own.where(f"event_id % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = jobs.edge_rollup(stream, lambda: spark.read.parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert q.awaitTermination(240)
    got = jobs.current(spark, f"{tmp_path}/out")
    want = graph.call_edges(own).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count()


def test_repair_touches_only_the_hours_of_new_rows_and_their_children(spark):
    rows = [("s", "t", "c", "p", 7_200_000_000), ("s", "t", "x", "", 0), ("s", "u", "p", "", 0)]
    spans = spark.createDataFrame(rows, "namespace string, trace_id string, span_id string, parent_span_id string, start_us long")
    new = spark.createDataFrame([("s", "t", "p", "", 3_700_000_000)], spans.schema)
    assert {r.hour for r in graph.edge_hours(new, spans).collect()} == {1, 2}


def test_late_spans_repair_whole_days(spark, tmp_path):
    own = A.spans(spark, SF, "dense_us").select("namespace", "trace_id", "span_id", "parent_span_id", "service", "status", "start_us", "duration_ms", "event_id")
    for k in (2, 0, 1):
        own.where(f"event_id % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert jobs.edge_rollup(stream, lambda: spark.read.parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", 24).awaitTermination(240)
    got = jobs.current(spark, f"{tmp_path}/out")
    want = graph.call_edges(own).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and len({x.split("/")[-2] for x in got.inputFiles()}) == 1


def test_windowed_counts(spark, tmp_path):
    A.table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/ev")
    df = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/ev").schema).parquet(f"{tmp_path}/ev")
    q = jobs.windowed(df, width="1 hour").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == 1000


def plain(rule, ticks):
    """An independent fold over (time, breach)."""
    out, firing, pending, told, ended = [], False, None, None, None
    for t, bad in ticks:
        if not bad:
            pending = None
            if firing:
                firing, ended = False, t
                out.append((t, "resolved"))
            continue
        if firing:
            if t - told >= rule.repeat_ms:
                out.append((t, "reminder"))
                told = t
        elif pending is not None:
            if t - pending >= rule.hold_ms - 1000:
                firing, told, pending = True, t, None
                out.append((t, "firing"))
        elif ended is None or t - ended >= rule.cooldown_ms:
            if rule.hold_ms:
                pending = t
                out.append((t, "pending"))
            else:
                firing, told = True, t
                out.append((t, "firing"))
    return out


@pytest.mark.parametrize("rule", [alerts.Rule("r"), alerts.Rule("r", 120_000, 300_000, 240_000), alerts.Rule("r", 0, 120_000, 600_000)])
def test_alert_notices(spark, rule):
    ticks = [(s, t * 60_000, (t * 7 + len(s) * t * t) % 11 < 6) for s in ("a", "bb", "ccc") for t in range(120)]
    got = alerts.notices(spark.createDataFrame(ticks, "service string, time_ms long, breach boolean"), rule).collect()
    for s in ("a", "bb", "ccc"):
        assert sorted((r.time_ms, r.event) for r in got if r.service == s) == plain(rule, [(t, b) for x, t, b in ticks if x == s])


def test_alert_stream_keeps_state(spark, tmp_path):
    rule = alerts.Rule("r", 120_000, 300_000, 0)
    ticks = [("a", t * 60_000, t % 9 < 6) for t in range(60)]
    schema = "service string, time_ms long, breach boolean"
    for k in range(3):
        spark.createDataFrame(ticks[k * 20 : k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/t")
    q = alerts.stream(df, rule).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    assert sorted((r.time_ms, r.event) for r in spark.read.parquet(f"{tmp_path}/o").collect()) == plain(rule, [x[1:] for x in ticks])


def test_registered_alert_states(spark):
    assert {r.event for r in QUERIES["alert_states"](spark, SF).collect()} >= {"pending"}


def test_otlp_kinds_and_logs(spark):
    from sparkobs.sources import otlp

    at = {"timeUnixNano": "1000", "startTimeUnixNano": "500"}
    metrics = [
        {"name": "g", "gauge": {"dataPoints": [at | {"asInt": "7"}]}},
        {"name": "c", "sum": {"isMonotonic": True, "aggregationTemporality": 2, "dataPoints": [at | {"asDouble": 1.5}]}},
        {"name": "u", "sum": {"aggregationTemporality": 1, "dataPoints": [at | {"asDouble": -1.5}]}},
        {"name": "h", "histogram": {"aggregationTemporality": 1, "dataPoints": [at | {"count": "3", "sum": 4.0, "bucketCounts": ["1", "2"], "explicitBounds": [5.0]}, at | {"count": "3", "bucketCounts": ["1"], "explicitBounds": [5.0]}]}},
        {"name": "e", "exponentialHistogram": {"aggregationTemporality": 1, "dataPoints": [at | {"count": "3", "scale": 1, "zeroCount": "1", "positive": {"offset": 2, "bucketCounts": ["1", "1"]}}]}},
        {"name": "s", "summary": {"dataPoints": [{"timeUnixNano": "9", "count": "1", "quantileValues": [{"quantile": 0.5, "value": 3.0}]}]}},
    ]
    doc = json.dumps({"resourceMetrics": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "x"}}]}, "scopeMetrics": [{"metrics": metrics}]}]})
    rows = sorted(otlp.points(spark.createDataFrame([(doc,), ("broken",), (None,)], "value string")).collect(), key=lambda r: (r.name, str(r.hist_bounds)))
    assert [(r.name, r.type, r.temporality) for r in rows] == [("c", "counter", "cumulative"), ("e", "exponential_histogram", "delta"), ("g", "gauge", None), ("h", "histogram", "delta"), ("h", "histogram", "delta"), ("s", "summary", None), ("u", "updown", "delta")]
    assert rows[2].value == 7.0 and rows[4].hist_counts == [1, 2] or rows[3].hist_counts == [1, 2]
    log = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{"timeUnixNano": "0", "observedTimeUnixNano": "5", "severityText": " Warning2 ", "body": {"stringValue": '{"b": 3, "a": "user 42"}'}}, {"severityNumber": 17, "body": {"intValue": "12"}}]}]}]})
    got = [(r.time_unix_nano, r.severity, r.body_template, r.namespace) for r in otlp.logs(spark.createDataFrame([(log,)], "value string")).collect()]
    assert got == [(5, "WARN", '{"a":"user <num>","b":"<num>"}', "default"), (None, "ERROR", "<num>", "default")]


def test_nested_attribute_values(spark):
    from sparkobs.sources import otlp

    values = {"a": {"arrayValue": {"values": [{"stringValue": "x"}, {"intValue": "2"}]}}, "m": {"kvlistValue": {"values": [{"key": "k", "value": {"boolValue": True}}, {"key": "d", "value": {"arrayValue": {"values": []}}}]}}, "b": {"bytesValue": "AAE="}, "s": {"stringValue": "t"}}
    doc = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [{"spanId": "1", "attributes": [{"key": k, "value": v} for k, v in values.items()]}]}]}]})
    assert otlp.spans(spark.createDataFrame([(doc,)], "value string")).first().attributes == {"a": '["x","2"]', "m": '{"k":"true","d":"{\\"values\\":[]}"}', "b": "AAE=", "s": "t"}
