"""SQL panels, repairs of rollups, presets, exports of all metric kinds, and functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkobs.functions import text as X
from sparkobs.operators import graph as G
from sparkobs.operators import measures as M
from sparkobs.operators import rollups as R
from sparkobs.plans import panels as V
from sparkobs.plans import sql
from sparkobs.queries.metric_queries import window_of
from sparkobs.queries.registry import query
from sparkobs.queries.row_queries import MINUTES, minutes
from sparkobs.queries.source_queries import CHUNK, shared
from sparkobs.sources import adapters as A
from sparkobs.sources import otlp
from sparkobs.streaming import jobs

c = F.col
HOUR, DAY = 3600, 86_400
r6 = lambda x: F.round(x, 6)
FROM_US, TO_US = A.ORIGIN_US + 5 * DAY * 1_000_000, A.ORIGIN_US + 9 * DAY * 1_000_000


@query(f"SELECT CAST(start_us // 21600000000 * 21600000000 AS BIGINT) AS at_us, service, count(*) AS n, max(duration_ms) AS slowest FROM spans WHERE start_us >= {FROM_US} AND start_us < {TO_US} AND kind IN ('SERVER', 'CLIENT') GROUP BY 1, 2", A.SPANS)
def sql_macros(spark, sf_dir):
    """A panel's window and bucket by macros, its variable by a parameter."""
    said = "SELECT CAST($__bucket(start_us) AS BIGINT) AS at_us, service, count(*) AS n, max(duration_ms) AS slowest FROM panel_spans WHERE $__window(start_us) AND array_contains(:kinds, kind) GROUP BY 1, 2"
    return sql.panel(spark, said, {"panel_spans": A.spans(spark, sf_dir)}, FROM_US, TO_US, 6 * HOUR, kinds=["SERVER", "CLIENT"])


@query("SELECT service, CAST(sum(spans) AS BIGINT) AS spans, round(max(p95_ms), 6) AS worst FROM m GROUP BY 1", A.SPANS, MINUTES)
def sql_rollup_view(spark, sf_dir):
    """Rollups are relations like any other."""
    own = minutes(spark, sf_dir).withColumn("bucket_us", c("bucket_ms") * 1000)
    return sql.panel(spark, "SELECT service, sum(spans) AS spans, round(max(p95_ms), 6) AS worst FROM service_rollup WHERE $__window(bucket_us) GROUP BY service", {"service_rollup": own}, 0, 2**62)


CORRELATED = "SELECT service, count(*) AS n FROM {t} s WHERE {w} AND EXISTS (SELECT 1 FROM {t} ch WHERE ch.parent_span_id = s.span_id AND ch.trace_id = s.trace_id) AND duration_ms > (SELECT avg(o.duration_ms) FROM {t} o WHERE o.kind = s.kind) GROUP BY service"


@query(CORRELATED.format(t="spans", w="TRUE"), A.SPANS)
def sql_correlated(spark, sf_dir):
    """Spans with children that are slower than their kind's mean: a semi join and a join on the mean."""
    return sql.panel(spark, CORRELATED.format(t="panel_spans", w="$__window(start_us)"), {"panel_spans": A.spans(spark, sf_dir)}, 0, 2**62)


@query("SELECT h AS hour, count(e.event_id) AS n FROM generate_series(0, 23) t(h) LEFT JOIN events e ON hour(e.ts) = h GROUP BY 1")
def sql_table_functions(spark, sf_dir):
    own = A.events(spark, sf_dir)
    return sql.panel(spark, "SELECT h AS hour, count(e.event_id) AS n FROM (SELECT explode(sequence(0, 23)) AS h) LEFT JOIN hourly_events e ON hour(e.ts) = h AND $__window(e.ts_us) GROUP BY 1", {"hourly_events": own}, 0, 2**62)


SAID = ("Information", "warn2", " ERR ", "panic", "verbose", "", "custom3", None)
SAYS = ("INFO", "WARN", "ERROR", "FATAL", "TRACE", "UNSPECIFIED", "CUSTOM", "UNSPECIFIED")


@query(f"SELECT CASE WHEN k % 4 = 0 AND k % 25 > 0 THEN ['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL'][least((k % 25 - 1) // 4, 5) + 1] ELSE {list(SAYS)}[event_id % 8 + 1] END AS severity, count(*) AS n FROM ev GROUP BY 1", A.SPANS)
def severity_normalized(spark, sf_dir):
    """Severities by number where there is one, else by any of their names."""
    own = A.events(spark, sf_dir).select(F.get(F.array(*map(F.lit, SAID)), (c("event_id") % 8).cast("int")).alias("t"), F.when(c("k") % 4 == 0, c("k") % 25).alias("n"))
    return own.groupBy(X.severity(c("t"), c("n")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN isfinite(x) THEN x END AS x FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE ELSE value END AS x FROM events) ORDER BY event_id LIMIT 1001")
def frame_capped(spark, sf_dir):
    """A result as it leaves: no value that is not finite, and one row beyond the cap that tells of more."""
    x = F.when(c("event_id") % 3 == 0, F.lit(float("nan"))).when(c("event_id") % 3 == 1, F.lit(float("inf"))).otherwise(c("value"))
    return V.frame(A.table(spark, sf_dir, "events").select("event_id", x.alias("x")).orderBy("event_id"))


@query("SELECT CAST(floor(dense_us / (step * 1000000)) AS BIGINT) * step * 1000 AS bucket_ms, CAST(count(*) AS DOUBLE) AS n FROM spans, (SELECT coalesce(min(s), 86400) AS step FROM (SELECT unnest([10, 30, 60, 300, 600, 900, 1800, 3600, 10800, 21600, 43200, 86400]) AS s), (SELECT (max(dense_us) // 60000000 + 1) * 60 - min(dense_us) // 60000000 * 60 AS w FROM spans) WHERE w // s + 1 <= 160) GROUP BY 1", A.SPANS)
def auto_interval(spark, sf_dir):
    """The bucket's width follows from the window: as many points as the panel has room for."""
    own = A.spans(spark, sf_dir, "dense_us")
    start, end = window_of(own.withColumnRenamed("start_us", "time_us"), 60)
    return V.timeseries(own, "start_us", V.interval((end - start) // 1_000_000), {"n": M.count()})


@query("SELECT namespace, dense_us // 60000000 * 60000 AS bucket_ms, service, count(*) AS spans FROM spans WHERE (dense_us // 60000000, service) IN (SELECT dense_us // 60000000, service FROM spans WHERE k < 10) GROUP BY 1, 2, 3", A.SPANS)
def rollup_affected(spark, sf_dir):
    """Minutes and services that new rows touch, recomputed from all rows."""
    own = A.spans(spark, sf_dir, "dense_us")
    keys = R.affected(own.where("k < 10"), "start_us")
    return R.service_rollup(own, A.logs(spark, sf_dir, "dense_us"), keys).select("namespace", "bucket_ms", "service", "spans")


@query("SELECT pa.service AS caller, ch.service AS callee, ch.dense_us // 60000000 * 60000 AS bucket_ms, count(*) AS calls FROM spans ch JOIN spans pa ON ch.namespace = pa.namespace AND ch.trace_id = pa.trace_id AND ch.parent_span_id = pa.span_id AND ch.service <> pa.service GROUP BY 1, 2, 3", A.SPANS)
def rollup_repair(spark, sf_dir):
    """Edges of early spans at rest, then the days that late parents and children change: the same as of all spans at once.

    On the dense clock an hour has some 500 spans, so that hours at rest would be as many small files as spans / 500."""
    own, root = A.spans(spark, sf_dir, "dense_us"), shared(spark)
    early, late = own.where("k < 50"), own.where("k >= 50")
    jobs.stored(G.call_edges(early), root, ["caller", "callee"], 24)
    jobs.stored(G.call_edges(R.in_hours(own, G.edge_hours(late, own, 24), "start_us", 24), parents=own), root, ["caller", "callee"], 24)
    return jobs.current(spark, root).select("caller", "callee", "bucket_ms", "calls")


@query("SELECT 'service_rollup' AS rollup, max(dense_us) // 60000000 * 60000 AS fresh_to_ms FROM spans UNION ALL SELECT 'log_rollup', max(dense_us) // 60000000 * 60000 FROM logs", A.SPANS, A.LOGS)
def rollup_freshness(spark, sf_dir):
    """How far each rollup is complete: its newest minute may still grow."""
    spans, logs = A.spans(spark, sf_dir, "dense_us"), A.logs(spark, sf_dir, "dense_us")
    return R.fresh_to({"service_rollup": R.service_rollup(spans, logs), "log_rollup": R.log_rollup(logs)})


@query(f"""SELECT 'latency' AS panel, start_us // {DAY * 1_000_000} * {DAY * 1000} AS bucket_ms, NULL AS operation, round(quantile_cont(duration_ms, 0.95), 6) AS value FROM spans GROUP BY 2
UNION ALL SELECT 'errors', start_us // {DAY * 1_000_000} * {DAY * 1000}, NULL, round(100.0 * avg(CASE WHEN status = 'ERROR' THEN 1.0 ELSE 0.0 END), 6) FROM spans GROUP BY 2 UNION ALL SELECT 'requests', start_us // {DAY * 1_000_000} * {DAY * 1000}, NULL, round(count(*) / {DAY}.0, 9) FROM spans GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'operations', NULL, operation, round(quantile_cont(duration_ms, 0.95), 6) AS v FROM spans WHERE kind IN ('SERVER', 'CONSUMER') GROUP BY 3 ORDER BY v DESC, operation LIMIT 400)""", A.SPANS)
def preset_performance(spark, sf_dir):
    """The panels of a service's performance: latency, errors, requests, slow operations."""
    shown = V.performance(A.spans(spark, sf_dir), "start_us", DAY)
    parts = [df.select(F.lit(k).alias("panel"), *(c(x) if x in df.columns else F.lit(None).cast(t).alias(x) for x, t in (("bucket_ms", "long"), ("operation", "string"))), F.round("value", 9 if k == "requests" else 6).alias("value")) for k, df in shown.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def exported_metrics(spark, sf_dir):
    """Three kinds of metrics as OTLP JSON exports by kind and chunk of points."""
    attribute = F.array(F.struct(F.lit("series").alias("key"), F.struct(c("series").alias("stringValue")).alias("value")))
    nano = lambda x: (c(x) * 1000).cast("string")
    point = F.struct(nano("time_us").alias("timeUnixNano"), nano("start_us").alias("startTimeUnixNano"), c("value").alias("asDouble"), c("count").cast("string").alias("count"), c("sum"), F.transform("counts", lambda x: x.cast("string")).alias("bucketCounts"), c("bounds").alias("explicitBounds"), attribute.alias("attributes"))
    rows = A.metric_points(spark, sf_dir).groupBy("name", "type", F.floor(c("ingested") / CHUNK).alias("chunk")).agg(F.collect_list(point).alias("dataPoints"))
    held = lambda *more: F.struct("dataPoints", *more)
    cumulative = F.lit(2).alias("aggregationTemporality")
    kinds = [F.when(c("type") == "gauge", held()).alias("gauge"), F.when(c("type") == "counter", held(cumulative, F.lit(True).alias("isMonotonic"))).alias("sum"), F.when(c("type") == "histogram", held(cumulative)).alias("histogram")]
    metric = F.struct("name", F.lit("By").alias("unit"), *kinds)
    return rows.select(F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))).alias("value"))


@query("""SELECT 'queue' AS name, 'gauge' AS type, '' AS temporality, count(*) AS n, count(DISTINCT series) AS series, round(sum(value), 2) AS total, CAST(0 AS BIGINT) AS seen FROM points UNION ALL SELECT 'requests', 'counter', 'cumulative', count(*), count(DISTINCT series), CAST(sum(value) AS DOUBLE), 0 FROM counters
UNION ALL SELECT 'latency', 'histogram', 'cumulative', count(*), count(DISTINCT series), 0.0, CAST(sum(nth + 1) AS BIGINT) FROM nth_points""", A.COUNTERS)
def otlp_metric_kinds(spark, sf_dir):
    """Gauges, counters and histograms through OTLP JSON and back."""
    own = otlp.points(exported_metrics(spark, sf_dir))
    return own.groupBy("name", "type", F.coalesce("temporality", F.lit("")).alias("temporality")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("series").alias("series"), F.coalesce(F.round(F.sum("value"), 2), F.lit(0.0)).alias("total"), F.coalesce(F.sum("hist_count"), F.lit(0)).alias("seen"))


@query("SELECT event_id, list_reverse([k, k + 1, k + 2]) || [0] AS turned, list_bool_and([k > 10, k < 90]) AS inside, isfinite(1.0 / nullif(k, 0)) AS whole, pow(2.0, k % 8) AS power, k % 7 AS rest, CAST(floor((0 - k) / 7) AS INTEGER) AS part FROM ev", A.SPANS)
def fn_math(spark, sf_dir):
    k = c("k")
    inverse = F.lit(1.0) / F.nullif(k, F.lit(0))
    return A.events(spark, sf_dir).select(
        "event_id", F.concat(F.reverse(F.array(k, k + 1, k + 2)), F.array(F.lit(0))).alias("turned"), F.forall(F.array(k > 10, k < 90), lambda x: x).alias("inside"), (~F.isnan(inverse) & (F.abs(inverse) < float("inf"))).alias("whole"),
        F.pow(F.lit(2.0), k % 8).alias("power"), (k % 7).alias("rest"), F.floor(-k / 7).cast("int").alias("part"),
    )
