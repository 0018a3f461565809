"""Receivers, routed panels, measure expressions, detection, annotations, attributes and functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkobs.functions import text as X
from sparkobs.operators import insight as I
from sparkobs.operators import measures as M
from sparkobs.operators import predicates as P
from sparkobs.operators import receivers as V
from sparkobs.operators import rollups as R
from sparkobs.operators import rows as O
from sparkobs.plans import panels, routing
from sparkobs.queries.metric_queries import window_of
from sparkobs.queries.registry import query
from sparkobs.queries.row_queries import FIVE, HALF, MINUTES, TEMPLATED, minutes
from sparkobs.sources import adapters as A

c = F.col
HOUR, DAY = 3600, 86_400
r6 = lambda x: F.round(x, 6)
ERR = "avg(CASE WHEN status = 'ERROR' THEN 1.0 ELSE 0.0 END)"


@query("""SELECT time_us // 3600000000 * 3600000 AS bucket_ms, name, host, url, class, min(time_us) AS first_us, max(time_us) AS last_us, arg_max(pt, time_us) AS previous_us, round(sum(CASE WHEN pt IS NOT NULL THEN CASE WHEN value < pv THEN value ELSE value - pv END END), 4) AS increase, sum(time_us - pt) / 1e6 AS seconds
FROM (SELECT *, lag(value) OVER w AS pv, lag(time_us) OVER w AS pt FROM rc WINDOW w AS (PARTITION BY name, host, url, class, time_us // 3600000000 ORDER BY time_us)) GROUP BY 1, 2, 3, 4, 5""", A.RECEIVERS)
def receiver_rollup(spark, sf_dir):
    own = V.receiver_rollup(A.receivers(spark, sf_dir), HOUR)
    return own.select("bucket_ms", "name", "host", "url", "class", c("first_point.time_us").alias("first_us"), c("last_point.time_us").alias("last_us"), c("previous_point.time_us").alias("previous_us"), F.round("counter_increase", 4).alias("increase"), c("counter_seconds").alias("seconds"))


@query("SELECT name, CAST(sum(least(n, 3)) AS BIGINT) AS n, min(a) AS first_us, max(b) AS last_us FROM (SELECT name, count(*) AS n, min(time_us) AS a, max(time_us) AS b FROM rc GROUP BY name, host, url, class, time_us // 3600000000) GROUP BY 1", A.RECEIVERS)
def receiver_points(spark, sf_dir):
    own = V.receiver_points(V.receiver_rollup(A.receivers(spark, sf_dir), HOUR))
    return own.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"))


def seen_sql(us: int) -> str:
    """What two levels of witnesses keep of reports: first and last two of a series, then of an entity, in each bucket."""
    return f"""w AS (SELECT *, CASE WHEN name = 'httpcheck.status' THEN 'shop / GET ' || url || ' from ' || host ELSE host END AS label, CASE WHEN name = 'httpcheck.status' AND value > 0 AND class = '2xx' THEN 1 ELSE 0 END AS flag FROM
(SELECT *, row_number() OVER p AS r, count(*) OVER (PARTITION BY name, host, url, class, time_us // {us}) AS n FROM rc WHERE name <> 'httpcheck.duration' WINDOW p AS (PARTITION BY name, host, url, class, time_us // {us} ORDER BY time_us)) WHERE r = 1 OR r >= n - 1),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, label, time_us // {us} ORDER BY time_us) AS r2, count(*) OVER (PARTITION BY name, label, time_us // {us}) AS n2 FROM w) WHERE r2 = 1 OR r2 >= n2 - 1)"""


@query(", " + seen_sql(3_600_000_000) + """ SELECT time_us // 3600000000 * 3600000 AS bucket_ms, CASE WHEN name = 'httpcheck.status' THEN 'check' ELSE 'host' END AS receiver, label, arg_min(flag, time_us) AS first_flag, arg_max(flag, time_us) AS last_flag, max(time_us) AS last_us FROM e GROUP BY 1, 2, 3""", A.RECEIVERS)
def receiver_entities(spark, sf_dir):
    own = V.receiver_entities(V.receiver_rollup(A.receivers(spark, sf_dir), HOUR))
    return own.select("bucket_ms", "receiver", F.coalesce("endpoint_from", "host").alias("label"), c("first_observation.flag").alias("first_flag"), c("last_observation.flag").alias("last_flag"), c("last_observation.time_us").alias("last_us"))


@query("SELECT time_us // 86400000000 * 86400000 AS bucket_ms, host, version, min(time_us) AS first_us, max(time_us) AS last_us FROM rc GROUP BY 1, 2, 3", A.RECEIVERS)
def resource_rollup(spark, sf_dir):
    own = V.resource_rollup(A.receivers(spark, sf_dir), "metrics", "time_us", DAY)
    return own.select("bucket_ms", c("identity.host_name").alias("host"), c("identity.service_version").alias("version"), "first_us", "last_us")


@query(""", d AS (SELECT url, host, time_us, value FROM rc WHERE name = 'httpcheck.duration'), ends AS (SELECT unnest(range(min(time_us) // 60000000 * 60000000 + 60000000, max(time_us) // 60000000 * 60000000 + 60000001, 60000000)) AS e FROM d)
SELECT g.e // 1000 - 60000 AS bucket_ms, g.url, g.host, round(d.value, 6) AS latency_ms FROM (SELECT * FROM (SELECT DISTINCT url, host FROM d), ends) g ASOF JOIN d ON g.url = d.url AND g.host = d.host AND g.e > d.time_us WHERE d.time_us >= g.e - 300000000""", A.RECEIVERS)
def dash_check_latency(spark, sf_dir):
    points = V.receiver_points(V.receiver_rollup(A.receivers(spark, sf_dir)))
    own = V.check_latency(points, 60, *window_of(points.where("name = 'httpcheck.duration'"), 60))
    return own.select("bucket_ms", "url", "host", r6("latency_ms").alias("latency_ms"))


@query(", " + seen_sql(60_000_000) + """, a AS (SELECT label, time_us, CASE flag WHEN 1 THEN 0 ELSE 1 END AS failure, time_us - lag(time_us) OVER (PARTITION BY label ORDER BY time_us) AS gap FROM e WHERE name = 'httpcheck.status'),
k AS (SELECT *, last_value(gap IGNORE NULLS) OVER (PARTITION BY label ORDER BY time_us) AS every_us FROM a), ends AS (SELECT unnest(range(min(time_us) // 60000000 * 60000000 + 60000000, max(time_us) // 60000000 * 60000000 + 60000001, 60000000)) AS e FROM a)
SELECT g.label AS endpoint_from, g.e // 1000 - 60000 AS bucket_ms, CASE WHEN every_us IS NULL OR g.e - k.time_us >= 2 * every_us THEN 2 ELSE failure END AS failure FROM (SELECT * FROM (SELECT DISTINCT label FROM a), ends) g ASOF JOIN k ON g.label = k.label AND g.e > k.time_us""", A.RECEIVERS)
def dash_reachability(spark, sf_dir):
    rollup = V.receiver_rollup(A.receivers(spark, sf_dir))
    end = window_of(V.receiver_points(rollup).where("name = 'httpcheck.status'"), 60)[1]
    return V.reachability(V.receiver_entities(rollup), 60, end)


BINS = "CASE WHEN duration_ms > 0 THEN CAST(ceil(log2(duration_ms) * 8) AS INTEGER) ELSE -2147483648 END"


@query(f""", g AS (SELECT service, kind, CAST(count(*) AS DOUBLE) AS n, round(100.0 * {ERR}, 6) AS failed, round(avg(duration_ms), 6) AS mean, max(duration_ms) AS most FROM spans WHERE status <> 'UNSET' GROUP BY 1, 2),
h AS (SELECT service, kind, {BINS} AS bin, count(*) AS m FROM spans WHERE status <> 'UNSET' GROUP BY 1, 2, 3), q AS (SELECT *, sum(m) OVER (PARTITION BY service, kind ORDER BY bin) AS cum, sum(m) OVER (PARTITION BY service, kind) AS total FROM h),
p AS (SELECT service, kind, round(CASE WHEN bin = -2147483648 THEN 0.0 ELSE pow(2.0, (bin - 1) / 8.0) + greatest(0.0, least(1.0, (total * 0.95 - (cum - m)) / m)) * (pow(2.0, bin / 8.0) - pow(2.0, (bin - 1) / 8.0)) END, 6) AS p95 FROM q WHERE cum >= total * 0.95 QUALIFY row_number() OVER (PARTITION BY service, kind ORDER BY bin) = 1)
SELECT service, kind, n, round(100.0 * n / sum(n) OVER (), 6) AS part, failed, mean, most, p95 FROM g LEFT JOIN p USING (service, kind)""", A.SPANS)
def rollup_routed(spark, sf_dir):
    """A table that the minute rollup answers; its quantile comes from merged histograms."""
    spans = A.spans(spark, sf_dir, "dense_us")
    measures = {"n": ("count", None, 0), "part": ("share", None, 0), "failed": ("error_rate", None, 0), "mean": ("avg", "duration_ms", 0), "most": ("max", "duration_ms", 0), "p95": ("quantile", "duration_ms", 0.95)}
    panel = routing.Panel("spans", measures, by=("service", "kind"), filters=((c("status") != "UNSET", ("status",)),))
    assert routing.routable(panel)
    return routing.answered(panel, spans, R.span_rollup(spans)).withColumns({x: r6(x) for x in ("part", "failed", "mean", "p95")})


@query(f"SELECT dense_us // 600000000 * 600000 AS at_ms, operation, CAST(count(*) AS DOUBLE) AS n, round(count(*) / 600.0, 9) AS rate, round(quantile_cont(duration_ms, 0.5), 6) AS p50 FROM spans GROUP BY 1, 2", A.SPANS)
def rollup_unrouted(spark, sf_dir):
    """Operations are in no rollup: the rows answer."""
    spans = A.spans(spark, sf_dir, "dense_us")
    panel = routing.Panel("spans", {"n": ("count", None, 0), "rate": ("rate", None, 0), "p50": ("quantile", "duration_ms", 0.5)}, "timeseries", ("operation",), seconds=600)
    assert not routing.routable(panel)
    return routing.answered(panel, spans, R.span_rollup(spans)).withColumns({"rate": F.round("rate", 9), "p50": r6("p50")})


@query(f"""SELECT 'shop' AS namespace, bucket_ms, service, coalesce(spans, 0) AS spans, coalesce(log_count, 0) AS log_count, coalesce(metric_count, 0) AS metric_count FROM (SELECT dense_us // 60000000 * 60000 AS bucket_ms, service, count(*) AS spans FROM spans GROUP BY 1, 2)
FULL JOIN (SELECT dense_us // 60000000 * 60000 AS bucket_ms, service, count(*) AS log_count FROM logs GROUP BY 1, 2) USING (bucket_ms, service) FULL JOIN (SELECT dense_us // 60000000 * 60000 AS bucket_ms, 'svc' || (k % 3) AS service, count(DISTINCT k % 7) AS metric_count FROM spans GROUP BY 1, 2) USING (bucket_ms, service)""", A.SPANS, A.LOGS)
def rollup_service_metrics(spark, sf_dir):
    """The service rollup with the number of metrics that reported; some services send metrics alone."""
    points = A.events(spark, sf_dir).select(F.lit("shop").alias("namespace"), c("dense_us").alias("time_us"), F.concat(F.lit("svc"), (c("k") % 3).cast("string")).alias("service"), F.concat(F.lit("m"), (c("k") % 7).cast("string")).alias("name"))
    own = R.service_rollup(A.spans(spark, sf_dir, "dense_us"), A.logs(spark, sf_dir, "dense_us"), metrics=points)
    return own.select("namespace", "bucket_ms", "service", "spans", "log_count", "metric_count")


@query(f"SELECT operation, CAST(count(*) AS DOUBLE) AS n, round(100.0 * count(*) FILTER (WHERE status = 'ERROR') / count(*), 6) AS failed, round(100 - 100.0 * count(*) FILTER (WHERE status = 'ERROR') / count(*), 6) AS fine, round(-2 * max(duration_ms) + 1, 6) AS room FROM spans GROUP BY 1 ORDER BY n >= 20 DESC, fine, n DESC, operation LIMIT 8", A.SPANS)
def table_expression(spark, sf_dir):
    """Measure arithmetic: a share in percent, what is left of it (ranked by its worst, as its error share is), and a multiple of a duration."""
    failed = 100 * (M.counted_if(M.is_error(), errors=True) / M.counted())
    fine, room = 100 - failed, -2 * M.measured("max", "duration_ms", "ms") + 1
    assert (failed.unit, failed.better, fine.better, room.better) == ("percent", "lower", "higher", "higher")
    own = A.spans(spark, sf_dir).groupBy("operation").agg(M.count().alias("n"), r6(failed.column).alias("failed"), r6(fine.column).alias("fine"), r6(room.column).alias("room"))
    return own.orderBy(*M.ranking(fine, "fine", "n", "operation")).limit(8)


@query(f"{TEMPLATED} SELECT template, severity, service, count(*) AS n, min(time_us) AS first_us, max(time_us) AS last_us FROM t WHERE severity IN ('WARN', 'ERROR', 'FATAL') GROUP BY 1, 2, 3 HAVING count(*) >= 3 ORDER BY n DESC, template, severity, service LIMIT 50", A.LOGS)
def detector_patterns(spark, sf_dir):
    return patterns(spark, sf_dir)


def patterns(spark, sf_dir):
    logs = A.logs(spark, sf_dir)
    return I.repeated_patterns(logs, X.template(c("body"), with_json=False), 0, 2**62)


@query(f""", {HALF}, z AS (SELECT abs(now - base) / greatest(coalesce(sd, 0), 0.01) AS z FROM (SELECT avg(rate) FILTER (WHERE cur) AS now, avg(rate) FILTER (WHERE NOT cur) AS base, stddev(rate) FILTER (WHERE NOT cur) AS sd FROM bucket GROUP BY service)) {TEMPLATED},
p AS (SELECT severity, count(*) AS n FROM t WHERE severity IN ('WARN', 'ERROR', 'FATAL') GROUP BY template, severity, service HAVING count(*) >= 3)
SELECT CAST(greatest(0.0, 100.0 - (SELECT coalesce(sum(CASE WHEN z >= 3 THEN 15.0 WHEN z >= 2.5 THEN 10.0 WHEN z >= 2 THEN 5.0 ELSE 0.0 END), 0) FROM z) - (SELECT coalesce(sum(CASE WHEN severity = 'ERROR' AND n >= 10 THEN 5.0 WHEN severity = 'WARN' AND n >= 20 THEN 2.0 ELSE 0.0 END), 0) FROM p)) AS DOUBLE) AS score""", A.SPANS, A.LOGS)
def detector_health(spark, sf_dir):
    anomalies = I.error_anomalies(A.spans(spark, sf_dir), A.ORIGIN_US, FIVE, DAY)
    return I.health_score(anomalies, patterns(spark, sf_dir))


@query("SELECT bucket_ms // 3600000 * 3600000 AS at_ms, round(coalesce(sum(error_rate * spans) / nullif(sum(spans), 0), 0), 6) AS error_rate FROM m GROUP BY 1", A.SPANS, MINUTES)
def health_trend(spark, sf_dir):
    return I.health_trend(minutes(spark, sf_dir), HOUR).withColumn("error_rate", r6("error_rate"))


FROM_US, TO_US = A.ORIGIN_US + 10 * DAY * 1_000_000, A.ORIGIN_US + 20 * DAY * 1_000_000


@query(f""", v AS (SELECT service, service_version, min(start_us) AS seen FROM spans GROUP BY 1, 2), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY seen, service_version) AS nth FROM v) WHERE nth > 1 AND seen >= {FROM_US} AND seen < {TO_US}),
f AS (SELECT service, start_us AS s, start_us + 3600000000 AS e, operation FROM spans WHERE status = 'ERROR' AND kind = 'CLIENT' AND k < 5), g AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY service ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM f),
h AS (SELECT service, min(s) AS a, max(e) AS b, arg_max(operation, {{'s': s, 'e': e}}) AS title FROM (SELECT *, sum(fresh) OVER (PARTITION BY service ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS nth FROM g) GROUP BY service, nth)
SELECT service, 'deploy' AS kind, seen AS from_us, seen AS to_us, service_version AS title FROM d UNION ALL SELECT * FROM (SELECT service, 'error', a, b, title FROM h WHERE b > {FROM_US} AND a < {TO_US} ORDER BY b DESC, service LIMIT 1000)""", A.SPANS)
def annotations(spark, sf_dir):
    """Deploys and error episodes of ten days."""
    spans = A.spans(spark, sf_dir)
    episodes = I.merged_episodes(spans.where("status = 'ERROR' and kind = 'CLIENT' and k < 5").select("namespace", "service", F.lit("error").alias("kind"), "start_us", (c("start_us") + 3_600_000_000).alias("end_us"), c("operation").alias("title")))
    return I.annotations(R.deploys(R.version_rollup(spans)), episodes, FROM_US, TO_US).drop("namespace")


@query("SELECT service, count(*) AS n FROM logs WHERE contains(lower(body), 'user 1') GROUP BY 1 UNION ALL SELECT service, count(*) FROM spans WHERE contains(lower(operation), 'p3') GROUP BY 1", A.SPANS, A.LOGS)
def filter_free_text(spark, sf_dir):
    own = lambda df, signal, said: df.where(P.free_text(signal, said)).groupBy("service").agg(F.count(F.lit(1)).alias("n"))
    return own(A.logs(spark, sf_dir), "logs", "USER 1").unionAll(own(A.spans(spark, sf_dir), "spans", "P3"))


@query("SELECT event_type AS service, count(*) AS n FROM events WHERE CAST(props->>'$.k' AS INTEGER) = 42 GROUP BY 1")
def filter_attribute(spark, sf_dir):
    """A key without a column of its own is read out of the bag, one with a column from that."""
    own = A.table(spark, sf_dir, "events").withColumn("service", c("event_type"))
    return own.where(P.attribute(own, "k", "props") == "42").groupBy(P.attribute(own, "service.name", "props").alias("service")).agg(F.count(F.lit(1)).alias("n"))


@query(", u AS (SELECT 'http.route' AS name, http_route AS value FROM spans UNION ALL SELECT 'http.status_code', CAST(status_code AS VARCHAR) FROM spans UNION ALL SELECT 'peer.service', peer_service FROM spans) SELECT name, count(*) AS n, count(DISTINCT value) AS values, count(try_cast(value AS DOUBLE)) AS numbers, min(try_cast(value AS DOUBLE)) AS lo, max(try_cast(value AS DOUBLE)) AS hi FROM u WHERE value IS NOT NULL GROUP BY 1", A.SPANS)
def schema_discovery_bag(spark, sf_dir):
    own = A.spans(spark, sf_dir).select(F.to_json(F.struct(c("http_route").alias("http.route"), c("status_code").alias("http.status_code"), c("peer_service").alias("peer.service"))).alias("bag"))
    return I.discovered(own, "bag")


@query("SELECT service, array_to_string(list_sort(list_distinct(list(k % 10))), ',') AS joined, len(list_filter(list_distinct(list(k % 10)), lambda x: x > 6)) AS large, CAST(list_sum(flatten([list_distinct(list(k % 10)), [100, 100]])) AS BIGINT) AS total, CAST(list_unique(list(k % 10)) AS BIGINT) AS uniques FROM spans GROUP BY 1", A.SPANS)
def fn_lists(spark, sf_dir):
    own = A.spans(spark, sf_dir).groupBy("service").agg(F.array_sort(F.collect_set((c("k") % 10).cast("long"))).alias("xs"))
    total = F.aggregate(F.flatten(F.array("xs", F.array(F.lit(100), F.lit(100)).cast("array<bigint>"))), F.lit(0).cast("long"), lambda a, b: a + b)
    return own.select("service", F.array_join(F.transform("xs", lambda x: x.cast("string")), ",").alias("joined"), F.size(F.filter("xs", lambda x: x > 6)).cast("long").alias("large"), total.alias("total"), F.size(F.array_distinct("xs")).cast("long").alias("uniques"))


@query("SELECT event_id, epoch_us(ts + INTERVAL 90 SECOND) AS later, epoch_us(ts - INTERVAL 1 HOUR) AS earlier, epoch_us(CAST(make_timestamp_ns(event_id * 1000001000) AS TIMESTAMP)) AS made, epoch_ms(date_trunc('minute', ts)) AS minute FROM events")
def fn_time(spark, sf_dir):
    own = A.table(spark, sf_dir, "events").withColumn("t", c("ts").cast("timestamp"))
    us = F.unix_micros
    return own.select("event_id", us(F.expr("t + INTERVAL 90 SECOND")).alias("later"), us(F.expr("t - INTERVAL 1 HOUR")).alias("earlier"), us(F.timestamp_micros(F.expr("event_id * 1000001000 div 1000"))).alias("made"), F.unix_millis(F.date_trunc("minute", "t")).alias("minute"))


@query("SELECT sha256(event_type || user_id) AS h, substr(any_value(event_type), 2, 3) AS part, count(*) AS n FROM events GROUP BY 1")
def fn_hash(spark, sf_dir):
    own = A.table(spark, sf_dir, "events").withColumn("h", F.sha2(F.concat("event_type", c("user_id").cast("string")), 256))
    return own.groupBy("h").agg(F.substring(F.any_value("event_type"), 2, 3).alias("part"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, arg_max(value, {'t': ts, 'e': event_id}) OVER (PARTITION BY user_id) AS newest FROM events")
def win_arg_max(spark, sf_dir):
    """The current value of each user beside every row."""
    return A.table(spark, sf_dir, "events").select("event_id", F.max_by("value", F.struct("ts", "event_id")).over(Window.partitionBy("user_id")).alias("newest"))


@query(""", b AS (SELECT namespace, trace_id FROM spans GROUP BY 1, 2 HAVING bool_or(kind = 'SERVER') ORDER BY count(*) FILTER (WHERE status = 'ERROR') DESC, namespace, trace_id LIMIT 30)
SELECT trace_id, min(start_us) AS start_us, count(*) AS spans FROM spans WHERE trace_id IN (SELECT trace_id FROM b) GROUP BY 1""", A.SPANS)
def traces_by_errors(spark, sf_dir):
    return O.traces(A.spans(spark, sf_dir), c("kind") == "SERVER", n=30, by="errors").select("trace_id", "start_us", "spans")


@query("SELECT event_id, severity, time_us, body FROM logs WHERE k >= 40 AND k < 60 ORDER BY coalesce(list_position(['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL'], severity), 0) DESC, time_us DESC, event_id LIMIT 200", A.LOGS)
def exemplar_logs(spark, sf_dir):
    return O.exemplar_logs(A.logs(spark, sf_dir), c("k").between(40, 59)).select("event_id", "severity", "time_us", "body")


@query("SELECT 'peer' AS entry, count(*) AS without, CAST(0 AS BIGINT) AS alone FROM spans WHERE kind = 'CLIENT' AND status = 'ERROR' HAVING count(*) > 0", A.SPANS)
def diagnosis_culprit(spark, sf_dir):
    """The filter that empties a panel."""
    return I.culprit(I.diagnosis(A.spans(spark, sf_dir), {"kind": c("kind") == "CLIENT", "status": c("status") == "ERROR", "peer": c("peer_service") == "ext9"}))


LOG2 = "CASE WHEN duration_ms < 1 THEN 0.0 ELSE pow(2.0, least(32.0, floor(log2(duration_ms)))) END"


@query(f", h AS (SELECT CAST(floor(start_us / 21600000000) AS BIGINT) * 21600000 AS bucket_ms, {LOG2} AS lo, count(*) AS n FROM spans GROUP BY 1, 2), s AS (SELECT * FROM h ORDER BY bucket_ms DESC, lo LIMIT 101) SELECT * FROM s WHERE (SELECT count(*) FROM h) <= 100 OR bucket_ms > (SELECT min(bucket_ms) FROM s)", A.SPANS)
def dist_capped(spark, sf_dir):
    """A heatmap beyond its cap of cells loses its oldest, incomplete column."""
    return panels.capped_distribution(panels.heatmap(A.spans(spark, sf_dir), "start_us", 6 * HOUR, "duration_ms"), 100)


@query(", h AS (SELECT CAST(floor(start_us / 3600000000) AS BIGINT) * 3600000 AS bucket_ms, max(duration_ms) AS value FROM spans GROUP BY 1) SELECT round(avg(value), 6) AS mean, arg_max(value, bucket_ms) AS last FROM h", A.SPANS)
def stat_reduced(spark, sf_dir):
    own = panels.timeseries(A.spans(spark, sf_dir), "start_us", HOUR, {"value": F.max("duration_ms")})
    return panels.reduced(own, "mean").select(r6("value").alias("mean"), panels.reduced(own, "last").scalar().alias("last"))


@query("SELECT event_id, time_us, severity, body FROM logs WHERE user_id = 8 AND time_us >= 1704067200000000 AND time_us < 1704067200000000 + 86400000000 ORDER BY time_us, event_id LIMIT 200", A.LOGS)
def trace_logs(spark, sf_dir):
    """Log records of one trace."""
    day = F.date_format(F.timestamp_micros("time_us"), "yyyy-MM-dd")
    own = A.logs(spark, sf_dir).withColumn("trace_id", F.concat_ws("-", c("user_id").cast("string"), day))
    return O.trace_logs(own, "8-2024-01-01").select("event_id", "time_us", "severity", "body")


@query("SELECT trace_id, min(start_us) AS start_us, count(*) AS spans, CASE WHEN bool_or(status = 'ERROR') THEN 'ERROR' ELSE 'OK' END AS status FROM spans GROUP BY 1 ORDER BY bool_or(spans.status = 'ERROR') DESC, min(spans.start_us) DESC, trace_id LIMIT 1", A.SPANS)
def trace_notable(spark, sf_dir):
    return O.notable_trace(A.spans(spark, sf_dir)).select("trace_id", "start_us", "spans", "status")
