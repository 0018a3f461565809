"""Rows, discovery, joins, sets, windows and insight."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkobs.functions import text as X
from sparkobs.operators import insight as I
from sparkobs.operators import rollups as R
from sparkobs.operators import rows as O
from sparkobs.queries.registry import query
from sparkobs.sources import adapters as A

c = F.col
DAY_US = 86_400_000_000
ERR = "avg(CASE WHEN status = 'ERROR' THEN 1.0 ELSE 0.0 END)"


def sql_patterns(column: str, pairs) -> str:
    for p, r in pairs:
        column = "regexp_replace({}, '{}', '{}', 'g')".format(column, p.replace("'", "''"), r.replace("$1", "\\1").replace("'", "''"))
    return column


REDACT = sql_patterns("body", X.REDACTIONS)
DOC_LOGS = "dl AS (SELECT doc_id AS event_id, 1704067200000000 + doc_id * 60000000 AS time_us, text AS body, source AS service FROM documents)"


def doc_logs(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select(c("doc_id").alias("event_id"), (F.lit(A.ORIGIN_US) + c("doc_id") * 60_000_000).alias("time_us"), c("text").alias("body"), c("source").alias("service"))


@query("SELECT event_id, time_us, body, severity FROM logs ORDER BY time_us DESC, event_id DESC LIMIT 100", A.LOGS)
def logs_tail(spark, sf_dir):
    return O.logs_tail(A.logs(spark, sf_dir)).select("event_id", "time_us", "body", "severity")


@query(f"SELECT event_id, left({REDACT}, 2000) AS body FROM dl WHERE contains(lower({REDACT}), '[redacted]') ORDER BY time_us DESC, event_id DESC LIMIT 1000", DOC_LOGS)
def logs_redacted(spark, sf_dir):
    return O.logs_tail(doc_logs(spark, sf_dir), 1000, "[REDACTED]").select("event_id", "body")


@query(f"SELECT service, count(*) AS n, count(*) FILTER (WHERE {REDACT} <> body) AS changed, CAST(sum(length({REDACT})) AS BIGINT) AS size FROM dl GROUP BY 1", DOC_LOGS)
def redaction_totals(spark, sf_dir):
    own = doc_logs(spark, sf_dir).withColumn("clean", X.redacted(c("body")))
    return own.groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("clean") != c("body")).alias("changed"), F.sum(F.length("clean")).alias("size"))


#: The longest prefix of whole characters within 500 bytes: at 4 bytes a character at most, one of 125 or more.
HEAD = "CASE WHEN octet_length(encode(body)) <= 500 THEN body ELSE left(body, list_max(list_filter(range(125, 501), lambda n: octet_length(encode(left(body, n))) <= 500))) END"
HEADS = f"{DOC_LOGS}, hd AS (SELECT event_id, {HEAD} AS body FROM dl)"
HEAD_TEMPLATE = sql_patterns("body", X.TEMPLATES)


@query(f"SELECT event_id, {HEAD_TEMPLATE} AS template FROM hd", HEADS)
def log_template(spark, sf_dir):
    """The template of every body, cut at 500 bytes."""
    return doc_logs(spark, sf_dir).select("event_id", X.template(c("body")).alias("template"))


@query(f"SELECT event_id, {HEAD_TEMPLATE} AS template FROM hd", HEADS)
def log_template_all(spark, sf_dir):
    return log_template(spark, sf_dir)


@query(f"SELECT {HEAD_TEMPLATE} AS template, count(*) AS n FROM hd GROUP BY 1", HEADS)
def log_template_whole(spark, sf_dir):
    """Templates of all bodies, cut at 500 bytes."""
    return doc_logs(spark, sf_dir).groupBy(X.template(c("body")).alias("template")).agg(F.count(F.lit(1)).alias("n"))


TEMPLATED = f", t AS (SELECT *, {sql_patterns('body', X.TEMPLATES)} AS template FROM logs)"
PATTERNS = TEMPLATED + """, p AS (SELECT template, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, template LIMIT 4)"""


@query(f"""{PATTERNS}, s AS (SELECT template, severity FROM (SELECT template, severity, count(*) AS m FROM t GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY template ORDER BY m DESC, list_position(['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL'], severity) DESC NULLS LAST, severity DESC) = 1),
v AS (SELECT template, service FROM (SELECT template, service, count(*) AS m FROM t GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY template ORDER BY m DESC, service) = 1)
SELECT template, n, severity, service FROM p JOIN s USING (template) JOIN v USING (template)""", A.LOGS)
def log_patterns(spark, sf_dir):
    return O.log_patterns(A.logs(spark, sf_dir), 4)


@query(f"""{PATTERNS}, g AS (SELECT template, 1704067200000 + d * 86400000 AS bucket_ms FROM p, range(40) r(d)),
k AS (SELECT template, (time_us // 86400000000) * 86400000 AS bucket_ms, count(*) AS n FROM t GROUP BY 1, 2) SELECT template, bucket_ms, coalesce(k.n, 0) AS n FROM g LEFT JOIN k USING (template, bucket_ms)""", A.LOGS)
def log_pattern_trend(spark, sf_dir):
    own = A.logs(spark, sf_dir)
    return O.pattern_trend(own, O.log_patterns(own, 4), 86_400, A.ORIGIN_US, A.ORIGIN_US + 40 * DAY_US)


ROOTS = """SELECT namespace, trace_id, arg_min(span_id, {'a': parent_span_id <> '', 'b': start_us, 'c': span_id}) AS root, arg_min(service, {'a': parent_span_id <> '', 'b': start_us, 'c': span_id}) AS service, arg_min(operation, {'a': parent_span_id <> '', 'b': start_us, 'c': span_id}) AS operation,
min(start_us) AS start_us, max(duration_ms) AS duration_ms, count(*) AS spans, CASE WHEN bool_or(status = 'ERROR') THEN 'ERROR' ELSE 'OK' END AS status FROM spans"""


@query(f", b AS (SELECT namespace, trace_id FROM spans GROUP BY 1, 2 HAVING bool_or(kind = 'SERVER') ORDER BY max(duration_ms) DESC, namespace, trace_id LIMIT 50) {ROOTS} WHERE trace_id IN (SELECT trace_id FROM b) GROUP BY 1, 2", A.SPANS)
def traces_list(spark, sf_dir):
    return O.traces(A.spans(spark, sf_dir), c("kind") == "SERVER", n=50)


@query(f", b AS (SELECT namespace, trace_id FROM spans GROUP BY 1, 2 HAVING bool_or(kind = 'SERVER') AND NOT bool_or(coalesce(peer_service = 'ext1', FALSE)) ORDER BY max(duration_ms) DESC, namespace, trace_id LIMIT 50) {ROOTS} WHERE trace_id IN (SELECT trace_id FROM b) GROUP BY 1, 2", A.SPANS)
def traces_exclude(spark, sf_dir):
    return O.traces(A.spans(spark, sf_dir), c("kind") == "SERVER", c("peer_service") == "ext1", 50)


@query("SELECT span_id, parent_span_id, service, operation, start_us, duration_ms, status FROM spans WHERE trace_id = '8-2024-01-01'", A.SPANS)
def trace_detail(spark, sf_dir):
    return O.trace_detail(A.spans(spark, sf_dir), "8-2024-01-01")


@query(f", n AS (SELECT trace_id, duration_ms FROM spans WHERE service = 'error' AND duration_ms >= 16 ORDER BY duration_ms DESC, span_id LIMIT 64), b AS (SELECT trace_id FROM n GROUP BY 1 ORDER BY max(duration_ms) DESC, trace_id LIMIT 20) {ROOTS} WHERE trace_id IN (SELECT trace_id FROM b) GROUP BY 1, 2", A.SPANS)
def exemplars(spark, sf_dir):
    return O.exemplars(A.spans(spark, sf_dir), (c("service") == "error") & (c("duration_ms") >= 16))


# Large traces: an order and its line items.
LARGE = """large AS (SELECT 'o' || o_orderkey AS trace_id, 'root' AS span_id, '' AS parent_span_id, 'orders' AS service, CAST(o_totalprice / 100 AS DOUBLE) AS duration_ms, 'OK' AS status FROM orders
UNION ALL SELECT 'o' || l_orderkey, CAST(l_linenumber AS VARCHAR), 'root', 'supp' || (l_suppkey % 10), l_extendedprice / 100, CASE WHEN l_returnflag = 'R' THEN 'ERROR' ELSE 'OK' END FROM lineitem)"""


def large(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), c("o_orderkey").cast("string")).alias("trace_id"), F.lit("root").alias("span_id"), F.lit("").alias("parent_span_id"), F.lit("orders").alias("service"), (c("o_totalprice") / 100).alias("duration_ms"), F.lit("OK").alias("status"))
    li = A.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), c("l_orderkey").cast("string")).alias("trace_id"), c("l_linenumber").cast("string").alias("span_id"), F.lit("root").alias("parent_span_id"), F.concat(F.lit("supp"), (c("l_suppkey") % 10).cast("string")).alias("service"), (c("l_extendedprice") / 100).alias("duration_ms"), F.when(c("l_returnflag") == "R", "ERROR").otherwise("OK").alias("status"))
    return o.unionByName(li)


@query(f"SELECT p.service AS caller, ch.service AS callee, count(*) AS calls, round(100.0 * {ERR.replace('status', 'ch.status')}, 6) AS error_rate FROM large ch JOIN large p ON ch.trace_id = p.trace_id AND ch.parent_span_id = p.span_id AND ch.service <> p.service GROUP BY 1, 2", LARGE)
def edges_large(spark, sf_dir):
    own = large(spark, sf_dir)
    parents = own.where("parent_span_id = ''").select("trace_id", c("span_id").alias("parent_span_id"), c("service").alias("caller"))
    got = own.where("parent_span_id <> ''").join(parents, ["trace_id", "parent_span_id"]).where("caller <> service")
    return got.groupBy("caller", c("service").alias("callee")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.lit(100.0) * F.avg(F.when(c("status") == "ERROR", 1.0).otherwise(0.0)), 6).alias("error_rate"))


@query("SELECT service, count(*) AS n FROM spans s WHERE EXISTS (SELECT 1 FROM logs l WHERE l.user_id || '' = split_part(s.trace_id, '-', 1) AND l.severity = 'WARN' AND l.k >= 90) GROUP BY 1", A.SPANS, A.LOGS)
def join_semi(spark, sf_dir):
    users = A.logs(spark, sf_dir).where("severity = 'WARN' and k >= 90").select(c("user_id").cast("string").alias("u"))
    return A.spans(spark, sf_dir).withColumn("u", F.split_part("trace_id", F.lit("-"), F.lit(1))).join(users, "u", "left_semi").groupBy("service").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT service, count(*) AS n FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans ch WHERE ch.trace_id = s.trace_id AND ch.parent_span_id = s.span_id) GROUP BY 1", A.SPANS)
def join_anti(spark, sf_dir):
    own = A.spans(spark, sf_dir)
    return own.join(own.where("parent_span_id <> ''").select("trace_id", c("parent_span_id").alias("span_id")), ["trace_id", "span_id"], "left_anti").groupBy("service").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(a.k, b.k) AS k, a.n AS calls, b.n AS queued FROM (SELECT peer_service AS k, count(*) AS n FROM spans WHERE status = 'ERROR' GROUP BY 1) a
FULL JOIN (SELECT messaging_destination AS k, count(*) AS n FROM spans WHERE status = 'OK' GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k""", A.SPANS)
def join_full_outer_nullsafe(spark, sf_dir):
    own = A.spans(spark, sf_dir)
    a = own.where("status = 'ERROR'").groupBy(c("peer_service").alias("ka")).agg(F.count(F.lit(1)).alias("calls"))
    b = own.where("status = 'OK'").groupBy(c("messaging_destination").alias("kb")).agg(F.count(F.lit(1)).alias("queued"))
    return a.join(b, c("ka").eqNullSafe(c("kb")), "full_outer").select(F.coalesce("ka", "kb").alias("k"), "calls", "queued")


@query("SELECT s.event_id, l.event_id AS log_id FROM (SELECT *, CAST(split_part(trace_id, '-', 1) AS BIGINT) AS u FROM spans WHERE kind = 'SERVER') s ASOF JOIN (SELECT * FROM logs WHERE severity = 'ERROR') l ON s.u = l.user_id AND s.start_us > l.time_us", A.SPANS, A.LOGS)
def join_asof(spark, sf_dir):
    """The last error of the same user strictly before each server span: both sides in one sorted stream by user, no theta join."""
    s = A.spans(spark, sf_dir).where("kind = 'SERVER'").select(F.split_part("trace_id", F.lit("-"), F.lit(1)).cast("long").alias("u"), c("start_us").alias("t"), F.lit(0).alias("side"), "event_id", F.lit(None).cast("long").alias("log_id"))
    g = A.logs(spark, sf_dir).where("severity = 'ERROR'").select(c("user_id").alias("u"), c("time_us").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("event_id"), c("event_id").alias("log_id"))
    w = Window.partitionBy("u").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, -1)
    return s.unionByName(g).withColumn("log_id", F.when(c("side") == 0, F.last("log_id", ignorenulls=True).over(w))).where("side = 0 and log_id is not null").select("event_id", "log_id")


@query("SELECT service AS name FROM spans UNION SELECT peer_service FROM spans UNION SELECT operation FROM spans", A.SPANS)
def set_union_distinct(spark, sf_dir):
    own = A.spans(spark, sf_dir)
    return own.select(c("service").alias("name")).union(own.select("peer_service")).union(own.select("operation")).distinct()


@query("SELECT service, count(*) AS n, NULL AS kind FROM logs GROUP BY 1 UNION ALL BY NAME SELECT kind, service, count(*) AS n FROM spans GROUP BY 1, 2", A.SPANS, A.LOGS)
def set_union_by_name(spark, sf_dir):
    a = A.logs(spark, sf_dir).groupBy("service").agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(A.spans(spark, sf_dir).groupBy("kind", "service").agg(F.count(F.lit(1)).alias("n")), allowMissingColumns=True)


@query("(SELECT trace_id FROM spans WHERE status = 'ERROR' INTERSECT SELECT trace_id FROM spans WHERE kind = 'CLIENT') EXCEPT SELECT trace_id FROM spans WHERE service = 'view'", A.SPANS)
def set_intersect_except(spark, sf_dir):
    own = A.spans(spark, sf_dir)
    ids = lambda p: own.where(p).select("trace_id")
    return ids("status = 'ERROR'").intersect(ids("kind = 'CLIENT'")).subtract(ids("service = 'view'"))


COLUMNS = ["service", "kind", "status", "peer_service", "http_route"]


@query(", l AS (UNPIVOT (SELECT service, kind, status, peer_service, http_route FROM spans) ON service, kind, status, peer_service, http_route INTO NAME name VALUE value) SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, value) AS INTEGER) AS rank, value, count(*) AS n FROM l GROUP BY name, value QUALIFY rank <= 5", A.SPANS)
def unpivot_values(spark, sf_dir):
    return I.top_values(A.spans(spark, sf_dir), COLUMNS)


@query("SELECT k.key AS name, count(*) AS n, min(CAST(props->>k.key AS BIGINT)) AS lo, max(CAST(props->>k.key AS BIGINT)) AS hi FROM events, (SELECT unnest(['k']) AS key) k GROUP BY 1")
def schema_discovery(spark, sf_dir):
    """Attribute keys of all events with counts and ranges, from the typed entries of their JSON."""
    own = A.table(spark, sf_dir, "events").select(F.explode(F.from_json("props", "map<string,bigint>")).alias("name", "value"))
    return own.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("SELECT http_route AS value, count(*) AS n FROM spans GROUP BY 1 ORDER BY n DESC, value LIMIT 500", A.SPANS)
def variable_options(spark, sf_dir):
    return A.spans(spark, sf_dir).groupBy(c("http_route").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(500)


@query("""SELECT 'kind' AS entry, count(*) FILTER (WHERE status = 'ERROR' AND coalesce(peer_service = 'ext9', FALSE)) AS without, count(*) FILTER (WHERE kind = 'CLIENT') AS alone FROM spans
UNION ALL SELECT 'status', count(*) FILTER (WHERE kind = 'CLIENT' AND coalesce(peer_service = 'ext9', FALSE)), count(*) FILTER (WHERE status = 'ERROR') FROM spans
UNION ALL SELECT 'peer', count(*) FILTER (WHERE kind = 'CLIENT' AND status = 'ERROR'), count(*) FILTER (WHERE peer_service = 'ext9') FROM spans""", A.SPANS)
def diagnosis_counts(spark, sf_dir):
    return I.diagnosis(A.spans(spark, sf_dir), {"kind": c("kind") == "CLIENT", "status": c("status") == "ERROR", "peer": c("peer_service") == "ext9"})


@query("SELECT http_route AS value, count(*) AS n, CAST(levenshtein(lower(http_route), '/r/199') AS INTEGER) AS distance FROM spans GROUP BY 1 ORDER BY distance, n DESC, value LIMIT 3", A.SPANS)
def diagnosis_nearest(spark, sf_dir):
    return I.nearest(A.spans(spark, sf_dir), "http_route", "/r/199")


@query("SELECT service, service_version, min(start_us) AS first_us, max(start_us) AS last_us, count(*) AS n FROM spans GROUP BY 1, 2", A.SPANS)
def resource_inventory(spark, sf_dir):
    return I.inventory(A.spans(spark, sf_dir), ["service", "service_version"], "start_us")


@query("SELECT event_type, count(*) AS n, min(value) AS lo FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09' GROUP BY 1 HAVING count(*) > 2 ORDER BY n DESC LIMIT 1000")
def sql_panel(spark, sf_dir):
    """An author's SQL with its window as named parameters; the session's parser and optimizer do the rest."""
    A.table(spark, sf_dir, "events").createOrReplaceTempView("panel_events")
    return spark.sql("SELECT event_type, count(*) AS n, min(value) AS lo FROM panel_events WHERE ts >= cast(:start AS timestamp_ntz) AND ts < cast(:end AS timestamp_ntz) GROUP BY 1 HAVING count(*) > 2 ORDER BY n DESC LIMIT 1000", args={"start": "2024-01-05", "end": "2024-01-09"})


@query("SELECT series, count(*) AS n, count(*) FILTER (WHERE d > 300000000) AS late, max(d) AS longest FROM (SELECT series, time_us - lag(time_us) OVER (PARTITION BY series ORDER BY time_us, event_id) AS d FROM first_points) WHERE d IS NOT NULL GROUP BY 1", A.POINTS)
def win_lag_delta(spark, sf_dir):
    w = Window.partitionBy("series").orderBy("time_us", "event_id")
    own = A.first_points(spark, sf_dir).withColumn("d", c("time_us") - F.lag("time_us").over(w)).where("d is not null")
    return own.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("d") > 300_000_000).alias("late"), F.max("d").alias("longest"))


@query("SELECT event_id, last_value(CASE WHEN status = 'ERROR' THEN event_id END IGNORE NULLS) OVER (PARTITION BY service ORDER BY start_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_error FROM spans", A.SPANS)
def win_carry_forward(spark, sf_dir):
    own = A.spans(spark, sf_dir).select("service", "start_us", "event_id", "status")
    return O.carried_forward(own, "service", ["start_us", "event_id"], F.when(c("status") == "ERROR", c("event_id")), F.floor(c("start_us") / 3_600_000_000), "last_error").select("event_id", "last_error")


@query("SELECT service, http_route, n FROM (SELECT service, http_route, count(*) AS n, dense_rank() OVER (PARTITION BY service ORDER BY count(*) DESC) AS r FROM spans GROUP BY 1, 2) WHERE r <= 3", A.SPANS)
def win_rank_cap(spark, sf_dir):
    own = A.spans(spark, sf_dir).groupBy("service", "http_route").agg(F.count(F.lit(1)).alias("n"))
    return own.withColumn("r", F.dense_rank().over(Window.partitionBy("service").orderBy(F.desc("n")))).where("r <= 3").drop("r")


@query("SELECT service, status, d, e FROM (SELECT service, status, first_value(event_id) OVER w AS d, nth_value(event_id, 2) OVER w AS e, row_number() OVER w AS r FROM spans WINDOW w AS (PARTITION BY service, status ORDER BY duration_ms DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE r = 1", A.SPANS)
def agg_top_two(spark, sf_dir):
    """The two slowest spans of each group: the first, then the first of the rest, by aggregates of fixed size."""
    own = A.spans(spark, sf_dir).select("service", "status", F.struct((-c("duration_ms")).alias("a"), "event_id").alias("x"))
    first = own.groupBy(c("service").alias("s"), c("status").alias("t")).agg(F.min("x").alias("first"))
    rest = own.join(F.broadcast(first), c("service").eqNullSafe(c("s")) & c("status").eqNullSafe(c("t")))
    top = rest.groupBy("service", "status").agg(F.min("first").alias("first"), F.count_if(c("x") == c("first")).alias("times"), F.min(F.when(c("x") > c("first"), c("x"))).alias("second"))
    return top.select("service", "status", c("first")["event_id"].alias("d"), F.when(c("times") > 1, c("first")["event_id"]).otherwise(c("second")["event_id"]).alias("e"))


MINUTES = """m AS (SELECT service, (dense_us // 60000000) * 60000 AS bucket_ms, count(*) AS spans, count(*) FILTER (WHERE kind NOT IN ('CLIENT', 'PRODUCER')) AS served_spans,
coalesce(quantile_cont(duration_ms, 0.5) FILTER (WHERE kind NOT IN ('CLIENT', 'PRODUCER')), quantile_cont(duration_ms, 0.5)) AS p50_ms, coalesce(quantile_cont(duration_ms, 0.95) FILTER (WHERE kind NOT IN ('CLIENT', 'PRODUCER')), quantile_cont(duration_ms, 0.95)) AS p95_ms, 100.0 * avg(CASE WHEN status = 'ERROR' THEN 1.0 ELSE 0.0 END) AS error_rate FROM spans GROUP BY 1, 2)"""


def minutes(spark, sf_dir):
    return R.service_rollup(A.spans(spark, sf_dir, "dense_us"), A.logs(spark, sf_dir, "dense_us"))


@query("""SELECT *, CASE WHEN error_rate >= 5 OR p95_ms >= 2000 THEN 'unhealthy' WHEN error_rate >= 1 OR p95_ms >= 750 THEN 'degraded' ELSE 'healthy' END AS grade FROM
(SELECT service, CAST(sum(spans) AS BIGINT) AS spans, round(sum(error_rate * spans) / sum(spans), 6) AS error_rate, round(sum(p50_ms * served_spans) FILTER (WHERE served_spans > 0) / sum(served_spans), 6) AS p50_ms, round(max(p95_ms) FILTER (WHERE served_spans > 0), 6) AS p95_ms FROM m GROUP BY 1)""", A.SPANS, MINUTES)
def health_overview(spark, sf_dir):
    return I.health(minutes(spark, sf_dir)).withColumns({x: F.round(x, 6) for x in ("error_rate", "p50_ms", "p95_ms")}).drop("namespace")


HALF = "bucket AS (SELECT service, start_us >= 1704067200000000 + 5 * 86400000000 AS cur, start_us // 86400000000 AS b, count(*) AS n, avg(CASE WHEN status = 'ERROR' THEN 1.0 ELSE 0.0 END) AS rate, quantile_cont(duration_ms, 0.95) AS p95 FROM spans WHERE start_us < 1704067200000000 + 10 * 86400000000 GROUP BY 1, 2, 3)"
FIVE = 5 * DAY_US
# Latency and volume by user: few spans a day, so their means and counts do move.
BY_USER = HALF.replace("SELECT service,", "SELECT split_part(trace_id, '-', 1) AS service,")


def by_user(spark, sf_dir):
    return A.spans(spark, sf_dir).withColumn("service", F.split_part("trace_id", F.lit("-"), F.lit(1)))


def z(df):
    return df.select("service", *(F.round(c(x) + 1e-9, 6).alias(x) for x in ("now", "base", "z")))  # means of hundredths end in halves of a millionth


def z_sql(value: str, floor: float, condition: str, mean: str = "avg({v}) FILTER (WHERE {w})") -> str:
    a, b = (mean.format(v=value, w=w) for w in ("cur", "NOT cur"))
    return f"SELECT service, round(now + 1e-9, 6) AS now, round(base + 1e-9, 6) AS base, round((now - base) / greatest(coalesce(sd, 0), {floor}) + 1e-9, 6) AS z FROM (SELECT service, coalesce({a}, 0) AS now, coalesce({b}, 0) AS base, stddev({value}) FILTER (WHERE NOT cur) AS sd FROM bucket GROUP BY 1) WHERE {condition.format(z=f'(now - base) / greatest(coalesce(sd, 0), {floor})')}"


@query(z_sql("rate", 0.01, "abs({z}) >= 0.1"), A.SPANS, HALF)
def anomaly_error(spark, sf_dir):
    return z(I.error_anomalies(A.spans(spark, sf_dir), A.ORIGIN_US, FIVE, 86_400, 0.1))


@query(z_sql("p95", 1.0, "{z} >= 0.01 AND now - base >= 5 AND now >= 1.2 * base", "sum({v} * n) FILTER (WHERE {w}) / sum(n) FILTER (WHERE {w})"), A.SPANS, BY_USER)
def anomaly_latency(spark, sf_dir):
    return z(I.latency_anomalies(by_user(spark, sf_dir), A.ORIGIN_US, FIVE, 86_400, 0.01))


@query(z_sql("n", 1.0, "abs({z}) >= 0.1 AND abs(now - base) >= 0.0 * base").replace("0.0 * base", "0.25 * base"), A.SPANS, BY_USER)
def anomaly_volume(spark, sf_dir):
    return z(I.volume_anomalies(by_user(spark, sf_dir), A.ORIGIN_US, FIVE, 86_400, 0.1))


@query("""SELECT service, min(s) AS start_us, max(e) AS end_us, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY service ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS nth FROM (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY service ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM (SELECT service, start_us AS s, start_us + 7200000000 AS e FROM spans WHERE status = 'ERROR'))) GROUP BY service, nth""".replace(", count(*) AS n", ""), A.SPANS)
def anomaly_episodes(spark, sf_dir):
    own = A.spans(spark, sf_dir).where("status = 'ERROR'").select("namespace", "service", F.lit("error").alias("kind"), "start_us", (c("start_us") + 7_200_000_000).alias("end_us"), c("operation").alias("title"))
    return I.merged_episodes(own).select("service", "start_us", "end_us")


@query(""", w AS (SELECT service, bucket_ms > last - 300000 AS cur, avg(error_rate) AS e, avg(p95_ms) AS p, avg(spans) AS n FROM m, (SELECT max(bucket_ms) AS last FROM m) WHERE bucket_ms > last - 600000 GROUP BY 1, 2)
SELECT a.service, round(a.e, 6) AS error_rate, round(a.p, 6) AS p95_ms, round(a.n, 6) AS spans, round(coalesce(100.0 * (a.e - b.e) / nullif(b.e, 0), 0), 6) AS error_rate_change, round(coalesce(100.0 * (a.p - b.p) / nullif(b.p, 0), 0), 6) AS p95_ms_change, round(coalesce(100.0 * (a.n - b.n) / nullif(b.n, 0), 0), 6) AS spans_change
FROM w a LEFT JOIN w b ON a.service = b.service AND NOT b.cur WHERE a.cur""", A.SPANS, MINUTES)
def alert_env(spark, sf_dir):
    own = I.alert_env(minutes(spark, sf_dir))
    return own.select("service", *(F.round(x, 6).alias(x) for x in own.columns[2:]))
