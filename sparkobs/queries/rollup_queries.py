"""Rollups, edges and the service graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkobs.operators import graph as G
from sparkobs.operators import rollups as R
from sparkobs.queries.registry import query
from sparkobs.sources import adapters as A

c = F.col
DAY = 86_400
MIN = "(dense_us // 60000000) * 60000"
DAYS = "(start_us // 86400000000) * 86400000"
ERR = "100.0 * avg(CASE WHEN status = 'ERROR' THEN 1.0 ELSE 0.0 END)"
SERVED = "kind NOT IN ('CLIENT', 'PRODUCER')"


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f"""SELECT 'shop' AS namespace, bucket_ms, service, coalesce(spans, 0) AS spans, coalesce(served_spans, 0) AS served_spans, p50_ms, p95_ms, error_rate, coalesce(log_count, 0) AS log_count FROM
(SELECT {MIN} AS bucket_ms, service, count(*) AS spans, count(*) FILTER (WHERE {SERVED}) AS served_spans, round(coalesce(quantile_cont(duration_ms, 0.5) FILTER (WHERE {SERVED}), quantile_cont(duration_ms, 0.5)), 6) AS p50_ms, round(coalesce(quantile_cont(duration_ms, 0.95) FILTER (WHERE {SERVED}), quantile_cont(duration_ms, 0.95)), 6) AS p95_ms, round({ERR}, 6) AS error_rate FROM spans GROUP BY 1, 2)
FULL JOIN (SELECT {MIN} AS bucket_ms, service, count(*) AS log_count FROM logs GROUP BY 1, 2) USING (bucket_ms, service)""", A.SPANS, A.LOGS)
def rollup_service(spark, sf_dir):
    return rounded(R.service_rollup(A.spans(spark, sf_dir, "dense_us"), A.logs(spark, sf_dir, "dense_us")), "p50_ms", "p95_ms", "error_rate")


BIN = "CASE WHEN duration_ms > 0 THEN CAST(ceil(log2(duration_ms) * 8) AS INTEGER) ELSE -2147483648 END"


@query(f"SELECT {DAYS} AS bucket_ms, service, kind, status, bin, count(*) AS n FROM (SELECT *, {BIN} AS bin FROM spans) GROUP BY 1, 2, 3, 4, 5", A.SPANS)
def rollup_span_hist(spark, sf_dir):
    own = R.span_rollup(A.spans(spark, sf_dir), seconds=DAY)
    return own.select("bucket_ms", "service", "kind", "status", F.explode("hist").alias("bin", "n"))


@query(f"""h AS (SELECT service, {BIN} AS bin, count(*) AS m FROM spans GROUP BY 1, 2), q AS (SELECT *, sum(m) OVER (PARTITION BY service ORDER BY bin) AS cum, sum(m) OVER (PARTITION BY service) AS total FROM h)
SELECT service, round(CASE WHEN bin = -2147483648 THEN 0.0 ELSE pow(2.0, (bin - 1) / 8.0) + greatest(0.0, least(1.0, (total * 0.95 - (cum - m)) / m)) * (pow(2.0, bin / 8.0) - pow(2.0, (bin - 1) / 8.0)) END, 6) AS value
FROM q WHERE cum >= total * 0.95 QUALIFY row_number() OVER (PARTITION BY service ORDER BY bin) = 1""".replace("h AS", ", h AS", 1), A.SPANS)
def rollup_quantile(spark, sf_dir):
    return rounded(R.hist_quantile(R.span_rollup(A.spans(spark, sf_dir), seconds=DAY), 0.95, "service"), "value")


@query("SELECT namespace, (dense_us // 60000000) * 60000 AS bucket_ms, service, severity, count(*) AS logs FROM logs GROUP BY 1, 2, 3, 4", A.LOGS)
def rollup_log(spark, sf_dir):
    return R.log_rollup(A.logs(spark, sf_dir, "dense_us"))


@query(f""", e AS (SELECT {DAYS} AS bucket_ms, service, http_route, count(*) AS n, sum(duration_ms) AS total, max(duration_ms) AS hi FROM spans GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket_ms, service ORDER BY n DESC, http_route) > 8 AS overflow FROM e)
SELECT 'shop' AS namespace, bucket_ms, service, CASE WHEN overflow THEN '' ELSE http_route END AS route, overflow, CAST(sum(n) AS BIGINT) AS spans, round(sum(total), 4) AS duration_sum, max(hi) AS duration_max FROM r GROUP BY ALL""", A.SPANS)
def rollup_endpoint(spark, sf_dir):
    return rounded(R.endpoint_rollup(A.spans(spark, sf_dir), routes=8, seconds=DAY), "duration_sum", digits=4)


CALLS = "FROM spans ch JOIN spans pa ON ch.namespace = pa.namespace AND ch.trace_id = pa.trace_id AND ch.parent_span_id = pa.span_id AND ch.service <> pa.service"


@query(f"SELECT ch.namespace, (ch.start_us // 86400000000) * 86400000 AS bucket_ms, pa.service AS caller, ch.service AS callee, count(*) AS calls, round(avg(ch.duration_ms), 6) AS avg_ms, round(100.0 * avg(CASE WHEN ch.status = 'ERROR' THEN 1.0 ELSE 0.0 END), 6) AS error_rate {CALLS} GROUP BY 1, 2, 3, 4", A.SPANS)
def rollup_edge_call(spark, sf_dir):
    return rounded(G.call_edges(A.spans(spark, sf_dir), DAY), "avg_ms", "error_rate")


@query(f"""SELECT namespace, bucket_ms, caller, callee, CAST(sum(calls) AS BIGINT) AS calls FROM
(SELECT DISTINCT namespace, {DAYS} AS bucket_ms, messaging_destination AS d, messaging_system AS m, service AS caller FROM spans WHERE kind = 'PRODUCER') JOIN
(SELECT namespace, {DAYS} AS bucket_ms, messaging_destination AS d, messaging_system AS m, service AS callee, count(*) AS calls FROM spans WHERE kind = 'CONSUMER' GROUP BY ALL) USING (namespace, bucket_ms, d, m) WHERE caller <> callee GROUP BY 1, 2, 3, 4""", A.SPANS)
def rollup_edge_messaging(spark, sf_dir):
    return G.messaging_edges(A.spans(spark, sf_dir), DAY)


PEERS = "FROM spans s WHERE kind = 'CLIENT' AND peer_service <> service AND NOT EXISTS (SELECT 1 FROM spans ch WHERE ch.namespace = s.namespace AND ch.trace_id = s.trace_id AND ch.parent_span_id = s.span_id AND ch.service <> s.service)"


@query(f"SELECT namespace, {DAYS} AS bucket_ms, service AS caller, peer_service AS callee, count(*) AS calls, round({ERR}, 6) AS error_rate, round(quantile_cont(duration_ms, 0.5), 6) AS p50_ms, round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms {PEERS} GROUP BY 1, 2, 3, 4", A.SPANS)
def rollup_edge_peer(spark, sf_dir):
    return rounded(G.peer_edges(A.spans(spark, sf_dir), DAY), "error_rate", "p50_ms", "p95_ms")


@query("SELECT namespace, service, service_version, first_us AS deploy_us FROM (SELECT namespace, service, service_version, min(start_us) AS first_us, row_number() OVER (PARTITION BY namespace, service ORDER BY min(start_us), service_version) AS nth FROM spans GROUP BY 1, 2, 3) WHERE nth > 1", A.SPANS)
def rollup_version_deploys(spark, sf_dir):
    return R.deploys(R.version_rollup(A.spans(spark, sf_dir)))


@query("SELECT namespace, trace_id, min(start_us) AS first_us, max(start_us + CAST(trunc(duration_ms * 1000) AS BIGINT)) AS last_us, bool_or(status = 'ERROR') AS failed, count(*) AS spans FROM spans GROUP BY 1, 2", A.SPANS)
def rollup_trace_candidates(spark, sf_dir):
    return R.trace_candidates(A.spans(spark, sf_dir))


@query(f"""SELECT service AS name, FALSE AS external, count(*) AS spans, round({ERR}, 6) AS error_rate FROM spans GROUP BY 1
UNION ALL SELECT DISTINCT peer_service, TRUE, 0, 0.0 {PEERS} AND peer_service NOT IN (SELECT service FROM spans)""", A.SPANS)
def topology(spark, sf_dir):
    nodes, _ = G.topology(A.spans(spark, sf_dir))
    return rounded(nodes.select("name", "external", "spans", "error_rate"), "error_rate")


@query(f"""SELECT pa.service AS caller, ch.service AS callee, count(*) AS calls {CALLS} GROUP BY 1, 2
UNION ALL SELECT service, peer_service, count(*) {PEERS} AND peer_service NOT IN (SELECT service FROM spans) GROUP BY 1, 2""", A.SPANS)
def topology_edges(spark, sf_dir):
    return G.topology(A.spans(spark, sf_dir))[1].select("caller", "callee", "calls")


#: Every order is a call between two of 200 services; a service calls two others.
HOPS = "SELECT DISTINCT 'o' || (o_custkey % 200) AS caller, 'o' || ((o_custkey % 200 * 2 + o_orderkey % 2) % 200) AS callee FROM orders"


@query(f"RECURSIVE e AS ({HOPS}), r(name, hops) AS (SELECT 'o7', 0 UNION SELECT e.callee, r.hops + 1 FROM r JOIN e ON e.caller = r.name WHERE r.hops < 8) SELECT name, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY 1".replace("RECURSIVE", "WITH RECURSIVE", 1))
def dependencies_bfs(spark, sf_dir):
    own, named = A.table(spark, sf_dir, "orders"), lambda n: F.concat(F.lit("o"), n.cast("string"))
    caller = c("o_custkey") % 200
    edges = own.select(F.lit("shop").alias("namespace"), named(caller).alias("caller"), named((caller * 2 + c("o_orderkey") % 2) % 200).alias("callee"))
    return G.dependencies(edges, "shop", "o7", nodes=500)
