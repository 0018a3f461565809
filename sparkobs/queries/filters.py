"""Filters over spans and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkobs.operators import predicates as P
from sparkobs.queries.registry import query
from sparkobs.sources import adapters as A


def register(name: str, signal: str, entry, condition: str) -> None:
    """A query that counts the rows of ``signal`` by service under a filter."""

    def run(spark, sf_dir):
        df = (A.spans if signal == "spans" else A.logs)(spark, sf_dir)
        own = entry()
        return P.where(df, *(own if isinstance(own, tuple) else (own,))).groupBy("service").agg(F.count(F.lit(1)).alias("n"))

    query(f"SELECT service, count(*) AS n FROM {signal} WHERE {condition} GROUP BY service", A.SPANS if signal == "spans" else A.LOGS, name=name)(run)


c = F.col
register("filter_eq", "spans", lambda: c("status") == "ERROR", "status = 'ERROR'")
register("filter_neq_null", "spans", lambda: c("status_code") != 500, "status_code <> 500")
register("filter_negated_null_inclusive", "spans", lambda: P.negated(c("status_code") == 500), "NOT coalesce(status_code = 500, FALSE)")
register("filter_compare", "spans", lambda: (c("duration_ms") >= 50) & (c("duration_ms") < 200), "duration_ms >= 50 AND duration_ms < 200")
register("filter_contains_ci", "logs", lambda: P.contains(c("body"), "USER 1"), "contains(lower(body), 'user 1')")
register("filter_not_contains", "spans", lambda: P.lacks(c("peer_service"), "EXT1"), "NOT coalesce(contains(lower(peer_service), 'ext1'), FALSE)")
register("filter_in", "spans", lambda: P.one_of(c("kind"), ["SERVER", "CLIENT"]), "kind IN ('SERVER', 'CLIENT')")
register("filter_not_in", "spans", lambda: ~c("peer_service").isin("ext1", "ext2"), "peer_service NOT IN ('ext1', 'ext2')")
register("filter_between", "spans", lambda: c("duration_ms").between(10, 20), "duration_ms BETWEEN 10 AND 20")
register("filter_not_between", "spans", lambda: ~c("status_code").between(300, 599), "status_code NOT BETWEEN 300 AND 599")
register("filter_like_ilike", "spans", lambda: c("operation").like("op_") & c("http_route").ilike("/R/1%") & ~c("service").like("v%"), "operation LIKE 'op_' AND http_route ILIKE '/R/1%' AND service NOT LIKE 'v%'")
register("filter_exists", "spans", lambda: (P.exists(c("messaging_system")), P.negated(P.exists(c("peer_service")))), "messaging_system IS NOT NULL AND peer_service IS NULL")
register("filter_or_group", "spans", lambda: (P.either(c("kind") == "SERVER", c("duration_ms") > 300), P.negated(P.either(c("status") == "OK", c("peer_service") == "ext1"))), "(kind = 'SERVER' OR duration_ms > 300) AND NOT coalesce(status = 'OK' OR peer_service = 'ext1', FALSE)")
register("filter_severity_range", "logs", lambda: P.severity(c("severity"), ">=", "WARN"), "severity IN ('WARN', 'ERROR', 'FATAL')")
register("filter_functions", "logs", lambda: F.upper("service").startswith("P") & (F.length("body") > 20) & c("body").rlike("user [0-9]{2} ") & F.lower("severity").contains("warn"), "starts_with(upper(service), 'P') AND length(body) > 20 AND regexp_matches(body, 'user [0-9]{2} ') AND contains(lower(severity), 'warn')")
register("filter_variable_all", "spans", lambda: (P.variable(lambda v: c("kind") == v, P.ALL), P.variable(lambda v: c("status") == v, "OK")), "status = 'OK'")
register("filter_variable_empty", "spans", lambda: P.variable(lambda v: c("kind").isin(v), []), "FALSE")
register("filter_try_cast", "spans", lambda: F.expr("try_cast(replace(operation, 'op', '') as int)") >= 7, "try_cast(replace(operation, 'op', '') AS INTEGER) >= 7")
register("filter_window", "spans", lambda: P.window(c("start_us"), A.ORIGIN_US + 5 * 86_400_000_000, A.ORIGIN_US + 9 * 86_400_000_000), "start_us >= 1704067200000000 + 5 * 86400000000 AND start_us < 1704067200000000 + 9 * 86400000000")
