"""Measures and panels over spans and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkobs.operators import measures as M
from sparkobs.operators import predicates as P
from sparkobs.operators.quantiles import narrowed
from sparkobs.plans import panels as V
from sparkobs.queries.registry import query
from sparkobs.sources import adapters as A

DAY, HOUR = 86_400, 3600
c = F.col
r6 = lambda x: F.round(x, 6)
B = lambda seconds, t="start_us": f"CAST(floor({t} / {seconds * 1_000_000}) AS BIGINT) * {seconds * 1000}"
DAYS = B(DAY)
NAMED_ERROR = "round(100.0 * avg(CASE WHEN status = 'ERROR' THEN 1.0 ELSE 0.0 END), 6)"


@query(f"SELECT {B(60, 'dense_us')} AS bucket_ms, service, {NAMED_ERROR} AS error_rate FROM spans WHERE kind = 'SERVER' GROUP BY 1, 2", A.SPANS)
def ts_bucket(spark, sf_dir):
    return V.timeseries(P.where(A.spans(spark, sf_dir, "dense_us"), c("kind") == "SERVER"), "start_us", 60, {"error_rate": r6(M.error_rate())}, "service")


@query("SELECT service, CAST(count(*) AS DOUBLE) AS n FROM spans GROUP BY 1", A.SPANS)
def agg_count(spark, sf_dir):
    return A.spans(spark, sf_dir).groupBy("service").agg(M.count().alias("n"))


@query(f"SELECT {B(HOUR)} AS bucket_ms, round(count(*) / 3600.0, 9) AS rate FROM spans GROUP BY 1", A.SPANS)
def agg_rate(spark, sf_dir):
    return V.timeseries(A.spans(spark, sf_dir), "start_us", HOUR, {"rate": F.round(M.rate(HOUR), 9)})


@query(f"SELECT service, {NAMED_ERROR} AS error_rate FROM spans GROUP BY 1", A.SPANS)
def agg_error_rate(spark, sf_dir):
    return A.spans(spark, sf_dir).groupBy("service").agg(r6(M.error_rate()).alias("error_rate"))


@query(f"SELECT {B(DAY, 'time_us')} AS bucket_ms, round(100.0 * avg(CASE WHEN upper(severity) IN ('ERROR', 'FATAL', 'CRITICAL') THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM logs GROUP BY 1", A.LOGS)
def agg_log_error_rate(spark, sf_dir):
    return V.timeseries(A.logs(spark, sf_dir), "time_us", DAY, {"error_rate": r6(M.error_rate(M.log_error()))})


@query(f"SELECT bucket_ms, service, round(100.0 * n / sum(n) OVER (PARTITION BY bucket_ms), 6) AS share FROM (SELECT {DAYS} AS bucket_ms, service, CAST(count(*) AS DOUBLE) AS n FROM spans GROUP BY 1, 2)", A.SPANS)
def agg_share(spark, sf_dir):
    own = V.timeseries(A.spans(spark, sf_dir), "start_us", DAY, {"n": M.count()}, "service")
    return own.select("bucket_ms", "service", r6(M.share(c("n"), "bucket_ms")).alias("share"))


@query("SELECT service, min(duration_ms) AS lo, max(duration_ms) AS hi, round(avg(duration_ms), 6) AS mean, round(sum(duration_ms), 4) AS total FROM spans GROUP BY 1", A.SPANS)
def agg_min_max_avg_sum(spark, sf_dir):
    return A.spans(spark, sf_dir).groupBy("service").agg(F.min("duration_ms").alias("lo"), F.max("duration_ms").alias("hi"), r6(F.avg("duration_ms")).alias("mean"), F.round(F.sum("duration_ms"), 4).alias("total"))


@query("SELECT series, arg_max(value, {'t': time_us, 'i': ingested}) AS value FROM points GROUP BY 1", A.POINTS)
def agg_last(spark, sf_dir):
    return A.points(spark, sf_dir).groupBy("series").agg(M.last(c("value"), c("time_us"), c("ingested")).alias("value"))


@query("SELECT service, CAST(count(DISTINCT trace_id) AS DOUBLE) AS traces, CAST(count(DISTINCT operation) AS DOUBLE) AS operations FROM spans GROUP BY 1", A.SPANS)
def agg_count_distinct(spark, sf_dir):
    return A.spans(spark, sf_dir).groupBy("service").agg(F.countDistinct("trace_id").cast("double").alias("traces"), F.countDistinct("operation").cast("double").alias("operations"))


FIVE = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query("SELECT service, " + ", ".join(f"round(quantile_cont(duration_ms, {q}), 6) AS {n}" for n, q in FIVE.items()) + " FROM spans GROUP BY 1", A.SPANS)
def agg_quantiles_narrowed(spark, sf_dir):
    """Exact quantiles of whole services: no task holds a service's values."""
    return narrowed(A.spans(spark, sf_dir), ["service"], "duration_ms", FIVE).withColumns({k: r6(k) for k in FIVE})


@query("SELECT service, " + ", ".join(f"round(quantile_cont(duration_ms, {q}), 6) AS p{n}" for n, q in ((50, 0.5), (75, 0.75), (90, 0.9), (95, 0.95), (99, 0.99))) + " FROM spans GROUP BY 1", A.SPANS)
def agg_quantiles(spark, sf_dir):
    return A.spans(spark, sf_dir).groupBy("service").agg(*(r6(M.quantile(c("duration_ms"), q)).alias(f"p{n}") for n, q in ((50, 0.5), (75, 0.75), (90, 0.9), (95, 0.95), (99, 0.99))))


@query("SELECT operation, round(100.0 * count(*) FILTER (WHERE status_code = 500) / nullif(count(*) FILTER (WHERE status_code IS NOT NULL), 0), 6) AS failed, CAST(count(*) FILTER (WHERE kind = 'SERVER') AS DOUBLE) AS served FROM spans GROUP BY 1", A.SPANS)
def agg_count_if_ratio(spark, sf_dir):
    own = F.lit(100.0) * M.ratio(M.count_if(c("status_code") == 500), M.count_if(c("status_code").isNotNull()))
    return A.spans(spark, sf_dir).groupBy("operation").agg(r6(own).alias("failed"), M.count_if(c("kind") == "SERVER").alias("served"))


@query("SELECT service, round((count(*) FILTER (WHERE duration_ms <= 20) + count(*) FILTER (WHERE duration_ms > 20 AND duration_ms <= 80) / 2) / nullif(count(duration_ms), 0), 6) AS apdex FROM spans GROUP BY 1", A.SPANS)
def agg_apdex(spark, sf_dir):
    return A.spans(spark, sf_dir).groupBy("service").agg(r6(M.apdex(c("duration_ms"), 20)).alias("apdex"))


@query(f"SELECT {DAYS} AS bucket_ms, grouping({DAYS}) AS total, CAST(count(*) AS DOUBLE) AS n, round(quantile_cont(duration_ms, 0.95), 6) AS p95 FROM spans GROUP BY GROUPING SETS (({DAYS}), ())", A.SPANS)
def stat_totals(spark, sf_dir):
    return V.stat(A.spans(spark, sf_dir), "start_us", DAY, {"n": M.count(), "p95": r6(M.quantile(c("duration_ms"), 0.95))})


@query("SELECT service, kind, status, grouping(service) * 4 + grouping(kind) * 2 + grouping(status) AS level, count(*) AS n FROM spans GROUP BY CUBE (service, kind, status)", A.SPANS)
def agg_grouping_sets(spark, sf_dir):
    return A.spans(spark, sf_dir).cube("service", "kind", "status").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"))


@query(f"""best AS (SELECT operation FROM spans GROUP BY 1 ORDER BY count(*) DESC, operation LIMIT 6)
SELECT {DAYS} AS bucket_ms, coalesce(b.operation, 'Other (' || ((SELECT count(DISTINCT operation) FROM spans) - 6) || ')') AS operation, round(quantile_cont(duration_ms, 0.9), 6) AS p90
FROM spans s LEFT JOIN best b ON s.operation = b.operation GROUP BY 1, 2""".replace("best AS", ", best AS", 1), A.SPANS)
def ts_topn_fold(spark, sf_dir):
    own = V.folded(A.spans(spark, sf_dir), "operation", [F.desc("n"), F.asc("operation")], 6, n=F.count(F.lit(1)))
    return V.timeseries(own, "start_us", DAY, {"p90": r6(M.quantile(c("duration_ms"), 0.9))}, "operation")


@query(f"""best AS (SELECT coalesce(peer_service, '') AS d FROM spans GROUP BY 1 ORDER BY count(*) DESC, d LIMIT 3)
SELECT {DAYS} AS bucket_ms, coalesce(b.d, 'Other (' || ((SELECT count(DISTINCT coalesce(peer_service, '')) FROM spans) - 3) || ')') AS peer_service, {NAMED_ERROR} AS error_rate
FROM spans s LEFT JOIN best b ON coalesce(s.peer_service, '') = b.d GROUP BY 1, 2""".replace("best AS", ", best AS", 1), A.SPANS)
def ts_fold_nulls(spark, sf_dir):
    """Null is one of the shown values, as the empty text."""
    own = V.folded(A.spans(spark, sf_dir), "peer_service", [F.desc("n"), F.asc("peer_service")], 3, n=F.count(F.lit(1)))
    return V.timeseries(own, "start_us", DAY, {"error_rate": r6(M.error_rate())}, "peer_service")


@query("""best AS (SELECT coalesce(CAST(status_code AS VARCHAR), '') AS d FROM spans GROUP BY 1 ORDER BY avg(duration_ms) DESC, d LIMIT 1)
SELECT service, coalesce(b.d, 'Other (' || ((SELECT count(DISTINCT coalesce(CAST(status_code AS VARCHAR), '')) FROM spans) - 1) || ')') AS status_code, CAST(count(*) AS DOUBLE) AS n
FROM spans s LEFT JOIN best b ON coalesce(CAST(s.status_code AS VARCHAR), '') = b.d GROUP BY 1, 2""".replace("best AS", ", best AS", 1), A.SPANS)
def bar_fold_nulls(spark, sf_dir):
    own = V.folded(A.spans(spark, sf_dir), "status_code", [F.desc("weight"), F.asc("status_code")], 1, weight=F.avg("duration_ms"))
    return own.groupBy("service", "status_code").agg(M.count().alias("n"))


WILSON = "greatest(0.0, (p + 3.8416 / (2 * n) {s} 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n))"


@query(f"SELECT http_route, n, round({WILSON.format(s='-')}, 6) AS lower_bound, round(least(1.0, {WILSON.format(s='+')}), 6) AS upper_bound FROM (SELECT http_route, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE status = 'ERROR') / CAST(count(*) AS DOUBLE) AS p FROM spans GROUP BY 1) ORDER BY n >= 20 DESC, lower_bound DESC, n DESC, http_route LIMIT 10", A.SPANS)
def ts_wilson_rank(spark, sf_dir):
    own = A.spans(spark, sf_dir).groupBy("http_route").agg(M.count().alias("n"), M.count_if(M.is_error()).alias("bad"))
    own = own.select("http_route", "n", r6(M.wilson(c("bad"), c("n"))).alias("lower_bound"), r6(M.wilson(c("bad"), c("n"), True)).alias("upper_bound"))
    return own.orderBy(F.desc(c("n") >= M.FLOOR), F.desc("lower_bound"), F.desc("n"), "http_route").limit(10)


@query("""best AS (SELECT operation FROM spans GROUP BY 1 ORDER BY sum(k) DESC, operation LIMIT 3)
SELECT service, coalesce(b.operation, 'Other (' || ((SELECT count(DISTINCT operation) FROM spans) - 3) || ')') AS operation, CAST(count(*) AS DOUBLE) AS n
FROM spans s LEFT JOIN best b ON s.operation = b.operation GROUP BY 1, 2""".replace("best AS", ", best AS", 1), A.SPANS)
def bar_two_dims(spark, sf_dir):
    own = V.folded(A.spans(spark, sf_dir), "operation", [F.desc("weight"), F.asc("operation")], 3, weight=F.sum("k"))
    return own.groupBy("service", "operation").agg(M.count().alias("n"))


TABLE = "SELECT service, kind, coalesce(peer_service, '') AS peer_service, CAST(count(*) AS DOUBLE) AS n, round(max(duration_ms), 6) AS slowest FROM spans GROUP BY 1, 2, 3 ORDER BY n DESC, service, kind, peer_service LIMIT 12"


def shown(spark, sf_dir):
    return V.table(A.spans(spark, sf_dir), ["service", "kind", "peer_service"], {"n": M.count(), "slowest": r6(F.max("duration_ms"))}, [F.desc("n"), "service", "kind", "peer_service"], 12)


@query(TABLE, A.SPANS)
def table_three_dims(spark, sf_dir):
    return shown(spark, sf_dir)


@query(f", shown AS ({TABLE}) SELECT s.service, s.kind, coalesce(s.peer_service, '') AS peer_service, {DAYS} AS bucket_ms, CAST(count(*) AS DOUBLE) AS n FROM spans s SEMI JOIN shown t ON s.service = t.service AND s.kind = t.kind AND coalesce(s.peer_service, '') = t.peer_service GROUP BY 1, 2, 3, 4", A.SPANS)
def table_trends(spark, sf_dir):
    return V.table_trends(A.spans(spark, sf_dir), "start_us", DAY, ["service", "kind", "peer_service"], {"n": M.count()}, shown(spark, sf_dir))


WEEK = 7 * DAY * 1_000_000


@query(f"SELECT CASE WHEN start_us >= 1704067200000000 + {2 * WEEK} THEN 'current' ELSE 'previous' END AS period, service, CAST(count(*) AS DOUBLE) AS n, {NAMED_ERROR} AS error_rate FROM spans WHERE start_us >= 1704067200000000 + {WEEK} AND start_us < 1704067200000000 + {3 * WEEK} GROUP BY 1, 2", A.SPANS)
def compare_previous(spark, sf_dir):
    own, start = A.spans(spark, sf_dir), A.ORIGIN_US + 2 * WEEK
    halves = [("current", start), ("previous", start - WEEK)]
    parts = [P.where(own, P.window(c("start_us"), at, at + WEEK)).groupBy("service").agg(M.count().alias("n"), r6(M.error_rate()).alias("error_rate")).withColumn("period", F.lit(name)) for name, at in halves]
    return parts[0].unionByName(parts[1])


LOG2 = "CASE WHEN duration_ms < 1 THEN 0.0 ELSE pow(2.0, least(32.0, floor(log2(duration_ms)))) END"


@query(f"SELECT {LOG2} AS lo, count(*) AS n FROM spans GROUP BY 1", A.SPANS)
def dist_log2_histogram(spark, sf_dir):
    return V.histogram(A.spans(spark, sf_dir), "duration_ms")


@query(f"SELECT {B(6 * HOUR)} AS bucket_ms, {LOG2} AS lo, count(*) AS n FROM spans GROUP BY 1, 2", A.SPANS)
def dist_heatmap(spark, sf_dir):
    return V.heatmap(A.spans(spark, sf_dir), "start_us", 6 * HOUR, "duration_ms")


@query(f"SELECT operation, service, round(quantile_cont(duration_ms, 0.5), 6) AS p50, {NAMED_ERROR} AS error_rate FROM spans GROUP BY 1, 2", A.SPANS)
def scatter_items(spark, sf_dir):
    return A.spans(spark, sf_dir).groupBy("operation", "service").agg(r6(M.quantile(c("duration_ms"), 0.5)).alias("p50"), r6(M.error_rate()).alias("error_rate"))


@query(f", best AS (SELECT http_route FROM spans GROUP BY 1 ORDER BY count(*) DESC, http_route LIMIT 5) SELECT {DAYS} AS bucket_ms, http_route, {NAMED_ERROR} AS error_rate FROM spans WHERE http_route IN (SELECT http_route FROM best) GROUP BY 1, 2", A.SPANS)
def state_timeline(spark, sf_dir):
    return V.state_timeline(A.spans(spark, sf_dir), "start_us", DAY, "http_route", {"error_rate": r6(M.error_rate())}, 5)


@query("SELECT service, period, CAST(count(*) AS DOUBLE) AS n, round(quantile_cont(duration_ms, 0.95), 6) AS p95 FROM (SELECT *, CASE WHEN start_us < max(first_us) OVER (PARTITION BY service) THEN 'before' ELSE 'since' END AS period FROM (SELECT *, min(start_us) OVER (PARTITION BY service, service_version) AS first_us FROM spans)) GROUP BY 1, 2", A.SPANS)
def bar_deploy_split(spark, sf_dir):
    """Before and since each service's latest deploy: the versions' first times are a small table joined back."""
    own = A.spans(spark, sf_dir)
    deploys = own.groupBy("service", "service_version").agg(F.min("start_us").alias("first_us")).groupBy("service").agg(F.max("first_us").alias("deploy_us"))
    split = own.join(deploys, "service").withColumn("period", F.when(c("start_us") < c("deploy_us"), "before").otherwise("since"))
    return split.groupBy("service", "period").agg(M.count().alias("n"), r6(M.quantile(c("duration_ms"), 0.95)).alias("p95"))
