"""Metric points by kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkobs.operators import assembly as B
from sparkobs.operators import metrics as K
from sparkobs.queries.registry import query
from sparkobs.sources import adapters as A

c = F.col
r6 = lambda x: F.round(x, 6)
MIN = 60
DEDUP = ", dd AS (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY series, time_us ORDER BY ingested DESC, value DESC) = 1)"
INC = """, lagged AS (SELECT *, lag(time_us) OVER w AS p_time, lag(value) OVER w AS p_value, lag(start_us) OVER w AS p_start FROM counters WINDOW w AS (PARTITION BY series ORDER BY time_us, ingested)),
inc AS (SELECT series, time_us, coalesce(start_us <> p_start, FALSE) OR value < p_value AS reset, CASE WHEN coalesce(start_us <> p_start, FALSE) OR value < p_value THEN value ELSE value - p_value END AS inc, p_time AS from_us,
  CASE WHEN time_us > p_time THEN time_us - p_time END AS elapsed_us FROM lagged WHERE p_time IS NOT NULL)"""
SPREAD = INC + """, cells AS (SELECT *, elapsed_us IS NOT NULL AND elapsed_us <= 600000000 AS fits FROM inc),
parts AS (SELECT series, i * 60000 AS bucket_ms, CASE WHEN fits THEN inc * (least(time_us, (i + 1) * 60000000) - greatest(from_us, i * 60000000)) / CAST(elapsed_us AS DOUBLE) ELSE CAST(inc AS DOUBLE) END AS part,
  CASE WHEN fits THEN least(time_us, (i + 1) * 60000000) - greatest(from_us, i * 60000000) ELSE elapsed_us END AS covered_us
  FROM (SELECT *, unnest(range(CASE WHEN fits THEN from_us // 60000000 ELSE time_us // 60000000 END, CASE WHEN fits THEN (time_us - 1) // 60000000 ELSE time_us // 60000000 END + 1)) AS i FROM cells))"""


@query(f"{DEDUP} SELECT series, count(*) AS n, round(sum(value), 4) AS total FROM dd GROUP BY 1", A.POINTS)
def metric_dedup(spark, sf_dir):
    return K.deduped(A.points(spark, sf_dir)).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"{DEDUP} SELECT bucket_ms, round(avg(m), 6) AS value FROM (SELECT (time_us // 60000000) * 60000 AS bucket_ms, series, avg(value) AS m FROM dd GROUP BY 1, 2) GROUP BY 1", A.POINTS)
def metric_gauge_avg(spark, sf_dir):
    own = K.carried(K.deduped(A.points(spark, sf_dir)), MIN).where("is_carried = 0")
    return own.groupBy("bucket_ms").agg(r6(F.avg("mean")).alias("value"))


@query(f"{INC} SELECT series, CAST(sum(inc) AS BIGINT) AS total, count(*) FILTER (WHERE reset) AS resets, count(*) FILTER (WHERE elapsed_us > 600000000) AS gaps FROM inc GROUP BY 1", A.COUNTERS)
def metric_counter_increase(spark, sf_dir):
    own = K.increases(A.counters(spark, sf_dir))
    return own.groupBy("series").agg(F.sum("inc").alias("total"), F.count_if("reset").alias("resets"), F.count_if(c("elapsed_us") > K.LOOKBACK_US).alias("gaps"))


@query(f"{SPREAD} SELECT bucket_ms, round(sum(part), 4) AS total FROM parts GROUP BY 1", A.COUNTERS)
def metric_rate_spread(spark, sf_dir):
    return K.spread(K.increases(A.counters(spark, sf_dir)), MIN).groupBy("bucket_ms").agg(F.round(F.sum("part"), 4).alias("total"))


@query(f"{SPREAD}, rates AS (SELECT series, bucket_ms, sum(part) / (sum(covered_us) / 1e6) AS rate FROM parts WHERE covered_us > 0 GROUP BY 1, 2) SELECT bucket_ms, round(sum(rate), 5) AS rate, count(*) AS series FROM rates GROUP BY 1", A.COUNTERS)
def metric_counter_rate(spark, sf_dir):
    own = K.rates(K.spread(K.increases(A.counters(spark, sf_dir)), MIN))
    return own.groupBy("bucket_ms").agg(F.round(F.sum("rate"), 5).alias("rate"), F.count(F.lit(1)).alias("series"))


@query("""deltas AS (SELECT series, time_us, ingested, value, lag(time_us) OVER (PARTITION BY series ORDER BY time_us, ingested) AS start_us FROM first_points)
SELECT series, round(sum(value), 4) AS total, count(*) FILTER (WHERE start_us < time_us) AS timed FROM deltas GROUP BY 1""".replace("deltas AS", ", deltas AS", 1), A.POINTS)
def metric_delta_sum(spark, sf_dir):
    own = A.first_points(spark, sf_dir)
    own = own.withColumn("start_us", F.lag("time_us").over(K.Window.partitionBy("series").orderBy("time_us", "ingested")))
    return K.increases(own, cumulative=False).groupBy("series").agg(F.round(F.sum("inc"), 4).alias("total"), F.count("elapsed_us").alias("timed"))


@query(f"""{DEDUP}, ends AS (SELECT e FROM range(1704067260000000, 1704067200000000 + 86400000000 + 1, 60000000) t(e)),
s AS (SELECT DISTINCT series FROM dd), grid AS (SELECT series, e FROM s, ends)
SELECT g.e // 1000 - 60000 AS bucket_ms, count(*) AS series, round(sum(p.value), 4) AS total FROM grid g ASOF JOIN dd p ON g.series = p.series AND g.e > p.time_us WHERE p.time_us >= g.e - 300000000 GROUP BY 1""", A.POINTS)
def metric_last_asof(spark, sf_dir):
    points = A.points(spark, sf_dir)
    low, high = points.agg(F.min("time_us"), F.max("time_us")).first()
    start, end = (A.ORIGIN_US, A.ORIGIN_US) if low is None else (low, high + K.STALE_US)  # no end past that has a value
    own = K.last_at(K.deduped(points), MIN, start, end)
    return own.groupBy("bucket_ms").agg(F.count(F.lit(1)).alias("series"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""{DEDUP}, m AS (SELECT series, time_us // 60000000 AS i, avg(value) AS mean, arg_max(value, {{'t': time_us, 'g': ingested}}) AS v, max(time_us) AS t FROM dd GROUP BY 1, 2),
n AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY series ORDER BY i), 1099511627776) AS nx FROM m),
f AS (SELECT series, i, mean, 0 AS is_carried FROM n UNION ALL SELECT series, unnest(range(i + 1, least(nx - 1, (t + 300000000) // 60000000) + 1)), v, 1 FROM n)
SELECT i * 60000 AS bucket_ms, round(sum(mean), 4) AS total, CAST(sum(is_carried) AS BIGINT) AS carried FROM f GROUP BY 1""", A.POINTS)
def metric_gauge_carry(spark, sf_dir):
    own = K.carried(K.deduped(A.points(spark, sf_dir)), MIN)
    return own.groupBy("bucket_ms").agg(F.round(F.sum("mean"), 4).alias("total"), F.sum("is_carried").alias("carried"))


@query(", dd AS (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY series, time_us ORDER BY ingested DESC, value DESC) = 1) SELECT (time_us // 600000000) * 600000 AS bucket_ms, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS lo, max(value) AS hi FROM dd GROUP BY 1", A.POINTS)
def metric_gauge_quantile(spark, sf_dir):
    own = K.deduped(A.points(spark, sf_dir))
    return own.groupBy((F.floor(c("time_us") / 600_000_000) * 600_000).cast("long").alias("bucket_ms")).agg(r6(F.percentile("value", F.lit(0.95))).alias("p95"), F.min("value").alias("lo"), F.max("value").alias("hi"))


#: Independent of the cumulative form: a point's gain is its own value's bucket; bounds narrow at the hundredth point.
GAINS = """, g AS (SELECT n.series, n.time_us, n.nth, e.value AS v FROM nth_points n JOIN events e USING (event_id)),
w AS (SELECT (time_us // 3600000000) * 3600000 AS bucket_ms, CASE WHEN v <= 10 THEN 10.0 WHEN v <= 25 AND nth < 100 THEN 25.0 WHEN v <= 50 THEN 50.0 WHEN v <= 100 THEN 100.0 WHEN v <= 250 THEN 250.0 END AS hi, count(*) AS n FROM g WHERE nth > 0 GROUP BY 1, 2)"""


@query(f"{GAINS} SELECT bucket_ms, coalesce(hi, -1) AS hi, CAST(sum(n) AS BIGINT) AS n FROM w WHERE n > 0 GROUP BY 1, 2", A.COUNTERS)
def metric_hist_buckets(spark, sf_dir):
    own = hourly(spark, sf_dir)
    return K.bucket_weights(own, "bucket_ms").where("n > 0").select("bucket_ms", F.coalesce("hi", F.lit(-1.0)).alias("hi"), "n")


def hourly(spark, sf_dir):
    return K.histogram_increases(A.histograms(spark, sf_dir)).withColumn("bucket_ms", (F.floor(c("time_us") / 3_600_000_000) * 3_600_000).cast("long"))


@query(f"""{GAINS}, b AS (SELECT DISTINCT bucket_ms, h.hi FROM w, (VALUES (10.0), (50.0), (100.0), (250.0), (NULL)) h(hi) UNION SELECT DISTINCT bucket_ms, 25.0 FROM (SELECT (time_us // 3600000000) * 3600000 AS bucket_ms FROM g WHERE nth > 0 AND nth < 100)),
u AS (SELECT b.bucket_ms, b.hi, coalesce(w.n, 0) AS n FROM b LEFT JOIN w ON b.bucket_ms = w.bucket_ms AND b.hi IS NOT DISTINCT FROM w.hi),
q AS (SELECT *, sum(n) OVER (PARTITION BY bucket_ms ORDER BY hi NULLS LAST) AS cum, sum(n) OVER (PARTITION BY bucket_ms) AS total, coalesce(lag(hi) OVER (PARTITION BY bucket_ms ORDER BY hi NULLS LAST), 0) AS lo FROM u),
f AS (SELECT * FROM q WHERE n > 0 AND cum >= 0.9 * total QUALIFY row_number() OVER (PARTITION BY bucket_ms ORDER BY cum, hi NULLS LAST) = 1)
SELECT bucket_ms, round(CASE WHEN hi IS NULL THEN 250.0 ELSE lo + (total * 0.9 - (cum - n)) / n * (hi - lo) END, 6) AS value FROM f""", A.COUNTERS)
def metric_hist_quantile(spark, sf_dir):
    return K.bucket_quantile(K.bucket_weights(hourly(spark, sf_dir), "bucket_ms"), 0.9, "bucket_ms").select("bucket_ms", r6("value").alias("value"))


@query(f"{GAINS} SELECT (time_us // 3600000000) * 3600000 AS bucket_ms, round(sum(CAST(round(v * 100) AS BIGINT)) / count(*), 6) AS mean FROM g WHERE nth > 0 GROUP BY 1", A.COUNTERS)
def metric_hist_avg(spark, sf_dir):
    return hourly(spark, sf_dir).groupBy("bucket_ms").agg(r6(F.sum("sum_inc") / F.sum("count_inc")).alias("mean"))


@query("""b AS (SELECT user_id, CAST(floor(log2(value) * 2) AS INTEGER) AS i, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT user_id, unnest(range(min(i), max(i) + 1)) AS i FROM b GROUP BY 1)
SELECT user_id, list_prepend(0.0, list(round(pow(2.0, (s.i + 1) / 2.0), 9) ORDER BY s.i)) AS bounds, list_append(list_prepend(0, list(coalesce(n, 0) ORDER BY s.i)), 0) AS counts FROM s LEFT JOIN b USING (user_id, i) GROUP BY 1""".replace("b AS", "WITH b AS", 1))
def metric_exp_hist(spark, sf_dir):
    """Exponential histograms over each user's values, decoded to explicit buckets."""
    own = K.exponential(A.events(spark, sf_dir), 1, "user_id")
    return K.decoded(own).select("user_id", F.transform("bounds", lambda b: F.round(b, 9)).alias("bounds"), "counts")


def window_of(points, seconds: int) -> tuple[int, int]:
    """Whole buckets around all points."""
    width = seconds * 1_000_000
    low, high = points.agg(F.min("time_us"), F.max("time_us")).first()
    return (A.ORIGIN_US, A.ORIGIN_US) if low is None else (low // width * width, (high // width + 1) * width)


CARRY = """m AS (SELECT series, time_us // 60000000 AS i, avg(value) AS mean, arg_max(value, {'t': time_us, 'g': ingested}) AS v, max(time_us) AS t FROM dd GROUP BY 1, 2),
n AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY series ORDER BY i), 1099511627776) AS nx FROM m),
f AS (SELECT series, i, mean FROM n UNION ALL SELECT series, unnest(range(i + 1, least(nx - 1, (t + 300000000) // 60000000) + 1)), v FROM n)"""


@query(f"""{DEDUP}, {CARRY}, w AS (SELECT min(time_us) // 60000000 * 60000 AS lo, max(time_us) // 60000000 * 60000 AS hi FROM points),
raw AS (SELECT time_us // 60000000 * 60000 AS bucket_ms, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT series) AS DOUBLE) AS senders FROM points GROUP BY 1),
kept AS (SELECT time_us // 60000000 * 60000 AS bucket_ms, min(value) AS least, round(quantile_cont(value, 0.95), 6) AS p95 FROM dd GROUP BY 1),
means AS (SELECT i * 60000 AS bucket_ms, round(avg(mean), 6) AS mean, round(sum(mean), 4) AS total FROM f GROUP BY 1),
ends AS (SELECT unnest(range(lo * 1000 + 60000000, hi * 1000 + 60000001, 60000000)) AS e FROM w), grid AS (SELECT series, e FROM (SELECT DISTINCT series FROM dd), ends),
latest AS (SELECT g.e // 1000 - 60000 AS bucket_ms, round(sum(p.value), 4) AS latest FROM grid g ASOF JOIN dd p ON g.series = p.series AND g.e > p.time_us WHERE p.time_us >= g.e - 300000000 GROUP BY 1),
g AS (SELECT bucket_ms FROM raw UNION SELECT bucket_ms FROM means UNION SELECT bucket_ms FROM latest)
SELECT bucket_ms, coalesce(n, 0) AS n, coalesce(senders, 0) AS senders, mean, total, latest, least, p95 FROM g LEFT JOIN raw USING (bucket_ms) LEFT JOIN kept USING (bucket_ms) LEFT JOIN means USING (bucket_ms) LEFT JOIN latest USING (bucket_ms), w WHERE bucket_ms <= hi""", A.POINTS)
def metric_panel_gauge(spark, sf_dir):
    """Seven measures of a gauge over one scan: points as sent, means with carries, last values, points once."""
    points = A.metric_points(spark, sf_dir)
    measures = {"n": B.Measure("count"), "senders": B.Measure("count_distinct", "series"), "mean": B.Measure("avg"), "total": B.Measure("sum"), "latest": B.Measure("last"), "least": B.Measure("min"), "p95": B.Measure("quantile", q=0.95)}
    own = B.assembled(points, measures, MIN, *window_of(points.where("name = 'queue'"), MIN), name="queue", kinds=("gauge",))
    return own.withColumns({k: F.round(k, 4 if k in ("total", "latest") else 6) for k in ("mean", "total", "latest", "p95")})


RATES = SPREAD.replace("parts AS (SELECT series,", "parts AS (SELECT series, time_us,") + """,
r AS (SELECT series, bucket_ms // 60000 AS i, sum(part) / (sum(covered_us) / 1e6) AS rate, arg_max(part / (covered_us / 1e6), time_us) AS last, max(time_us) AS t FROM parts WHERE covered_us > 0 GROUP BY 1, 2),
nx AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY series ORDER BY i), 1099511627776) - 1 AS nx FROM r),
rr AS (SELECT series, i, rate, 0 AS is_carried FROM nx UNION ALL SELECT series, unnest(range(i + 1, least(nx, (t + 300000000) // 60000000) + 1)), last, 1 FROM nx)"""


@query(f"{RATES} SELECT i * 60000 AS bucket_ms, round(sum(rate), 5) AS rate, CAST(sum(is_carried) AS BIGINT) AS carried FROM rr GROUP BY 1", A.COUNTERS)
def metric_rate_carry(spark, sf_dir):
    own = K.carried_rates(K.spread(K.increases(A.counters(spark, sf_dir)), MIN), MIN)
    return own.groupBy("bucket_ms").agg(F.round(F.sum("rate"), 5).alias("rate"), F.sum("is_carried").alias("carried"))


@query(f"""{RATES}, w AS (SELECT max(time_us) // 60000000 * 60000 AS hi FROM counters), h AS (SELECT DISTINCT series, 'h' || (series % 2) AS host FROM counters),
raw AS (SELECT time_us // 60000000 * 60000 AS bucket_ms, host, CAST(count(*) AS DOUBLE) AS n, CAST(max(value) AS DOUBLE) AS most FROM counters JOIN h USING (series) GROUP BY 1, 2),
share AS (SELECT bucket_ms, host, round(100.0 * n / sum(n) OVER (PARTITION BY bucket_ms), 6) AS share FROM raw),
rate AS (SELECT i * 60000 AS bucket_ms, host, round(sum(rate), 5) AS rate FROM rr JOIN h USING (series) GROUP BY 1, 2),
total AS (SELECT bucket_ms, host, round(sum(part), 4) AS total FROM parts JOIN h USING (series) GROUP BY 1, 2), g AS (SELECT bucket_ms, host FROM raw UNION SELECT bucket_ms, host FROM rate UNION SELECT bucket_ms, host FROM total)
SELECT bucket_ms, host, coalesce(n, 0) AS n, share, rate, total, most FROM g LEFT JOIN raw USING (bucket_ms, host) LEFT JOIN share USING (bucket_ms, host) LEFT JOIN rate USING (bucket_ms, host) LEFT JOIN total USING (bucket_ms, host), w WHERE bucket_ms <= hi""", A.COUNTERS)
def metric_panel_counter(spark, sf_dir):
    points = A.metric_points(spark, sf_dir)
    measures = {"n": B.Measure("count"), "share": B.Measure("share"), "rate": B.Measure("rate"), "total": B.Measure("sum"), "most": B.Measure("max")}
    own = B.assembled(points, measures, MIN, *window_of(points.where("name = 'requests'"), MIN), by=("host",), name="requests", kinds=("counter",))
    return own.withColumns({"share": r6("share"), "rate": F.round("rate", 5), "total": F.round("total", 4)})


@query("""p AS (SELECT n.series, n.time_us, n.nth, e.value AS v, n.time_us - lag(n.time_us) OVER (PARTITION BY n.series ORDER BY n.time_us, n.event_id) AS gap FROM nth_points n JOIN events e USING (event_id)),
x AS (SELECT *, gap > 0 AND gap <= 600000000 AS fits, unnest(range(CASE WHEN gap > 0 AND gap <= 600000000 THEN (time_us - gap) // 3600000000 ELSE time_us // 3600000000 END, CASE WHEN gap > 0 AND gap <= 600000000 THEN (time_us - 1) // 3600000000 ELSE time_us // 3600000000 END + 1)) AS i FROM p WHERE nth > 0),
cells AS (SELECT i * 3600000 AS bucket_ms, nth, v, CASE WHEN fits THEN (least(time_us, (i + 1) * 3600000000) - greatest(time_us - gap, i * 3600000000)) / CAST(gap AS DOUBLE) ELSE 1.0 END AS weight FROM x),
w AS (SELECT bucket_ms, CASE WHEN v <= 10 THEN 10.0 WHEN v <= 25 AND nth < 100 THEN 25.0 WHEN v <= 50 THEN 50.0 WHEN v <= 100 THEN 100.0 WHEN v <= 250 THEN 250.0 END AS hi, sum(weight) AS n FROM cells GROUP BY 1, 2),
b AS (SELECT DISTINCT bucket_ms, h.hi FROM w, (VALUES (10.0), (50.0), (100.0), (250.0), (NULL)) h(hi) UNION SELECT DISTINCT bucket_ms, 25.0 FROM cells WHERE nth < 100),
u AS (SELECT b.bucket_ms, b.hi, coalesce(w.n, 0) AS n FROM b LEFT JOIN w ON b.bucket_ms = w.bucket_ms AND b.hi IS NOT DISTINCT FROM w.hi),
q AS (SELECT *, sum(n) OVER (PARTITION BY bucket_ms ORDER BY hi NULLS LAST) AS cum, sum(n) OVER (PARTITION BY bucket_ms) AS total, coalesce(lag(hi) OVER (PARTITION BY bucket_ms ORDER BY hi NULLS LAST), 0) AS lo FROM u),
f AS (SELECT * FROM q WHERE n > 0 AND cum >= 0.9 * total QUALIFY row_number() OVER (PARTITION BY bucket_ms ORDER BY cum, hi NULLS LAST) = 1),
raw AS (SELECT time_us // 3600000000 * 3600000 AS bucket_ms, CAST(count(*) AS DOUBLE) AS n FROM nth_points GROUP BY 1), mean AS (SELECT bucket_ms, round(sum(CAST(round(v * 100) AS BIGINT) * weight) / sum(weight), 4) AS mean FROM cells GROUP BY 1),
p90 AS (SELECT bucket_ms, round(CASE WHEN hi IS NULL THEN 250.0 ELSE lo + (total * 0.9 - (cum - n)) / n * (hi - lo) END, 4) AS p90 FROM f), g AS (SELECT bucket_ms FROM raw UNION SELECT bucket_ms FROM mean)
SELECT bucket_ms, coalesce(raw.n, 0) AS n, mean, p90 FROM g LEFT JOIN raw USING (bucket_ms) LEFT JOIN mean USING (bucket_ms) LEFT JOIN p90 USING (bucket_ms)""".replace("p AS", ", p AS", 1), A.COUNTERS)
def metric_panel_histogram(spark, sf_dir):
    points = A.metric_points(spark, sf_dir)
    measures = {"n": B.Measure("count"), "mean": B.Measure("avg"), "p90": B.Measure("quantile", q=0.9)}
    own = B.assembled(points, measures, 3600, *window_of(points.where("name = 'latency'"), 3600), name="latency", kinds=("histogram",))
    return own.withColumns({"mean": F.round("mean", 4), "p90": F.round("p90", 4)})


@query("SELECT name, kind AS type, n, rate, mean FROM (SELECT 'queue' AS name, 'gauge' AS kind, count(*) AS n, FALSE AS rate, TRUE AS mean FROM points UNION ALL SELECT 'requests', 'counter', count(*), TRUE, FALSE FROM counters UNION ALL SELECT 'latency', 'histogram', count(*), TRUE, TRUE FROM counters)", A.COUNTERS)
def metric_kinds(spark, sf_dir):
    """Which measures each metric's kind answers."""
    return B.diagnosed(A.metric_points(spark, sf_dir), {"rate": B.Measure("rate"), "mean": B.Measure("avg")})


@query("SELECT 'queue' AS name, 'gauge' AS type, count(*) AS n, count(DISTINCT series) AS series, max(time_us) AS last_us FROM points UNION ALL SELECT 'requests', 'counter', count(*), count(DISTINCT series), max(time_us) FROM counters UNION ALL SELECT 'latency', 'histogram', count(*), count(DISTINCT series), max(time_us) FROM counters", A.COUNTERS)
def metric_names(spark, sf_dir):
    """The inventory of metrics with their kinds, series and newest points."""
    return A.metric_points(spark, sf_dir).groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("series").alias("series"), F.max("time_us").alias("last_us"))
