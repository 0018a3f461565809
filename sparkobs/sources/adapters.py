"""Signals derived from the driver's tables: spans, logs and metric points over ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The dense clock's origin, 2024-01-01 00:00:00 UTC, in microseconds.
ORIGIN_US = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the integer k of their props and two clocks in microseconds: ts_us, and dense_us with a step of 7 s."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").withColumns({
        "k": k, "ts_us": F.unix_micros(F.col("ts").cast("timestamp")), "dense_us": F.lit(ORIGIN_US) + (F.col("event_id") * 7 + k % 5) * 1_000_000,
    })


def spans(spark: SparkSession, sf_dir: str, clock: str = "ts_us") -> DataFrame:
    """One span per event; a trace is a user's day, each span the child of the one before it."""
    own = events(spark, sf_dir)
    by_trace = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    kinds, k = F.array(*map(F.lit, ("SERVER", "CLIENT", "INTERNAL", "PRODUCER", "CONSUMER"))), F.col("k")
    kind = F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int"))
    status = F.when(k < 15, "ERROR").when(F.col("event_id") % 2 == 0, "OK").otherwise("UNSET")
    queue = kind.isin("PRODUCER", "CONSUMER")
    return own.select(
        F.lit("shop").alias("namespace"), F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("trace_id"),
        F.col("event_id").cast("string").alias("span_id"), F.coalesce(F.lag("event_id").over(by_trace).cast("string"), F.lit("")).alias("parent_span_id"),
        F.col("event_type").alias("service"), F.concat(F.lit("op"), (k % 10).cast("string")).alias("operation"), kind.alias("kind"),
        F.col(clock).alias("start_us"), F.col("value").alias("duration_ms"), status.alias("status"),
        F.concat(F.lit("/r/"), (k % 20).cast("string")).alias("http_route"), F.when(k < 15, 500).when(k < 90, 200).cast("long").alias("status_code"),
        F.when(queue, F.concat(F.lit("q"), (k % 3).cast("string"))).alias("messaging_destination"), F.when(queue, "mq").alias("messaging_system"),
        F.when(kind == "CLIENT", F.concat(F.lit("ext"), (k % 4).cast("string"))).alias("peer_service"),
        F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), "v1").otherwise("v2").alias("service_version"), "event_id", "k",
    )


SPANS = """
ev AS (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k, epoch_us(ts) AS ts_us FROM events),
spans AS (SELECT 'shop' AS namespace, user_id || '-' || strftime(ts, '%Y-%m-%d') AS trace_id, CAST(event_id AS VARCHAR) AS span_id,
  coalesce(CAST(lag(event_id) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS VARCHAR), '') AS parent_span_id,
  event_type AS service, 'op' || (k % 10) AS operation, ['SERVER', 'CLIENT', 'INTERNAL', 'PRODUCER', 'CONSUMER'][event_id % 5 + 1] AS kind,
  ts_us AS start_us, 1704067200000000 + (event_id * 7 + k % 5) * 1000000 AS dense_us, value AS duration_ms,
  CASE WHEN k < 15 THEN 'ERROR' WHEN event_id % 2 = 0 THEN 'OK' ELSE 'UNSET' END AS status, '/r/' || (k % 20) AS http_route,
  CASE WHEN k < 15 THEN 500 WHEN k < 90 THEN 200 END AS status_code,
  CASE WHEN event_id % 5 >= 3 THEN 'q' || (k % 3) END AS messaging_destination, CASE WHEN event_id % 5 >= 3 THEN 'mq' END AS messaging_system,
  CASE WHEN event_id % 5 = 1 THEN 'ext' || (k % 4) END AS peer_service, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'v1' ELSE 'v2' END AS service_version, event_id, k
  FROM ev)"""


def logs(spark: SparkSession, sf_dir: str, clock: str = "ts_us") -> DataFrame:
    """One log record per event; some have no severity."""
    by_type = F.create_map(*map(F.lit, ("error", "ERROR", "purchase", "WARN", "signup", "INFO", "view", "DEBUG", "click", "TRACE")))
    body = F.concat("event_type", F.lit(" user "), F.col("user_id").cast("string"), F.lit(" took "), F.col("k").cast("string"), F.lit(" ms"))
    return events(spark, sf_dir).select(
        F.lit("shop").alias("namespace"), F.col(clock).alias("time_us"), F.when(F.col("k") >= 95, "UNSPECIFIED").otherwise(by_type[F.col("event_type")]).alias("severity"),
        body.alias("body"), F.col("event_type").alias("service"), "user_id", "event_id", "k",
    )


LOGS = """
lev AS (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k, epoch_us(ts) AS ts_us FROM events),
logs AS (SELECT 'shop' AS namespace, ts_us AS time_us, 1704067200000000 + (event_id * 7 + k % 5) * 1000000 AS dense_us,
  CASE WHEN k >= 95 THEN 'UNSPECIFIED' WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'purchase' THEN 'WARN' WHEN event_type = 'signup' THEN 'INFO' WHEN event_type = 'view' THEN 'DEBUG' ELSE 'TRACE' END AS severity,
  event_type || ' user ' || user_id || ' took ' || k || ' ms' AS body, event_type AS service, user_id, event_id, k FROM lev)"""


def first_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric points on the dense clock, each as first sent: 8 series with gaps."""
    own = events(spark, sf_dir).where("event_id % 500 >= 60 and event_id % 2000 >= 140")
    return own.select((F.col("event_id") % 8).cast("int").alias("series"), F.col("dense_us").alias("time_us"), F.col("event_id").alias("ingested"), F.col("value").alias("value"), "event_id")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first points, and some of them sent again later with another value."""
    first = first_points(spark, sf_dir)
    again = first.where("event_id % 20 = 0").select("series", "time_us", (F.col("ingested") + 1_000_000).alias("ingested"), (F.col("value") + 1).alias("value"), "event_id")
    return first.unionByName(again)


POINTS = """
pev AS (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events WHERE event_id % 500 >= 60 AND event_id % 2000 >= 140),
first_points AS (SELECT CAST(event_id % 8 AS INTEGER) AS series, 1704067200000000 + (event_id * 7 + k % 5) * 1000000 AS time_us, event_id AS ingested, value, event_id FROM pev),
points AS (SELECT * FROM first_points UNION ALL SELECT series, time_us, ingested + 1000000, value + 1, event_id FROM first_points WHERE event_id % 20 = 0)"""


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cumulative counter per series that starts again every 50 points; integer hundredths keep sums exact."""
    own = first_points(spark, sf_dir)
    n = own.withColumn("nth", F.row_number().over(Window.partitionBy("series").orderBy("time_us", "event_id")) - 1).withColumn("life", F.floor(F.col("nth") / 50).cast("long"))
    total = F.sum(F.round(F.col("value") * 100).cast("long")).over(Window.partitionBy("series", "life").orderBy("nth"))
    start = F.min("time_us").over(Window.partitionBy("series", "life"))
    return n.select("series", "time_us", "ingested", total.alias("value"), start.alias("start_us"), "event_id", "nth")


COUNTERS = POINTS + """,
nth_points AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY time_us, event_id) - 1 AS nth FROM first_points),
counters AS (SELECT series, time_us, ingested, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY series, nth // 50 ORDER BY nth) AS BIGINT) AS value,
  min(time_us) OVER (PARTITION BY series, nth // 50) AS start_us, event_id, nth FROM nth_points)"""

#: Bounds of the latency histogram; the narrower list stands from each series' hundredth point on.
BOUNDS, NARROW = (10.0, 25.0, 50.0, 100.0, 250.0), (10.0, 50.0, 100.0, 250.0)


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cumulative histogram of each series' values so far; its bounds change once."""
    own = counters(spark, sf_dir).select("series", "time_us", "event_id", "nth").join(events(spark, sf_dir).select("event_id", F.col("value").alias("v")), "event_id")
    so_far = Window.partitionBy("series").orderBy("nth")

    def counts(bounds: tuple[float, ...]) -> Column:
        edges = [(None if i == 0 else bounds[i - 1], bounds[i] if i < len(bounds) else None) for i in range(len(bounds) + 1)]
        inside = [(F.lit(True) if a is None else F.col("v") > a) & (F.lit(True) if b is None else F.col("v") <= b) for a, b in edges]
        return F.array(*(F.sum(x.cast("long")).over(so_far) for x in inside))

    early = F.col("nth") < 100
    as_array = lambda b: F.array(*map(F.lit, b))
    return own.select(
        "series", "time_us", F.col("event_id").alias("ingested"), F.when(early, as_array(BOUNDS)).otherwise(as_array(NARROW)).alias("bounds"),
        F.when(early, counts(BOUNDS)).otherwise(counts(NARROW)).alias("counts"), F.sum(F.round(F.col("v") * 100).cast("long")).over(so_far).alias("sum"),
    )


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of three metrics in one relation: queue (a gauge, some points sent twice), requests (a counter) and latency (a histogram), 8 series each on two hosts."""

    def named(df: DataFrame, name: str, kind: str, temporality: str | None, **columns: Column) -> DataFrame:
        own = {"value": "double", "start_us": "long", "bounds": "array<double>", "counts": "array<bigint>", "sum": "double", "count": "long"}
        rest = [(columns.get(k) if k in columns else F.lit(None)).cast(t).alias(k) for k, t in own.items()]
        return df.select(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(temporality).cast("string").alias("temporality"), F.concat(F.lit(name), F.col("series").cast("string")).alias("series"), F.concat(F.lit("h"), (F.col("series") % 2).cast("string")).alias("host"), "time_us", "ingested", *rest)

    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    queue = named(points(spark, sf_dir), "queue", "gauge", None, value=F.col("value"))
    requests = named(counters(spark, sf_dir), "requests", "counter", "cumulative", value=F.col("value"), start_us=F.col("start_us"))
    return queue.unionByName(requests).unionByName(named(histograms(spark, sf_dir), "latency", "histogram", "cumulative", bounds=F.col("bounds"), counts=F.col("counts"), sum=F.col("sum"), count=total))


def receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a collector: checks of an endpoint for each event type from two hosts, their durations, and the hosts' processor time."""
    k, col = F.col("k"), F.col
    name = F.when(k % 3 == 0, "httpcheck.status").when(k % 3 == 1, "httpcheck.duration").otherwise("system.cpu.time")
    pick = lambda a, b, z: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(z)
    none, check = F.lit(None).cast("string"), k % 3 < 2
    attributes = F.map_from_arrays(F.array(*map(F.lit, ("http.url", "http.method", "http.status_class", "state"))), F.array(F.when(check, F.concat(F.lit("http://"), "event_type")), F.when(check, "GET"), F.when(k % 3 == 0, F.when(k < 60, "2xx").otherwise("5xx")), F.when(~check, "user")))
    return events(spark, sf_dir).select(
        F.lit("shop").alias("namespace"), F.lit("collector").alias("service"), name.alias("name"), pick(F.lit("gauge"), F.lit("gauge"), F.lit("counter")).alias("type"), pick(none, none, F.lit("cumulative")).alias("temporality"), pick(F.lit("1"), F.lit("ms"), F.lit("s")).alias("unit"),
        F.lit("recv").alias("scope_name"), F.create_map(F.lit("host.name"), F.concat(F.lit("h"), (col("event_id") % 2).cast("string")), F.lit("service.version"), F.when(col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), "v1").otherwise("v2")).alias("resource"),
        attributes.alias("attributes"), col("dense_us").alias("time_us"), pick(F.when(k < 60, 1.0).otherwise(0.0), col("value"), F.round(col("value") * 100)).alias("value"), F.lit(None).cast("long").alias("start_us"), col("event_id").alias("ingested"),
    )


RECEIVERS = """
rv AS (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events),
rc AS (SELECT CASE k % 3 WHEN 0 THEN 'httpcheck.status' WHEN 1 THEN 'httpcheck.duration' ELSE 'system.cpu.time' END AS name, 'h' || (event_id % 2) AS host, CASE WHEN k % 3 < 2 THEN 'http://' || event_type END AS url,
  CASE WHEN k % 3 = 0 THEN CASE WHEN k < 60 THEN '2xx' ELSE '5xx' END END AS class, 1704067200000000 + (event_id * 7 + k % 5) * 1000000 AS time_us, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'v1' ELSE 'v2' END AS version,
  CASE k % 3 WHEN 0 THEN CASE WHEN k < 60 THEN 1.0 ELSE 0.0 END WHEN 1 THEN value ELSE round(value * 100) END AS value FROM rv)"""
