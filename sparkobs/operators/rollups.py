"""Minute rollups: pure functions from base rows (and the keys to recompute) to rollup rows, for batch and streams alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkobs.operators import measures as M
from sparkobs.plans.panels import bucket
from sparkobs.sources.dataset import first_hour

ROUTES = 128
ZERO_BIN = -2_147_483_648
c = F.col


def served() -> Column:
    return ~c("kind").isin("CLIENT", "PRODUCER")


def by_minute(df: DataFrame, time: str, seconds: int = 60) -> DataFrame:
    return df.withColumn("bucket_ms", bucket(c(time), seconds))


def affected(new: DataFrame, time: str) -> DataFrame:
    """Keys (namespace, bucket, service) that new rows touch."""
    return by_minute(new, time).select("namespace", "bucket_ms", "service").distinct()


def touched(new: DataFrame, time: str, width: int = 1) -> DataFrame:
    """Hours (or blocks of ``width`` hours, by their first) that new rows touch; a batch has few."""
    return new.select(first_hour(c(time), width).alias("hour")).distinct()


def in_hours(df: DataFrame, hours: DataFrame, time: str, width: int = 1) -> DataFrame:
    """Rows of whole hours, or of whole blocks of ``width`` hours."""
    return df.withColumn("__hour", first_hour(c(time), width)).join(hours.select(c("hour").alias("__hour")), "__hour", "left_semi").drop("__hour")


def restricted(df: DataFrame, keys: DataFrame | None, time: str) -> DataFrame:
    own = by_minute(df, time)
    return own if keys is None else own.join(keys, ["namespace", "bucket_ms", "service"], "left_semi")


def service_rollup(spans: DataFrame, logs: DataFrame, keys: DataFrame | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """Counts, served quantiles (all spans where none is served), error rate, log counts, and the number of metrics that reported where points are given."""
    quantile = lambda q: F.coalesce(F.percentile(F.when(served(), c("duration_ms")), F.lit(q)), F.percentile("duration_ms", F.lit(q)))
    s = restricted(spans, keys, "start_us").groupBy("namespace", "bucket_ms", "service").agg(F.count(F.lit(1)).alias("spans"), F.count_if(served()).alias("served_spans"), quantile(0.5).alias("p50_ms"), quantile(0.95).alias("p95_ms"), M.error_rate().alias("error_rate"))
    g = restricted(logs, keys, "time_us").groupBy("namespace", "bucket_ms", "service").agg(F.count(F.lit(1)).alias("log_count"))
    own = s.join(g, ["namespace", "bucket_ms", "service"], "full_outer").na.fill(0, ["spans", "served_spans", "log_count"])
    if metrics is None:
        return own
    m = restricted(metrics, keys, "time_us").groupBy("namespace", "bucket_ms", "service").agg(F.countDistinct("name").alias("metric_count"))
    return own.join(m, ["namespace", "bucket_ms", "service"], "full_outer").na.fill(0, ["spans", "served_spans", "log_count", "metric_count"])


def log_bin(ms: Column) -> Column:
    """ceil(8 log2 ms); ZERO_BIN for what is not above 0."""
    return F.when(ms > 0, F.ceil(F.log2(ms) * 8).cast("int")).otherwise(ZERO_BIN)


def span_rollup(spans: DataFrame, keys: DataFrame | None = None, seconds: int = 60) -> DataFrame:
    """Count, sum, extremes and the log-bin histogram as a map, by service, kind and status."""
    key = ["namespace", "bucket_ms", "service", "kind", "status"]
    own = (by_minute(spans, "start_us", seconds) if keys is None else restricted(spans, keys, "start_us")).withColumn("bin", log_bin(c("duration_ms")))
    bins = own.groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total"), F.min("duration_ms").alias("lo"), F.max("duration_ms").alias("hi"))
    return bins.groupBy(*key).agg(F.sum("n").alias("spans"), F.sum("total").alias("duration_sum"), F.min("lo").alias("duration_min"), F.max("hi").alias("duration_max"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("bin", "n")))).alias("hist"))


def hist_quantile(rollup: DataFrame, q: float, *by: str) -> DataFrame:
    """Quantile of merged log-bin histograms: linear inside the first bin that reaches q."""
    bins = rollup.select(*by, F.explode("hist").alias("bin", "m")).groupBy(*by, "bin").agg(F.sum("m").alias("m"))
    w = Window.partitionBy(*by)
    own = bins.withColumns({"cum": F.sum("m").over(w.orderBy("bin")), "total": F.sum("m").over(w)}).where(c("cum") >= c("total") * q)
    first = own.groupBy(*by).agg(F.min_by(F.struct("bin", "m", "cum", "total"), "bin").alias("x"))
    low, high = F.pow(F.lit(2.0), (c("x.bin") - 1) / 8), F.pow(F.lit(2.0), c("x.bin") / 8)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c("x.total") * q - (c("x.cum") - c("x.m"))) / c("x.m")))
    return first.select(*by, F.when(c("x.bin") == ZERO_BIN, 0.0).otherwise(low + part * (high - low)).alias("value"))


def fresh_to(rollups: dict[str, DataFrame]) -> DataFrame:
    """The end of what each rollup holds in full, in milliseconds: its newest minute's start."""
    parts = [df.agg(F.lit(k).alias("rollup"), F.max("bucket_ms").alias("fresh_to_ms")) for k, df in rollups.items()]
    return reduce(DataFrame.unionByName, parts)


def log_rollup(logs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return restricted(logs, keys, "time_us").groupBy("namespace", "bucket_ms", "service", "severity").agg(F.count(F.lit(1)).alias("logs"))


def endpoint_rollup(spans: DataFrame, routes: int = ROUTES, seconds: int = 60) -> DataFrame:
    """Spans by route; routes beyond the busiest ``routes`` of a service and minute share one overflow row."""
    own = by_minute(spans.where("http_route <> ''"), "start_us", seconds)
    groups = own.groupBy("namespace", "bucket_ms", "service", "http_route").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total"), F.max("duration_ms").alias("hi"))
    rank = F.row_number().over(Window.partitionBy("namespace", "bucket_ms", "service").orderBy(F.desc("n"), "http_route"))
    folded = groups.withColumn("overflow", rank > routes).withColumn("route", F.when(c("overflow"), "").otherwise(c("http_route")))
    return folded.groupBy("namespace", "bucket_ms", "service", "route", "overflow").agg(F.sum("n").alias("spans"), F.sum("total").alias("duration_sum"), F.max("hi").alias("duration_max"))


def version_rollup(spans: DataFrame) -> DataFrame:
    return spans.groupBy("namespace", "service", "service_version").agg(F.min("start_us").alias("first_us"), F.max("start_us").alias("last_us"))


def deploys(versions: DataFrame) -> DataFrame:
    """Every version of a service but its first, at the time it was first seen."""
    rank = F.row_number().over(Window.partitionBy("namespace", "service").orderBy("first_us", "service_version"))
    return versions.withColumn("nth", rank).where("nth > 1").select("namespace", "service", "service_version", c("first_us").alias("deploy_us"))


def trace_candidates(spans: DataFrame) -> DataFrame:
    return spans.groupBy("namespace", "trace_id").agg(F.min("start_us").alias("first_us"), F.max(c("start_us") + (c("duration_ms") * 1000).cast("long")).alias("last_us"), F.bool_or(c("status") == "ERROR").alias("failed"), F.count(F.lit(1)).alias("spans"))
