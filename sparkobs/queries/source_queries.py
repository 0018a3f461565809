"""Sources, signals at rest and alert states."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkobs.operators import alerts, rollups
from sparkobs.queries.registry import query
from sparkobs.sources import adapters as A
from sparkobs.sources import dataset, otlp

c = F.col


def shared(spark: SparkSession) -> str:
    """A new folder where all machines can read and write: under spark.checkpoint.dir, or in the warehouse where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/dataset-{uuid.uuid4().hex}"


#: Events whose ids share a chunk may share an export, so no export outgrows a value.
CHUNK = 10_000


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as OTLP JSON exports by service, day and chunk of events."""
    attribute = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    code = F.array_position(F.array(*map(F.lit, otlp.STATUSES)), c("status")) - 1
    kind = F.array_position(F.array(*map(F.lit, otlp.KINDS)), c("kind")) - 1
    item = F.struct(
        c("trace_id").alias("traceId"), c("span_id").alias("spanId"), c("parent_span_id").alias("parentSpanId"), c("operation").alias("name"), kind.cast("int").alias("kind"),
        (c("start_us") * 1000).cast("string").alias("startTimeUnixNano"), (c("start_us") * 1000 + F.round(c("duration_ms") * 1_000_000).cast("long")).cast("string").alias("endTimeUnixNano"),
        F.array(attribute("http.route", c("http_route")), attribute("peer.service", c("peer_service"))).alias("attributes"), F.struct(code.cast("int").alias("code")).alias("status"),
    )
    groups = A.spans(spark, sf_dir).groupBy("service", F.floor(c("start_us") / 86_400_000_000).alias("day"), F.floor(c("event_id") / CHUNK).alias("chunk")).agg(F.collect_list(item).alias("spans"))
    resource = F.struct(F.array(attribute("service.name", c("service")), attribute("service.namespace", F.lit("shop"))).alias("attributes"))
    scopes = F.array(F.struct(F.struct(F.lit("lib").alias("name")).alias("scope"), c("spans")))
    return groups.select(F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), scopes.alias("scopeSpans"))).alias("resourceSpans"))).alias("value"))


@query("SELECT namespace, service, trace_id, span_id, parent_span_id, operation, kind, start_us * 1000 AS start_unix_nano, round(duration_ms, 6) AS duration_ms, status, http_route, peer_service FROM spans", A.SPANS)
def otlp_spans(spark, sf_dir):
    own = otlp.spans(exported(spark, sf_dir))
    return own.select("namespace", "service", "trace_id", "span_id", "parent_span_id", "operation", "kind", "start_unix_nano", F.round("duration_ms", 6).alias("duration_ms"), "status", c("attributes")["http.route"].alias("http_route"), c("attributes")["peer.service"].alias("peer_service"))


FROM_US, TO_US = A.ORIGIN_US + 5 * 86_400_000_000, A.ORIGIN_US + 9 * 86_400_000_000


@query(f"SELECT service, count(*) AS n, min(start_us) AS first_us, max(duration_ms) AS slowest FROM spans WHERE start_us >= {FROM_US} AND start_us < {TO_US} GROUP BY 1", A.SPANS)
def dataset_window(spark, sf_dir):
    """All spans at rest by hour, of which a window's hours are read."""
    root, own = shared(spark), A.spans(spark, sf_dir)
    dataset.write(own.select("trace_id", "span_id", "service", "start_us", "duration_ms"), root, "start_us", ["service", "start_us"])
    kept = dataset.read(spark, root, "start_us", FROM_US, TO_US)
    return kept.groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.min("start_us").alias("first_us"), F.max("duration_ms").alias("slowest"))


@query("SELECT event_type AS name, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1")
def dataset_metric_names(spark, sf_dir):
    """Points at rest by name, one metric for each event type; a read by names lists only their folders."""
    root, own = shared(spark), A.events(spark, sf_dir)
    dataset.write(own.select(c("event_type").alias("name"), c("ts_us").alias("time_us"), "value"), root, "time_us", ["time_us"], ("name",))
    kept = dataset.read(spark, root, "time_us").where(c("name").isin("purchase", "signup"))
    return kept.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


RULE = alerts.Rule("errors", hold_ms=60_000, repeat_ms=600_000, cooldown_ms=120_000)


@query()
def alert_states(spark, sf_dir):
    """Notices of an error-rate rule over every service's minutes (tested against a plain fold)."""
    minutes = rollups.service_rollup(A.spans(spark, sf_dir, "dense_us"), A.logs(spark, sf_dir, "dense_us"))
    return alerts.notices(minutes.select("service", c("bucket_ms").alias("time_ms"), (c("error_rate") >= 20).alias("breach")), RULE)


def exported_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as OTLP JSON exports by chunk of events."""
    point = F.struct((c("time_us") * 1000).cast("string").alias("timeUnixNano"), c("value").alias("asDouble"), F.array(F.struct(F.lit("series").alias("key"), F.struct(c("series").cast("string").alias("intValue")).alias("value"))).alias("attributes"))
    groups = A.points(spark, sf_dir).groupBy(F.floor(c("event_id") / CHUNK).alias("chunk")).agg(F.collect_list(point).alias("dataPoints"))
    metric = F.struct(F.lit("value").alias("name"), F.lit("ms").alias("unit"), F.struct("dataPoints").alias("gauge"))
    scopes = F.array(F.struct(F.array(metric).alias("metrics")))
    return groups.select(F.to_json(F.struct(F.array(F.struct(scopes.alias("scopeMetrics"))).alias("resourceMetrics"))).alias("value"))


@query("SELECT series, count(*) AS n FROM points GROUP BY 1", A.POINTS)
def otlp_points(spark, sf_dir):
    """Gauge and cumulative points through OTLP JSON; the streams of one name are told apart by their attributes."""
    own = otlp.points(exported_points(spark, sf_dir)).where("type = 'gauge'").groupBy("series").agg(F.min(c("attributes")["series"].cast("int")).alias("name"), F.count(F.lit(1)).alias("n"))
    return own.select(c("name").alias("series"), "n")
