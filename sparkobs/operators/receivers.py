"""Minute rollups of what collectors report: witnesses of checks, hosts and containers, their entities, and resources.

Points are rows of namespace, service, name, type, temporality, unit, scope_name, resource and attributes (maps), time_us,
value, start_us and ingested. A series has few points a minute, and a summary's size does not depend on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkobs.plans.panels import bucket

c = F.col
# The metrics that are summarised.
NAMES = (
    "httpcheck.status", "httpcheck.duration", "system.cpu.time", "system.memory.usage", "system.filesystem.usage",
    "container.cpu.utilization", "container.cpu.limit", "container.memory.usage.total", "container.memory.usage.limit",
)
RESOURCE = {"host": "host.name", "container_id": "container.id", "container_name": "container.name"}
ATTRIBUTES = {"state": "state", "cpu": "cpu", "mountpoint": "mountpoint", "device": "device", "url": "http.url", "method": "http.method", "class": "http.status_class", "code": "http.status_code"}
IDENTITY = ["namespace", "service", "name", "type", "temporality", "unit", "scope_name", *RESOURCE, *ATTRIBUTES]
INVENTORY = ("host.name", "service.version", "process.runtime.name", "process.runtime.version", "telemetry.sdk.language", "telemetry.sdk.version")
POINT = ("time_us", "value", "start_us", "ingested")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def receiver_rollup(points: DataFrame, seconds: int = 60) -> DataFrame:
    """By series and minute: the first, last and last but one point, the same of finite points, and what counters gained in which time."""
    own = points.where(c("name").isin(*NAMES))
    own = own.select("namespace", "service", "name", "type", "temporality", "unit", "scope_name", *(c("resource")[v].alias(k) for k, v in RESOURCE.items()), *(c("attributes")[v].alias(k) for k, v in ATTRIBUTES.items()), *POINT)
    own = own.withColumns({"series": F.sha2(F.to_json(F.array(*IDENTITY)), 256), "bucket_ms": bucket(c("time_us"), seconds)})
    key = ["series", "bucket_ms", *IDENTITY]
    once = own.groupBy(*key, "time_us").agg(F.max(F.struct("ingested", "value", "start_us")).alias("x")).select(*key, "time_us", "x.*")
    w = Window.partitionBy("series", "bucket_ms").orderBy("time_us")
    point = F.struct(*POINT)
    own = once.withColumns({"point": point, "ok": finite(c("value"))}).withColumns({"before": F.lag("point").over(w), "finite": F.when(c("ok"), c("point"))})
    own = own.withColumn("finite_before", F.last("finite", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    delta, old = F.coalesce(c("temporality") == "delta", F.lit(False)), c("finite_before")
    reset = delta | (c("value") < old["value"]) | F.coalesce(c("start_us") != old["start_us"], F.lit(False))
    both = c("ok") & old.isNotNull()
    since = F.when(delta & (c("start_us") < c("time_us")), c("start_us")).otherwise(old["time_us"])
    return own.groupBy(*key).agg(
        F.min_by("point", "time_us").alias("first_point"), F.max_by("point", "time_us").alias("last_point"), F.max_by("before", "time_us").alias("previous_point"),
        F.min_by("finite", F.when(c("ok"), c("time_us"))).alias("first_finite_point"), F.max_by("finite", F.when(c("ok"), c("time_us"))).alias("last_finite_point"), F.max_by("finite_before", F.when(c("ok"), c("time_us"))).alias("previous_finite_point"),
        F.sum(F.when(both, F.when(reset, c("value")).otherwise(c("value") - old["value"]))).alias("counter_increase"), (F.sum(F.when(both, c("time_us") - since)) / 1e6).alias("counter_seconds"),
    )


def witnesses(first: Column, previous: Column, last: Column) -> Column:
    """The points among three that are there and differ in time."""
    other = lambda p: F.when(p["time_us"] != first["time_us"], p)
    return F.filter(F.array(first, other(previous), other(last)), lambda p: p.isNotNull())


def receiver_points(rollup: DataFrame) -> DataFrame:
    """The witnesses as points again: all of checks, the finite ones of everything else."""
    pick = lambda a, b: F.when(c("name") == "httpcheck.status", c(a)).otherwise(c(b))
    kept = witnesses(pick("first_point", "first_finite_point"), pick("previous_point", "previous_finite_point"), pick("last_point", "last_finite_point"))
    return rollup.select("series", "bucket_ms", *IDENTITY, F.explode(kept).alias("p")).select("series", "bucket_ms", *IDENTITY, "p.*")


def receiver_entities(rollup: DataFrame) -> DataFrame:
    """By minute, the observations of each check, host and container: flag 1 a check that succeeded, 2 one that cannot be judged, 0 any other report."""
    container = c("name").startswith("container.")
    known = lambda x: F.coalesce(x != "", F.lit(False))
    blind = ~(known(c("url")) & known(c("method")) & known(c("host"))) | ~c("type").isin("gauge", "updown") | ~finite(c("p.value")) | c("class").isNull() & c("code").isNull()
    good = (c("p.value") > 0) & (F.coalesce(c("class").isin("2xx", "3xx"), F.lit(False)) | F.coalesce(c("code").try_cast("int").between(200, 399), F.lit(False)))
    check = c("name") == "httpcheck.status"
    said = F.concat(F.coalesce("namespace", F.lit("")), F.lit(" / "), F.coalesce("method", F.lit("method unknown")), F.lit(" "), F.coalesce("url", F.lit("endpoint unknown")), F.lit(" from "), F.coalesce("host", F.lit("vantage unknown")))
    name = F.when(check, F.sha2(F.to_json(F.array("namespace", "url", "method", "host")), 256)).when(container, F.sha2(F.to_json(F.array("host", "container_id")), 256)).otherwise(c("host"))
    own = rollup.where("name <> 'httpcheck.duration'").withColumn("p", F.explode(witnesses(c("first_point"), c("previous_point"), c("last_point"))))
    own = own.select(
        "namespace", "bucket_ms", "service", F.when(check, "check").when(container, "container").otherwise("host").alias("receiver"), name.alias("entity"), "host", "container_id", "container_name",
        F.when(check, said).alias("endpoint_from"), c("p.time_us").alias("time_us"), F.when(~check, 0).when(blind, 2).when(good, 1).otherwise(0).alias("flag"), c("name").alias("family"),
    )
    key = ["namespace", "bucket_ms", "service", "receiver", "family", "entity", "host", "container_id", "endpoint_from"]
    attempts = own.groupBy(*key, "time_us").agg(F.max("flag").alias("flag"), F.max("container_name").alias("container_name")).withColumn("seen", F.struct("time_us", "flag"))
    attempts = attempts.withColumn("before", F.lag("seen").over(Window.partitionBy(*key).orderBy("time_us")))
    return attempts.groupBy(*key).agg(F.max_by("container_name", "time_us").alias("container_name"), F.min_by("seen", "time_us").alias("first_observation"), F.max_by("before", "time_us").alias("previous_observation"), F.max_by("seen", "time_us").alias("last_observation"))


def resource_rollup(rows: DataFrame, signal: str, time: str, seconds: int = 60) -> DataFrame:
    """By minute and service, the identities that reported and when they were first and last seen."""
    identity = F.struct(*(c("resource")[k].alias(k.replace(".", "_")) for k in INVENTORY))
    return rows.groupBy("namespace", bucket(c(time), seconds).alias("bucket_ms"), "service", F.lit(signal).alias("signal"), identity.alias("identity")).agg(F.min(time).alias("first_us"), F.max(time).alias("last_us"))


def check_latency(points: DataFrame, seconds: int, start_us: int, end_us: int) -> DataFrame:
    """Milliseconds of each check at every bucket's end, from a report no older than five minutes."""
    from sparkobs.operators import metrics as K

    factor = F.create_map(*(F.lit(x) for kv in {"s": 1000.0, "ms": 1.0, "us": 0.001, "ns": 0.000001}.items() for x in kv))
    own = points.where("name = 'httpcheck.duration' and type in ('gauge', 'updown')").withColumn("value", c("value") * factor[c("unit")])
    labels = own.groupBy("series").agg(F.first("url").alias("url"), F.first("host").alias("host"))
    return K.last_at(own, seconds, start_us, end_us).join(labels, "series").groupBy("bucket_ms", "url", "host").agg(F.sum("value").alias("latency_ms"))


def reachability(entities: DataFrame, seconds: int, end_us: int) -> DataFrame:
    """The state of each check at every bucket's end since its first report: 0 reachable, 1 down, 2 unknown.

    A report holds until the next one, and for two of its check's own intervals at most."""
    width = seconds * 1_000_000
    seen = witnesses(c("first_observation"), c("previous_observation"), c("last_observation"))
    own = entities.where("receiver = 'check'").select("entity", "endpoint_from", F.explode(seen).alias("p")).groupBy("entity", "endpoint_from", c("p.time_us").alias("time_us")).agg(F.max("p.flag").alias("flag"))
    w = Window.partitionBy("entity").orderBy("time_us")
    own = own.withColumns({"failure": F.when(c("flag") == 2, 2).when(c("flag") == 1, 0).otherwise(1), "gap": c("time_us") - F.lag("time_us").over(w), "next_us": F.lead("time_us").over(w)})
    own = own.withColumn("every_us", F.last(F.when(c("gap") > 0, c("gap")), ignorenulls=True).over(w))
    a, b = F.floor(c("time_us") / width) + 1, F.floor(F.least(F.coalesce("next_us", F.lit(end_us)), F.lit(end_us)) / width)
    ends = own.withColumns({"a": a.cast("long"), "b": b.cast("long")}).where("a <= b").withColumn("i", F.explode(F.sequence("a", "b")))
    state = F.when(c("every_us").isNull() | (c("failure") == 2) | (c("i") * width - c("time_us") >= 2 * c("every_us")), 2).otherwise(c("failure"))
    return ends.select("endpoint_from", ((c("i") - 1) * (seconds * 1000)).alias("bucket_ms"), state.alias("failure"))
