"""Service edges and the graph over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkobs.operators import measures as M
from sparkobs.operators.rollups import touched
from sparkobs.plans.panels import bucket

c = F.col


def call_edges(spans: DataFrame, seconds: int = 60, parents: DataFrame | None = None) -> DataFrame:
    """Caller and callee of spans whose parent (of ``parents``, where ``spans`` are a part of all) is in another service, by the child's time."""
    child = spans.where("parent_span_id <> '' and service <> ''")
    parent = (spans if parents is None else parents).where("service <> ''").select("namespace", "trace_id", c("span_id").alias("parent_span_id"), c("service").alias("caller"))
    own = child.join(parent, ["namespace", "trace_id", "parent_span_id"]).where("caller <> service")
    return own.groupBy("namespace", bucket(c("start_us"), seconds).alias("bucket_ms"), "caller", c("service").alias("callee")).agg(F.count(F.lit(1)).alias("calls"), F.avg("duration_ms").alias("avg_ms"), M.error_rate().alias("error_rate"))


def edge_hours(new: DataFrame, spans: DataFrame, width: int = 1) -> DataFrame:
    """Hours (or blocks of ``width`` hours) whose call edges new spans change: their own, and those of the children that wait for them among all ``spans``."""
    parents = new.select("namespace", "trace_id", c("span_id").alias("parent_span_id")).distinct()
    children = spans.where("parent_span_id <> ''").join(parents, ["namespace", "trace_id", "parent_span_id"], "left_semi")
    return touched(new, "start_us", width).union(touched(children, "start_us", width)).distinct()


def messaging_edges(spans: DataFrame, seconds: int = 60) -> DataFrame:
    """Producers and consumers of one destination in one bucket; both sides are aggregated before they meet."""
    key = ["namespace", "bucket_ms", "messaging_destination", "messaging_system"]
    own = spans.where("messaging_destination is not null").withColumn("bucket_ms", bucket(c("start_us"), seconds))
    sends = own.where("kind = 'PRODUCER'").groupBy(*key, c("service").alias("caller")).agg(F.count(F.lit(1)).alias("sent")).drop("sent")
    takes = own.where("kind = 'CONSUMER'").groupBy(*key, c("service").alias("callee")).agg(F.count(F.lit(1)).alias("calls"))
    return sends.join(takes, key).where("caller <> callee").groupBy("namespace", "bucket_ms", "caller", "callee").agg(F.sum("calls").alias("calls"))


def peer_edges(spans: DataFrame, seconds: int = 60) -> DataFrame:
    """Client spans to a named peer without a child span in another service."""
    children = spans.where("parent_span_id <> ''").select("namespace", "trace_id", c("parent_span_id").alias("span_id"), c("service").alias("child_service"))
    clients = spans.where("kind = 'CLIENT' and peer_service is not null and peer_service <> service")
    answered = clients.join(children, ["namespace", "trace_id", "span_id"]).where("child_service <> service").select("namespace", "trace_id", "span_id")
    alone = clients.join(answered, ["namespace", "trace_id", "span_id"], "left_anti")
    return alone.groupBy("namespace", bucket(c("start_us"), seconds).alias("bucket_ms"), c("service").alias("caller"), c("peer_service").alias("callee")).agg(F.count(F.lit(1)).alias("calls"), M.error_rate().alias("error_rate"), F.percentile("duration_ms", F.lit(0.5)).alias("p50_ms"), F.percentile("duration_ms", F.lit(0.95)).alias("p95_ms"))


def topology(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (services, and external peers that did not report themselves) and edges of a window."""
    nodes = spans.groupBy("namespace", c("service").alias("name")).agg(F.count(F.lit(1)).alias("spans"), M.error_rate().alias("error_rate")).withColumn("external", F.lit(False))
    calls = call_edges(spans, 86_400).groupBy("namespace", "caller", "callee").agg(F.sum("calls").alias("calls"), (F.sum(c("error_rate") * c("calls")) / F.sum("calls")).alias("error_rate"))
    peers = peer_edges(spans, 86_400).groupBy("namespace", "caller", "callee").agg(F.sum("calls").alias("calls"), (F.sum(c("error_rate") * c("calls")) / F.sum("calls")).alias("error_rate"))
    peers = peers.join(nodes.select("namespace", c("name").alias("callee")), ["namespace", "callee"], "left_anti")
    outside = peers.select("namespace", c("callee").alias("name")).distinct().select("namespace", "name", F.lit(0).cast("long").alias("spans"), F.lit(0.0).alias("error_rate"), F.lit(True).alias("external"))
    return nodes.unionByName(outside), calls.unionByName(peers)


def dependencies(edges: DataFrame, namespace: str, root: str, depth: int = 8, nodes: int = 100, upstream: bool = False) -> DataFrame:
    """Least hops from ``root`` to what it reaches, level by level; new nodes are admitted by name until there are ``nodes``.

    The frontier and what was seen hold ``nodes`` rows at most; the edges stay distributed."""
    spark = edges.sparkSession
    a, b = ("callee", "caller") if upstream else ("caller", "callee")
    pairs = edges.where(c("namespace") == namespace).select(c(a).alias("a"), c(b).alias("b")).distinct().cache()
    seen, level = {root: 0}, [root]
    for hops in range(1, depth + 1):
        if not level or len(seen) >= nodes:
            break
        old = spark.createDataFrame([(x,) for x in seen], "b string")
        front = spark.createDataFrame([(x,) for x in level], "a string")
        new = pairs.join(F.broadcast(front), "a", "left_semi").select("b").distinct().join(F.broadcast(old), "b", "left_anti").orderBy("b").limit(nodes - len(seen))
        level = [r.b for r in new.collect()]
        seen |= dict.fromkeys(level, hops)
    pairs.unpersist()
    return spark.createDataFrame(sorted(seen.items()), "name string, hops int")
