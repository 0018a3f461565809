"""Panels of rows: log tails and patterns, traces, exemplars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkobs.functions import text
from sparkobs.plans.panels import bucket

c = F.col
SHOWN = 2000


def logs_tail(logs: DataFrame, n: int = 100, search: str | None = None) -> DataFrame:
    """The newest records; bodies are redacted before they are searched or shown."""
    own = logs.withColumn("body", text.redacted(c("body")))  # guarded: bodies without a telling word keep out of the patterns
    own = own if search is None else own.where(F.contains(F.lower("body"), F.lit(search.lower())))
    return own.orderBy(F.desc("time_us"), F.desc("event_id")).limit(n).withColumn("body", F.left("body", F.lit(SHOWN)))


def log_patterns(logs: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent templates with their leading severity and service: one scan, then counts by template, severity and service alone."""
    own = logs.withColumn("template", text.template(text.redacted(c("body")), with_json=False))
    cells = own.groupBy("template", "severity", "service").agg(F.count(F.lit(1)).alias("n"))
    levels, services = Window.partitionBy("template", "severity"), Window.partitionBy("template", "service")
    level = F.struct(F.sum("n").over(levels).alias("m"), text.severity_rank(c("severity")).alias("r"), "severity")
    service = F.struct((-F.sum("n").over(services)).alias("m"), "service")
    own = cells.withColumns({"level": level, "by": service}).groupBy("template").agg(F.sum("n").alias("n"), F.max("level").alias("level"), F.min("by").alias("by"))
    return own.orderBy(F.desc("n"), "template").limit(top).select("template", "n", c("level.severity").alias("severity"), c("by.service").alias("service"))


def pattern_trend(logs: DataFrame, patterns: DataFrame, seconds: int, start_us: int, end_us: int) -> DataFrame:
    """Zero-filled counts by bucket for each shown pattern (``patterns`` has the panel's few rows)."""
    own = logs.withColumn("template", text.template(text.redacted(c("body")), with_json=False)).join(F.broadcast(patterns.select("template")), "template", "left_semi")
    counts = own.groupBy("template", bucket(c("time_us"), seconds).alias("bucket_ms")).agg(F.count(F.lit(1)).alias("n"))
    width = seconds * 1000
    grid = patterns.select("template", F.explode(F.sequence(F.lit(start_us // 1000 // width * width), F.lit((end_us - 1) // 1000), F.lit(width))).alias("bucket_ms"))
    return grid.join(counts, ["template", "bucket_ms"], "left").select("template", "bucket_ms", F.coalesce("n", F.lit(0)).alias("n"))


def roots(spans: DataFrame) -> DataFrame:
    """Root (no parent first, then earliest, then by id), extent and status of each trace."""
    first = F.min_by(F.struct("span_id", "service", "operation"), F.struct((c("parent_span_id") != ""), "start_us", "span_id"))
    return spans.groupBy("namespace", "trace_id").agg(first.alias("r"), F.min("start_us").alias("start_us"), F.max("duration_ms").alias("duration_ms"), F.count(F.lit(1)).alias("spans"), F.when(F.bool_or(c("status") == "ERROR"), "ERROR").otherwise("OK").alias("status")).select("namespace", "trace_id", c("r.span_id").alias("root"), "r.service", "r.operation", "start_us", "duration_ms", "spans", "status")


def traces(spans: DataFrame, hit: Column, miss: Column | None = None, n: int = 100, by: str = "duration") -> DataFrame:
    """The slowest (or newest, by start, or those with most errors) traces in which a span meets ``hit`` and none meets ``miss``: one pass over spans picks them, a second reads only those."""
    rank = {"duration": F.max("duration_ms"), "start": F.min("start_us"), "errors": F.count_if(c("status") == "ERROR")}[by]
    flags = spans.groupBy("namespace", "trace_id").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("hit"), F.bool_or(F.coalesce(miss, F.lit(False)) if miss is not None else F.lit(False)).alias("miss"), rank.alias("rank"))
    best = flags.where("hit and not miss").orderBy(F.desc("rank"), "namespace", "trace_id").limit(n).select("namespace", "trace_id")
    return roots(spans.join(F.broadcast(best), ["namespace", "trace_id"], "left_semi"))


def exemplar_logs(logs: DataFrame, chosen: Column, n: int = 200) -> DataFrame:
    """Records behind a selection, the most severe and newest first, redacted."""
    own = logs.where(chosen).orderBy(F.desc(text.severity_rank(c("severity"))), F.desc("time_us"), "event_id").limit(n)
    return own.withColumn("body", F.left(text.redacted(c("body")), F.lit(SHOWN)))


def trace_detail(spans: DataFrame, trace_id: str) -> DataFrame:
    """A trace's spans; on files sorted by trace id the predicate prunes row groups."""
    return spans.where(c("trace_id") == trace_id).select("span_id", "parent_span_id", "service", "operation", "start_us", "duration_ms", "status")


def exemplars(spans: DataFrame, chosen: Column, n: int = 20, candidates: int = 64) -> DataFrame:
    """Roots of traces behind a selection: the slowest spans first, a trace once."""
    near = spans.where(chosen).orderBy(F.desc("duration_ms"), "span_id").limit(candidates)
    ids = near.groupBy("namespace", "trace_id").agg(F.max("duration_ms").alias("d")).orderBy(F.desc("d"), "trace_id").limit(n)
    return roots(spans.join(F.broadcast(ids.select("namespace", "trace_id")), ["namespace", "trace_id"], "left_semi"))


def trace_logs(logs: DataFrame, trace_id: str, n: int = 200) -> DataFrame:
    """Records that carry a trace's id, redacted, oldest first."""
    own = logs.where(c("trace_id") == trace_id).orderBy("time_us", "event_id").limit(n)
    return own.withColumn("body", F.left(text.redacted(c("body")), F.lit(SHOWN)))


def notable_trace(spans: DataFrame) -> DataFrame:
    """The latest trace with an error, or the latest one where there is none."""
    return roots(spans).orderBy(F.desc(c("status") == "ERROR"), F.desc("start_us"), "trace_id").limit(1)


def carried_forward(df: DataFrame, by: str, order: list[str], value: Column, width: Column, to: str) -> DataFrame:
    """Adds ``to``, the last non-null ``value`` up to each row of ``by`` in ``order``.

    ``width`` cuts a group into runs along its order; the last value of each run is carried over runs, of which there are few,
    and then to the rows, so no task sorts a whole group."""
    own = df.withColumns({"__run": width, "__v": value})
    ends = own.groupBy(by, "__run").agg(F.max_by("__v", F.when(c("__v").isNotNull(), F.struct(*order))).alias("__end"))
    before = ends.select(c(by).alias("__by"), c("__run").alias("__of"), F.last("__end", ignorenulls=True).over(Window.partitionBy(by).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    here = F.last("__v", ignorenulls=True).over(Window.partitionBy(by, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = own.withColumn("__here", here).join(before, c(by).eqNullSafe(c("__by")) & c("__run").eqNullSafe(c("__of")), "left")
    return rows.select(*df.columns, F.coalesce("__here", "__before").alias(to))
