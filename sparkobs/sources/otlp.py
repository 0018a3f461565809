"""OTLP exports in JSON: resource, scope and item levels unfolded into flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
# Of nested values, lists and maps of plain ones are unfolded; what lies deeper stays JSON text.
PLAIN = "stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,bytesValue:string"
DEEP = f"struct<{PLAIN},arrayValue:string,kvlistValue:string>"
VALUE = f"struct<{PLAIN},arrayValue:struct<values:array<{DEEP}>>,kvlistValue:struct<values:array<struct<key:string,value:{DEEP}>>>>"
ATTRIBUTES = f"array<struct<key:string,value:{VALUE}>>"
SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{ATTRIBUTES},status:struct<code:int,message:string>>"
LOG = f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{VALUE},attributes:{ATTRIBUTES},traceId:string,spanId:string>"
NUMBER = f"struct<timeUnixNano:string,startTimeUnixNano:string,asDouble:double,asInt:string,attributes:{ATTRIBUTES}>"
HISTOGRAM = f"struct<timeUnixNano:string,startTimeUnixNano:string,count:string,sum:double,bucketCounts:array<string>,explicitBounds:array<double>,attributes:{ATTRIBUTES}>"
EXPONENTIAL = f"struct<timeUnixNano:string,startTimeUnixNano:string,count:string,sum:double,scale:int,zeroCount:string,zeroThreshold:double,positive:struct<offset:int,bucketCounts:array<string>>,negative:struct<offset:int,bucketCounts:array<string>>,attributes:{ATTRIBUTES}>"
SUMMARY = f"struct<timeUnixNano:string,count:string,sum:double,quantileValues:array<struct<quantile:double,value:double>>,attributes:{ATTRIBUTES}>"
METRIC = f"struct<name:string,unit:string,description:string,gauge:struct<dataPoints:array<{NUMBER}>>,sum:struct<dataPoints:array<{NUMBER}>,aggregationTemporality:int,isMonotonic:boolean>,histogram:struct<dataPoints:array<{HISTOGRAM}>,aggregationTemporality:int>,exponentialHistogram:struct<dataPoints:array<{EXPONENTIAL}>,aggregationTemporality:int>,summary:struct<dataPoints:array<{SUMMARY}>>>"
KINDS = ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")
STATUSES = ("UNSET", "OK", "ERROR")


def plain(v: Column) -> Column:
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"), v["bytesValue"])


def said(v: Column) -> Column:
    """A value as text: lists and maps as JSON."""
    deep = lambda x: F.coalesce(plain(x), x["arrayValue"], x["kvlistValue"])
    pairs = F.map_from_entries(F.transform(v["kvlistValue"]["values"], lambda x: F.struct(x["key"], deep(x["value"]))))
    return F.coalesce(plain(v), F.to_json(F.transform(v["arrayValue"]["values"], deep)), F.to_json(pairs))


def attributes(column: Column) -> Column:
    """key to value in text form; of a repeated key the last stands."""
    latest = lambda xs: F.aggregate(xs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["key"]), F.create_map(x["key"], said(x["value"]))))
    return latest(F.coalesce(column, F.array().cast(ATTRIBUTES)))


def unfolded(exports: DataFrame, column: str, signal: str, item: str, items: str) -> DataFrame:
    """resource (a map), scope and item of every item of JSON exports; texts that are no such JSON give nothing."""
    schema = f"resource{signal} array<struct<resource:struct<attributes:{ATTRIBUTES}>,scope{signal}:array<struct<scope:struct<name:string,version:string>,{items}:array<{item}>>>>>"
    own = exports.select(F.from_json(column, schema).alias("x")).select(F.explode(f"x.resource{signal}").alias("r"))
    own = own.select(attributes(c("r.resource.attributes")).alias("resource"), F.explode(f"r.scope{signal}").alias("s"))
    return own.select("resource", c("s.scope.name").alias("scope_name"), F.explode(f"s.{items}").alias("i"))


def picked(names: tuple[str, ...], i: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, names)), F.coalesce(i, F.lit(0))), F.lit(names[0]))


def common() -> list[Column]:
    return [F.coalesce(c("resource")["service.namespace"], F.lit("default")).alias("namespace"), F.coalesce(c("resource")["service.name"], F.lit("")).alias("service")]


def spans(exports: DataFrame, column: str = "value") -> DataFrame:
    own = unfolded(exports, column, "Spans", SPAN, "spans")
    start, end = c("i.startTimeUnixNano").try_cast("long"), c("i.endTimeUnixNano").try_cast("long")
    return own.select(
        *common(), c("i.traceId").alias("trace_id"), c("i.spanId").alias("span_id"), F.coalesce(c("i.parentSpanId"), F.lit("")).alias("parent_span_id"), c("i.name").alias("operation"),
        picked(KINDS, c("i.kind")).alias("kind"), start.alias("start_unix_nano"), F.when(end >= start, (end - start) / 1e6).otherwise(0.0).alias("duration_ms"),
        picked(STATUSES, c("i.status.code")).alias("status"), attributes(c("i.attributes")).alias("attributes"), "resource", "scope_name",
    )


def logs(exports: DataFrame, column: str = "value") -> DataFrame:
    from sparkobs.functions import text

    own = unfolded(exports, column, "Logs", LOG, "logRecords")
    body = said(c("i.body"))
    at = F.coalesce(F.nullif(c("i.timeUnixNano").try_cast("long"), F.lit(0)), c("i.observedTimeUnixNano").try_cast("long"))
    return own.select(*common(), at.alias("time_unix_nano"), text.severity(c("i.severityText"), c("i.severityNumber")).alias("severity"), body.alias("body"), text.template(body).alias("body_template"), c("i.traceId").alias("trace_id"), c("i.spanId").alias("span_id"), attributes(c("i.attributes")).alias("attributes"), "resource", "scope_name")


def points(exports: DataFrame, column: str = "value") -> DataFrame:
    """Points of the five kinds in one relation; columns of other kinds are null. Histograms with bucket counts that do not fit their bounds lose both."""
    own = unfolded(exports, column, "Metrics", METRIC, "metrics").select(*common(), "resource", "scope_name", "i")
    long = lambda x: F.transform(x, lambda v: v.try_cast("long"))
    temporality = lambda x: F.when(c(x) == 1, "delta").when(c(x) == 2, "cumulative")

    def branch(kind: str, type_: Column, temporal: Column, *columns: Column) -> DataFrame:
        rows = own.select("*", F.explode(f"i.{kind}.dataPoints").alias("p"))
        start = c("p.startTimeUnixNano").try_cast("long") if kind != "summary" else F.lit(None).cast("long")
        return rows.select("namespace", "service", c("i.name").alias("name"), c("i.unit").alias("unit"), type_.alias("type"), temporal.alias("temporality"), c("p.timeUnixNano").try_cast("long").alias("time_unix_nano"), start.alias("start_unix_nano"), attributes(c("p.attributes")).alias("attributes"), "resource", *columns)

    number = F.coalesce(c("p.asDouble"), c("p.asInt").try_cast("double")).alias("value")
    fits = F.size("p.bucketCounts") == F.size("p.explicitBounds") + 1
    parts = [
        branch("gauge", F.lit("gauge"), F.lit(None).cast("string"), number),
        branch("sum", F.when(c("i.sum.isMonotonic"), "counter").otherwise("updown"), temporality("i.sum.aggregationTemporality"), number),
        branch("histogram", F.lit("histogram"), temporality("i.histogram.aggregationTemporality"), c("p.count").try_cast("long").alias("hist_count"), c("p.sum").alias("hist_sum"), F.when(fits, c("p.explicitBounds")).alias("hist_bounds"), F.when(fits, long(c("p.bucketCounts"))).alias("hist_counts")),
        branch("exponentialHistogram", F.lit("exponential_histogram"), temporality("i.exponentialHistogram.aggregationTemporality"), c("p.count").try_cast("long").alias("hist_count"), c("p.sum").alias("hist_sum"), c("p.scale").alias("exp_scale"), c("p.zeroCount").try_cast("long").alias("exp_zero_count"), c("p.zeroThreshold").alias("exp_zero_threshold"), c("p.positive.offset").alias("exp_positive_offset"), long(c("p.positive.bucketCounts")).alias("exp_positive_counts"), c("p.negative.offset").alias("exp_negative_offset"), long(c("p.negative.bucketCounts")).alias("exp_negative_counts")),
        branch("summary", F.lit("summary"), F.lit(None).cast("string"), c("p.count").try_cast("long").alias("hist_count"), c("p.sum").alias("hist_sum"), F.transform("p.quantileValues", lambda q: q["quantile"]).alias("quantiles"), F.transform("p.quantileValues", lambda q: q["value"]).alias("quantile_values")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return with_series(out)


def with_series(points: DataFrame) -> DataFrame:
    """series: equal for points of one stream, whatever the order of their attributes."""
    ordered = lambda m: F.to_json(F.array_sort(F.map_entries(m)))
    return points.withColumn("series", F.xxhash64("namespace", "service", "name", F.coalesce("unit", F.lit("")), ordered(c("attributes")), ordered(c("resource"))))
