"""Panels over metric points: several measures of one scan, each by the rule of its points' kinds, aligned by bucket and dimensions.

Points are rows of name, type (gauge, updown, counter, histogram), temporality, series, time_us, ingested, value,
start_us, bounds, counts, sum, count and any dimensions; a series has one value of each dimension. Every builder reads
only its kinds, and those of equal kinds share the shuffle that tells retries from points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkobs.operators import metrics as K
from sparkobs.plans.panels import aligned, bucket, dim

c = F.col
GAUGES, SCALARS = ("gauge", "updown"), ("gauge", "updown", "counter")
#: Which kinds answer each measure of the value; quantiles are by gauges and histograms.
KINDS = {"rate": ("counter", "histogram"), "sum": (*SCALARS, "histogram"), "avg": (*GAUGES, "histogram"), "last": SCALARS, "min": SCALARS, "max": SCALARS, "quantile": (*GAUGES, "histogram")}
COUNTS = ("count", "count_distinct", "share")
#: Panel units of UCUM units. "1" has none: it stands for ratios and percents alike.
UNITS = {"s": "s", "ms": "ms", "ns": "ns", "By": "bytes", "%": "percent"}


@dataclass(frozen=True)
class Measure:
    """A function of KINDS or COUNTS over ``field``; on the value it follows the points' kinds, on any other field all points as sent."""

    fn: str
    field: str = "value"
    q: float = 0.5

    @property
    def by_kind(self) -> bool:
        return self.field == "value" and self.fn not in COUNTS


def unit(ucum: str) -> str:
    return "count" if ucum.startswith("{") and ucum.endswith("}") else UNITS.get(ucum, "")


def lookback(measures: dict[str, Measure]) -> int:
    """How far before the window points are read: increases need the point before, carries and last values a fresh one."""
    widths = [K.LOOKBACK_US if m.fn == "rate" or "histogram" in KINDS.get(m.fn, ()) else K.STALE_US if m.fn == "last" else 0 for m in measures.values() if m.by_kind]
    return max(widths, default=0)


def diagnosed(points: DataFrame, measures: dict[str, Measure]) -> DataFrame:
    """name, type, n, and for each measure whether points of that kind answer it: what to say of an empty panel."""
    kinds = points.groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"))
    return kinds.select("*", *(c("type").isin(*KINDS[m.fn]).alias(k) if m.by_kind else F.lit(True).alias(k) for k, m in measures.items()))


def assembled(points: DataFrame, measures: dict[str, Measure], seconds: int, start_us: int, end_us: int, by: tuple[str, ...] = (), name: str | None = None, kinds: tuple[str, ...] = (*SCALARS, "histogram")) -> DataFrame:
    """bucket_ms, the dimensions ``by`` and a column for each of ``measures`` over [start_us, end_us).

    Values of several metrics do not mix: measures of the value need one ``name``, or the name among ``by``. ``kinds`` are
    those that the inventory knows of the metrics asked for; nothing is planned for others."""
    if name is None and "name" not in by and any(m.by_kind for m in measures.values()):
        raise ValueError("a measure of the value needs the name of one metric, or the name as a dimension")
    back = lookback(measures)
    scan = points.where((c("time_us") >= start_us - back) & (c("time_us") < end_us))
    scan = scan if name is None else scan.where(c("name") == name)
    keys = ["bucket_ms", *by]
    inside = lambda df: df.where((c("bucket_ms") >= start_us // 1000 // (seconds * 1000) * (seconds * 1000)) & (c("bucket_ms") < end_us // 1000))
    raw = scan.where(c("time_us") >= start_us).select(bucket(c("time_us"), seconds).alias("bucket_ms"), *(dim(c(d)).alias(d) for d in by), *(x for x in scan.columns if x not in by))
    labels = K.valid(scan).select("series", *(dim(c(d)).alias(d) for d in by)).distinct() if by else None
    of = lambda kinds: K.deduped(K.valid(scan.where(c("type").isin(*kinds))))  # noqa: E731  kinds reach the scan

    def grouped(rows: DataFrame, value: Column) -> DataFrame:
        """Rows of series and bucket over all series of a group."""
        rows = rows.join(labels, "series") if by else rows
        return inside(rows).groupBy(*keys).agg(value.alias("value"))

    def every(*builders: tuple[tuple[str, ...], Callable[[], DataFrame]]) -> DataFrame:
        """The rows of all builders whose kinds there are; a measure that no kind answers has none."""
        rows = [build() for of_kinds, build in builders if {*of_kinds} & {*kinds}]
        return reduce(DataFrame.unionByName, rows) if rows else builders[0][1]().limit(0)

    def scalar_parts() -> DataFrame:
        return K.spread(K.increases(of(("counter",))), seconds)

    def histogram_parts() -> DataFrame:
        return K.spread(K.histogram_increases(of(("histogram",))), seconds, gained="gained", total="sum_inc", part="count_inc")

    def built(m: Measure) -> DataFrame:
        whole = {"min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg, "last": lambda x: F.max_by(x, F.struct("time_us", "ingested")), "quantile": lambda x: F.percentile(x, F.lit(m.q))}
        if m.fn == "count":
            return raw.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("value"))
        if m.fn == "count_distinct":
            return raw.groupBy(*keys).agg(F.countDistinct(m.field).cast("double").alias("value"))
        if m.fn == "share":
            counts = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            return counts.withColumn("value", F.lit(100.0) * c("n") / F.sum("n").over(Window.partitionBy("bucket_ms")))
        if not m.by_kind:
            return raw.groupBy(*keys).agg(whole[m.fn](c(m.field).cast("double")).alias("value"))
        if m.fn == "rate":
            return grouped(every((("counter",), lambda: K.carried_rates(scalar_parts(), seconds)), (("histogram",), lambda: K.carried_rates(histogram_parts(), seconds))), F.sum("rate"))
        if m.fn == "sum":
            means = lambda: K.carried(of(GAUGES), seconds).select("series", "bucket_ms", c("mean").alias("v"))
            sums = lambda: scalar_parts().groupBy("series", "bucket_ms").agg(F.sum("part").alias("v"))
            totals = lambda: histogram_parts().groupBy("series", "bucket_ms").agg(F.sum("total").alias("v"))
            return grouped(every((GAUGES, means), (("counter",), sums), (("histogram",), totals)), F.sum("v"))
        if m.fn == "avg":
            means = lambda: K.carried(of(GAUGES), seconds).select("series", "bucket_ms", c("mean").alias("v"), F.lit(1.0).alias("weight"))
            totals = lambda: histogram_parts().where("total is not null").groupBy("series", "bucket_ms").agg(F.sum("total").alias("v"), F.sum("part").alias("weight"))
            return grouped(every((GAUGES, means), (("histogram",), totals)), F.sum("v") / F.nullif(F.sum("weight"), F.lit(0.0)))
        if m.fn == "last":
            return grouped(K.last_at(of(SCALARS), seconds, start_us, -(-end_us // (seconds * 1_000_000)) * seconds * 1_000_000), F.sum("value"))
        if m.fn == "quantile":

            def from_buckets() -> DataFrame:
                weights = histogram_parts()
                return K.bucket_quantile(K.bucket_weights(inside(weights.join(labels, "series") if by else weights), *keys), m.q, *keys)

            from_points = lambda: grouped(of(GAUGES).withColumn("bucket_ms", bucket(c("time_us"), seconds)).select("series", "bucket_ms", c("value").alias("v")), F.percentile("v", F.lit(m.q)))
            return every((GAUGES, from_points), (("histogram",), from_buckets)).groupBy(*keys).agg(F.max("value").alias("value"))  # a metric has one kind
        plain = of(SCALARS).where(c("time_us") >= start_us).withColumn("bucket_ms", bucket(c("time_us"), seconds)).select("series", "bucket_ms", c("value").alias("v"))
        return grouped(plain, whole[m.fn](c("v")))

    frames = {k: inside(built(m)) for k, m in measures.items()}
    groups = raw.select(*keys)
    for f in frames.values():
        groups = groups.union(f.select(*keys))
    return aligned(groups.distinct(), keys, frames, {k for k, m in measures.items() if m.fn in ("count", "count_distinct")})
