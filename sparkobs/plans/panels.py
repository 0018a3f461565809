"""One plan for each visualization: bucketed series with a fold, bars, tables, totals, distributions, items, rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LADDER_S = (10, 30, 60, 300, 600, 900, 1800, 3600, 10_800, 21_600, 43_200, 86_400)


def interval(window_s: int, width_px: int = 640) -> int:
    """The first step of the ladder that gives a point for each 4 pixels at most (30 to 2,000 points)."""
    points = min(2000, max(30, width_px // 4))
    return next((s for s in LADDER_S if window_s // s + 1 <= points), LADDER_S[-1])


def bucket(time_us: Column, seconds: int) -> Column:
    """Start of the bucket in milliseconds."""
    return (F.floor(time_us / (seconds * 1_000_000)) * (seconds * 1000)).cast("long")


def dim(field: Column) -> Column:
    """Groups merge null and the empty text."""
    return F.coalesce(field.cast("string"), F.lit(""))


def folded(df: DataFrame, name: str, order: list[Column], top: int, **aggregates: Column) -> DataFrame:
    """Replaces all but the ``top`` values of ``name`` by "Other (k)" in the raw rows, so that any measure stays exact.

    Null and the empty text are one value. ``order`` ranks the values over the whole window by ``aggregates``; the top
    list has ``top`` rows, and the number of the others is a scalar subquery."""
    own = df.withColumn(name, dim(F.col(name)))
    groups = own.groupBy(name).agg(*(c.alias(k) for k, c in aggregates.items()))
    best = groups.orderBy(*order).limit(top).select(F.col(name).alias("__top"))
    others = groups.agg((F.count(F.lit(1)) - top).cast("string")).scalar()
    rows = own.join(F.broadcast(best), F.col(name) == F.col("__top"), "left")
    return rows.withColumn(name, F.when(F.col("__top").isNotNull(), F.col(name)).otherwise(F.concat(F.lit("Other ("), others, F.lit(")")))).drop("__top")


def aligned(groups: DataFrame, keys: list[str], frames: dict[str, DataFrame], zero: set[str]) -> DataFrame:
    """``groups`` with a column of each frame (keys and value), null-safe by key; those of ``zero`` are 0 where a group has none."""
    for name, frame in frames.items():
        own = frame.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("value").alias(f"__{name}"))
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
        value = F.coalesce(f"__{name}", F.lit(0.0)) if name in zero else F.col(f"__{name}")
        groups = groups.join(own, on, "left").withColumn(name, value).drop(*(f"__{k}" for k in keys), f"__{name}")
    return groups


def timeseries(df: DataFrame, time: str, seconds: int, measures: dict[str, Column], by: str | None = None) -> DataFrame:
    keys = [bucket(F.col(time), seconds).alias("bucket_ms"), *([dim(F.col(by)).alias(by)] if by else [])]
    return df.groupBy(*keys).agg(*(m.alias(k) for k, m in measures.items()))


def table(df: DataFrame, dims: list[str], measures: dict[str, Column], order: list[Column], limit: int = 100) -> DataFrame:
    return df.groupBy(*(dim(F.col(d)).alias(d) for d in dims)).agg(*(m.alias(k) for k, m in measures.items())).orderBy(*order).limit(limit)


def stat(df: DataFrame, time: str, seconds: int, measures: dict[str, Column]) -> DataFrame:
    """Buckets and the window's total (bucket_ms null, total 1) in one pass."""
    own = df.withColumn("bucket_ms", bucket(F.col(time), seconds))
    return own.rollup("bucket_ms").agg(F.grouping("bucket_ms").cast("int").alias("total"), *(m.alias(k) for k, m in measures.items()))


def log2_bin(field: Column) -> Column:
    """Lower edge of the bin: 0 below 1, else a power of two up to 2**32."""
    return F.when(field < 1, 0.0).otherwise(F.pow(F.lit(2.0), F.least(F.lit(32.0), F.floor(F.log2(field)).cast("double"))))


def histogram(df: DataFrame, field: str) -> DataFrame:
    own = df.where(F.col(field).isNotNull() & ~F.isnan(field) & (F.col(field) >= 0))
    return own.groupBy(log2_bin(F.col(field)).alias("lo")).agg(F.count(F.lit(1)).alias("n"))


def heatmap(df: DataFrame, time: str, seconds: int, field: str) -> DataFrame:
    own = df.where(F.col(field).isNotNull() & ~F.isnan(field) & (F.col(field) >= 0))
    return own.groupBy(bucket(F.col(time), seconds).alias("bucket_ms"), log2_bin(F.col(field)).alias("lo")).agg(F.count(F.lit(1)).alias("n"))


def state_timeline(df: DataFrame, time: str, seconds: int, item: str, measure: dict[str, Column], top: int) -> DataFrame:
    """Buckets of the items with the most rows."""
    best = df.groupBy(item).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), item).limit(top).select(item)
    return timeseries(df.join(F.broadcast(best), item, "left_semi"), time, seconds, measure, item)


def table_trends(df: DataFrame, time: str, seconds: int, dims: list[str], measures: dict[str, Column], shown: DataFrame) -> DataFrame:
    """The measures by bucket for the rows that a table shows; ``shown`` has its limit's rows at most."""
    own = df.select("*", *(dim(F.col(d)).alias(f"__{d}") for d in dims))
    kept = own.join(F.broadcast(shown.select(*(F.col(d).alias(f"__{d}") for d in dims))), [f"__{d}" for d in dims], "left_semi")
    return kept.groupBy(*(F.col(f"__{d}").alias(d) for d in dims), bucket(F.col(time), seconds).alias("bucket_ms")).agg(*(m.alias(k) for k, m in measures.items()))


def capped_distribution(cells: DataFrame, cap: int = 20_000) -> DataFrame:
    """A heatmap's cells (bucket_ms, lo, n), at most ``cap``, newest first; the oldest bucket goes if the cap cuts it."""
    shown = cells.orderBy(F.desc("bucket_ms"), "lo").limit(cap + 1)
    cut = shown.agg(F.when(F.count(F.lit(1)) > cap, F.min("bucket_ms"))).scalar()
    return shown.where(cut.isNull() | (F.col("bucket_ms") > cut))


def capped_series(series: DataFrame, by: str, top: int, buckets: int = 2000) -> DataFrame:
    """A time series' points in order, at most ``buckets`` for each of the shown values and the others."""
    return series.orderBy("bucket_ms", by).limit(buckets * (top + 1))


def reduced(series: DataFrame, how: str, value: str = "value") -> DataFrame:
    """One number of a bucketed series: its last, mean, min, max or sum; buckets without a value do not count."""
    whole = {"last": F.max_by(value, F.when(F.col(value).isNotNull(), F.col("bucket_ms"))), "mean": F.avg(value), "min": F.min(value), "max": F.max(value), "sum": F.sum(value)}
    return series.agg(whole[how].alias(value))


def performance(spans: DataFrame, time: str, seconds: int, limit: int = 400) -> dict[str, DataFrame]:
    """A service's panels: latency, errors and requests by bucket, and the operations that serve slowly."""
    value = {"latency": F.percentile("duration_ms", F.lit(0.95)), "errors": F.lit(100.0) * F.avg(F.when(F.col("status") == "ERROR", 1.0).otherwise(0.0)), "requests": F.count(F.lit(1)) / F.lit(float(seconds))}
    own = {k: timeseries(spans, time, seconds, {"value": v}) for k, v in value.items()}
    served = spans.where(F.col("kind").isin("SERVER", "CONSUMER"))
    return own | {"operations": table(served, ["operation"], {"value": value["latency"]}, [F.desc("value"), F.col("operation")], limit)}


#: For each visualization, the fewest and most dimensions and measures, and whether it has buckets (None: it may).
SHAPES = {"stat": ((0, 0), (1, 1), None), "gauge": ((0, 0), (1, 1), None), "timeseries": ((0, 1), (1, 6), True), "bar": ((1, 2), (1, 6), False), "table": ((0, 3), (1, 6), False), "scatter": ((1, 2), (2, 2), False), "state_timeline": ((1, 1), (1, 1), True), "heatmap": ((0, 0), (1, 1), True), "histogram": ((0, 0), (1, 1), False)}


def compatible(dims: int, measures: int, bucketed: bool) -> list[str]:
    """Visualizations that show a query of so many dimensions and measures; grouped series and bars by two dimensions take one measure."""
    out = []
    for viz, ((d0, d1), (m0, m1), buckets) in SHAPES.items():
        one = viz == "timeseries" and dims == 1 or viz == "bar" and dims == 2
        if d0 <= dims <= d1 and m0 <= measures <= (1 if one else m1) and buckets in (None, bucketed):
            out.append(viz)
    return out


TIMES, NUMBERS = ("timestamp", "timestamp_ntz", "date"), ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def roles(df: DataFrame) -> dict[str, str]:
    """What each column of an author's result is for: the first time is the axis, numbers are measures, all else are dimensions."""
    out: dict[str, str] = {}
    for name, kind in df.dtypes:
        bare = kind.split("(")[0]
        out[name] = "time" if bare in TIMES and "time" not in out.values() else "measure" if bare in NUMBERS else "dimension"
    return out


def frame(df: DataFrame, cap: int = 1000) -> DataFrame:
    """Results as they leave: NaN and infinities are null, at most ``cap`` rows and one more that says there are others."""
    finite = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c)
    return df.select(*(finite(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes)).limit(cap + 1)
