"""Panels that minute rollups answer: the choice of the source, and the same measures over summaries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkobs.operators import measures as M
from sparkobs.operators import rollups as R
from sparkobs.plans.panels import aligned, bucket

c = F.col
VIZ = ("stat", "gauge", "timeseries", "bar", "table")
#: Dimensions that each signal's rollup keeps, and the measures it answers of all rows and of durations.
KEPT = {"spans": ("namespace", "service", "kind", "status"), "logs": ("namespace", "service", "severity")}
ROWS = {"spans": ("count", "rate", "error_rate", "share"), "logs": ("count", "rate", "share")}
DURATIONS = ("avg", "sum", "min", "max", "quantile")


@dataclass(frozen=True)
class Panel:
    """measures: alias to (function, field or none, quantile); filters: a predicate and the columns that it reads; seconds: a bucket's width, 0 for none."""

    signal: str
    measures: dict[str, tuple[str, str | None, float]]
    viz: str = "table"
    by: tuple[str, ...] = ()
    filters: tuple[tuple[Column, tuple[str, ...]], ...] = field(default=())
    seconds: int = 0
    window_s: float = 3600.0


def routable(p: Panel) -> bool:
    """Whether the rollup holds all that the panel asks for: dimensions, filters and measures, in buckets of whole minutes."""
    columns = {*p.by, *(x for _, used in p.filters for x in used)}
    measures = all(fn in ROWS.get(p.signal, ()) if name is None else p.signal == "spans" and name == "duration_ms" and fn in DURATIONS for fn, name, _ in p.measures.values())
    return p.viz in VIZ and p.signal in KEPT and columns <= {*KEPT[p.signal]} and measures and p.seconds % 60 == 0


def keyed(p: Panel, df: DataFrame, clock: Column | None) -> tuple[DataFrame, list[str]]:
    for q, _ in p.filters:
        df = df.where(q)
    return (df.withColumn("at_ms", clock), ["at_ms", *p.by]) if p.seconds else (df, [*p.by])


def over_rows(p: Panel, rows: DataFrame, time: str) -> DataFrame:
    own, keys = keyed(p, rows, bucket(c(time), p.seconds) if p.seconds else None)
    value = {"count": lambda f, q: M.count(), "share": lambda f, q: M.count(), "rate": lambda f, q: M.rate(p.seconds or p.window_s), "error_rate": lambda f, q: M.error_rate(), "avg": lambda f, q: F.avg(f), "sum": lambda f, q: F.sum(f), "min": lambda f, q: F.min(f), "max": lambda f, q: F.max(f), "quantile": lambda f, q: M.quantile(c(f), q)}
    return shares(p, own.groupBy(*keys).agg(*(value[fn](f, q).alias(k) for k, (fn, f, q) in p.measures.items())))


def over_rollup(p: Panel, rollup: DataFrame) -> DataFrame:
    """Sums of summaries; quantiles come from merged histograms and join their groups null-safe."""
    n = "spans" if p.signal == "spans" else "logs"
    own, keys = keyed(p, rollup, F.floor(c("bucket_ms") / (p.seconds * 1000)).cast("long") * (p.seconds * 1000) if p.seconds else None)
    total, bad = F.sum(n), F.sum(F.when(c("status") == "ERROR", c(n)).otherwise(0)) if p.signal == "spans" else None
    value = {"count": total.cast("double"), "share": total.cast("double"), "rate": total / F.lit(float(p.seconds or p.window_s))}
    if p.signal == "spans":
        value |= {"error_rate": F.lit(100.0) * bad / total, "avg": F.sum("duration_sum") / total, "sum": F.sum("duration_sum"), "min": F.min("duration_min"), "max": F.max("duration_max")}
    groups = own.groupBy(*keys).agg(total.alias("__n"), *(value[fn].alias(k) for k, (fn, _, _) in p.measures.items() if fn != "quantile"))
    quantiles = {k: R.hist_quantile(own, q, *keys) for k, (fn, _, q) in p.measures.items() if fn == "quantile"}
    return shares(p, aligned(groups, keys, quantiles, set()).select(*keys, *p.measures))


def shares(p: Panel, out: DataFrame) -> DataFrame:
    own = Window.partitionBy("at_ms") if p.seconds else Window.partitionBy(F.lit(0))  # groups of a panel, not rows
    return out.withColumns({k: F.lit(100.0) * c(k) / F.sum(k).over(own) for k, (fn, _, _) in p.measures.items() if fn == "share"})


def answered(p: Panel, rows: DataFrame, rollup: DataFrame, time: str = "start_us") -> DataFrame:
    """The panel from the rollup where that can answer it, else from the rows."""
    return over_rollup(p, rollup) if routable(p) else over_rows(p, rows, time)
