"""Exact quantiles of very large groups: counts by fine bins say which bins hold the ranks asked for, and only those are sorted.

``percentile`` keeps a group's distinct values in one task; that is right for a minute of a service. Here the first pass
aggregates mergeable counts, and the second sorts a bin of about a hundredth of a doubling, which spills if it must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
FINE, FAR = 64, 100_000  # bins for each doubling; beyond the bin of any double


def bin_of(x: Column) -> Column:
    """A bin that grows with ``x``, signs included."""
    size = F.floor(F.log2(F.abs(x)) * FINE) + FAR
    return F.when(x > 0, size).when(x < 0, -size).otherwise(0).cast("int")


def narrowed(df: DataFrame, by: list[str], field: str, qs: dict[str, float]) -> DataFrame:
    """``by`` and a column for each of ``qs``, linear between ranks; groups without values are left out."""
    own = df.select(*by, c(field).cast("double").alias("x")).where("x is not null and not isnan(x)").withColumn("bin", bin_of(c("x")))
    every = Window.partitionBy(*by)
    bins = own.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n")).withColumns({"end": F.sum("n").over(every.orderBy("bin")), "total": F.sum("n").over(every)})
    at = lambda q: F.lit(q) * (c("total") - 1)
    ranks = [F.struct(F.lit(k).alias("name"), side(at(q)).cast("long").alias("rank"), weight.alias("weight")) for k, q in qs.items() for side, weight in ((F.floor, 1 - (at(q) - F.floor(at(q)))), (lambda p: F.floor(p) + 1, at(q) - F.floor(at(q))))]
    asked = bins.withColumn("w", F.explode(F.array(*ranks))).where((c("w.weight") > 0) & (c("w.rank") >= c("end") - c("n")) & (c("w.rank") < c("end")))
    asked = asked.select(*by, "bin", (c("w.rank") - (c("end") - c("n")) + 1).alias("r"), "w.name", "w.weight")
    same = lambda a, b, keys: [a[k].eqNullSafe(b[k]) for k in keys]
    kept = asked.select(*by, "bin").distinct()
    rows = own.join(kept, same(own, kept, [*by, "bin"]), "left_semi")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*by, "bin").orderBy("x")))
    met = rows.join(asked, same(rows, asked, [*by, "bin", "r"])).select(*(rows[k] for k in by), "x", "name", "weight")
    return met.groupBy(*by).agg(*(F.sum(F.when(c("name") == k, c("x") * c("weight"))).alias(k) for k in qs))
