"""Rollups over streams: each micro-batch recomputes the hours it touches, however late its rows are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkobs.operators import graph as G
from sparkobs.operators import rollups as R
from sparkobs.sources import dataset

KEY = ["namespace", "bucket_ms", "service"]


def stored(rows: DataFrame, root: str, order: list[str], width: int = 1) -> None:
    """Rewrites the hours of a rollup's rows (by bucket_ms) under ``root``; writing a batch again changes nothing.

    What is rewritten is a block of ``width`` hours, whose rows must all be there: a rollup of few rows an hour over a long
    time is one file a block, not one an hour. A root keeps its width."""
    dataset.replace(rows.withColumn("bucket_us", F.col("bucket_ms") * 1000), root, "bucket_us", order, width)


def current(spark, root: str) -> DataFrame:
    """The rollup as it stands: every hour, or block of hours, has one version."""
    return spark.read.parquet(root).drop("hour", "bucket_us")


def job(stream: DataFrame, repair: Callable[[DataFrame], None], checkpoint: str):
    """Starts a job that hands each batch of new rows to ``repair``; what is there is caught up in batches and then it ends."""
    return stream.writeStream.foreachBatch(lambda new, _: repair(new)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def service_rollup(stream: DataFrame, base: Callable[[], tuple[DataFrame, DataFrame]], root: str, checkpoint: str, width: int = 1):
    """``stream`` brings new spans, ``base`` reads all spans and logs so far; ``width`` hours are recomputed and stored together."""

    def repair(new: DataFrame) -> None:
        hours, (spans, logs) = R.touched(new, "start_us", width), base()
        stored(R.service_rollup(R.in_hours(spans, hours, "start_us", width), R.in_hours(logs, hours, "time_us", width)), root, KEY, width)

    return job(stream, repair, checkpoint)


def edge_rollup(stream: DataFrame, base: Callable[[], DataFrame], root: str, checkpoint: str, width: int = 1):
    """Call edges: a late parent repairs the hours of its children, a late child its own; ``width`` hours go together."""

    def repair(new: DataFrame) -> None:
        spans = base()
        hours = G.edge_hours(new, spans, width)
        stored(G.call_edges(R.in_hours(spans, hours, "start_us", width), parents=spans), root, ["namespace", "bucket_ms", "caller", "callee"], width)

    return job(stream, repair, checkpoint)


def windowed(stream: DataFrame, time: str = "ts", width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts and error shares by tumbling window and type, for streams that may drop what is later than ``late``."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
