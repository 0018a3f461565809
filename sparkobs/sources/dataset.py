"""Signals at rest: Parquet by hour (and by what else is asked for by equality), sorted, read through partition filters.

Files, listing, pruning and commits are Spark's own. A busy hour is cut into ranges of its sort order, so that no task
writes an hour whole; each range has its own file with narrow footer bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def write(df: DataFrame, root: str, time: str, order: list[str], by: tuple[str, ...] = ()) -> None:
    """Adds the rows of ``df`` under ``root``, by hour of ``time`` and by the columns ``by``, sorted by ``order`` within a file."""
    keys = [*by, "hour"]
    hours = df.withColumn("hour", F.floor(F.col(time) / HOUR_US).cast("long"))
    hours.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).write.mode("append").partitionBy(*keys).parquet(root)


def first_hour(time: Column, width: int = 1) -> Column:
    """The first hour of the block of ``width`` hours that holds a time."""
    return (F.floor(time / (HOUR_US * width)) * width).cast("long")


def replace(df: DataFrame, root: str, time: str, order: list[str], width: int = 1) -> None:
    """Rewrites the hours (or blocks of ``width`` hours, one width for a root) that ``df`` has rows in, and no others."""
    hours = df.withColumn("hour", first_hour(F.col(time), width))
    hours.repartitionByRange("hour", *order).sortWithinPartitions("hour", *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour").parquet(root)


def read(spark: SparkSession, root: str, time: str, start_us: int | None = None, end_us: int | None = None, width: int = 1) -> DataFrame:
    """Rows of a window: hours (or blocks of the root's ``width``) outside are never listed, the rest is pushed to the files. Filters on other partition columns prune as well."""
    own = spark.read.parquet(root)
    if start_us is not None:
        own = own.where((F.col("hour") >= start_us // (HOUR_US * width) * width) & (F.col(time) >= start_us))
    if end_us is not None:
        own = own.where((F.col("hour") <= (end_us - 1) // HOUR_US) & (F.col(time) < end_us))
    return own.drop("hour")
