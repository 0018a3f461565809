"""Authors' SQL with the dashboard's window: two macros become named parameters, Spark parses, checks and plans the rest."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

COLUMN = r"\(\s*([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)?)\s*\)"


def expanded(text: str) -> str:
    """``$__window(column)`` is the window over a column in microseconds, ``$__bucket(column)`` its bucket's start; a panel needs its window."""
    if not re.search(r"\$__window" + COLUMN, text):
        raise ValueError("a panel filters time by $__window(column)")
    text = re.sub(r"\$__window" + COLUMN, r"(\1 >= :from_us AND \1 < :to_us)", text)
    text = re.sub(r"\$__bucket" + COLUMN, r"(floor(\1 / :width_us) * :width_us)", text)
    if unknown := re.search(r"\$__\w+", text):
        raise ValueError(f"unknown macro {unknown[0]}; there are $__window(column) and $__bucket(column)")
    return text


def panel(spark: SparkSession, text: str, views: dict[str, DataFrame], start_us: int, end_us: int, seconds: int = 60, **values) -> DataFrame:
    """The author's query over named relations; ``values`` are the dashboard's variables, as parameters."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(expanded(text), args={"from_us": start_us, "to_us": end_us, "width_us": seconds * 1_000_000} | values)
