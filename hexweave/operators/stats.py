"""Frequency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(column, n, percent), by value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (100.0 * F.col("n") / F.col("total")).alias("percent")).orderBy(column)  # one row on the right


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)
