"""Keeping the cheapest path of each pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def min_path(paths: DataFrame, *keys: str) -> DataFrame:
    """One row a key: the least cost, and of equal costs the least via. Rows without a cost never win."""
    best = F.min(F.struct("cost", "via_edge")).alias("best")
    return paths.filter(F.col("cost").isNotNull()).groupBy(*keys).agg(best).select(*keys, "best.cost", "best.via_edge")


def merge_min(main: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two path tables, the cheapest row of each (from_edge, to_edge)."""
    cols = ["from_edge", "to_edge", "cost", "via_edge"]
    return min_path(main.select(cols).unionByName(new.select(cols)), "from_edge", "to_edge").select(cols)


def changed(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of `new` that are absent from `old` or cheaper there."""
    was = old.select(*keys, F.col("cost").alias("was"))
    return new.join(was, list(keys), "left").filter(F.col("was").isNull() | (F.col("cost") < F.col("was"))).drop("was")
