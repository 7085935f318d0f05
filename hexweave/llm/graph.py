"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexweave.storage import cut


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node with a link: the least node that it reaches.

    Each node points at a lesser one. A round lets a node, and the node that it points at, point at the least node two
    steps from its neighbours, and skips a step of its own, so the rounds grow with the logarithm of a component's
    width. Rows meet a hub by plain joins of written tables, which adaptive execution splits, and by partial
    aggregates, so a hub does not gather in one task. Raises where `max_rounds` do not settle it.
    """
    both = cut(links.select(F.col(a).alias("node"), F.col(b).alias("next")).unionByName(links.select(F.col(b).alias("node"), F.col(a).alias("next"))).distinct())
    labels = cut(both.groupBy("node").agg(F.min("next").alias("next")).select("node", F.least("node", "next").alias("component")))
    for _ in range(max_rounds):
        of = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        twice = cut(labels.join(of, "component").select("node", "component", "further"))
        near = both.join(twice.select(F.col("node").alias("next"), F.col("further").alias("near")), "next").groupBy("node").agg(F.min("near").alias("near"))
        found = cut(twice.join(near, "node").select("node", "component", F.least("further", "near").alias("least")))
        told = found.groupBy("component").agg(F.min("least").alias("told")).select(F.col("component").alias("node"), "told")
        moved = found.join(told, "node", "left").select("node", F.least("least", F.coalesce("told", "least")).alias("component"), F.col("component").alias("was"))
        moved = cut(moved)
        labels = moved.select("node", "component")
        if moved.filter("component < was").isEmpty():
            return labels
    raise RuntimeError(f"labels still move after {max_rounds} rounds")
