"""Publishing shortcuts: direction tag, pruning cell, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexweave.functions.cells import lca, parent, resolution

COLUMNS = ("from_edge", "to_edge", "cost", "via_edge", "inside", "cell")


def finalize(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_edge, to_edge, cost, via_edge, inside, cell) of the valid pairs.

    inside: -2 where only the outer cell is fine enough, else 0 lateral, -1 down, 1 up by the two segments'
    own resolutions. cell: the outer cell's ancestor at the coarser of those.
    """
    a = edges.select(F.col("id").alias("from_edge"), F.col("from_cell").alias("a_start"), F.col("to_cell").alias("a_end"), F.col("lca_res").alias("a_res"))
    b = edges.select(F.col("id").alias("to_edge"), F.col("from_cell").alias("b_start"), F.col("to_cell").alias("b_end"), F.col("lca_res").alias("b_res"))
    j = pairs.join(a, "from_edge", "left").join(b, "to_edge", "left")
    j = j.withColumns({"inner_res": resolution(lca("a_end", "b_start")), "outer_cell": lca("a_start", "b_end"), "need": F.greatest("a_res", "b_res")})
    j = j.filter((F.col("need") <= F.col("inner_res")) | (F.col("need") <= resolution("outer_cell")))
    return j.select("from_edge", "to_edge", "cost", "via_edge", direction().alias("inside"), parent("outer_cell", F.least("a_res", "b_res")).alias("cell"))


def direction() -> Column:
    return (
        F.when(F.col("need") > F.col("inner_res"), -2)
        .when(F.col("a_res") == F.col("b_res"), 0)
        .when(F.col("a_res") < F.col("b_res"), -1)
        .otherwise(1)
        .cast("byte")
    )
