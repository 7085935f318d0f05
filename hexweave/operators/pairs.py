"""What a pair of segments needs for its place in the hierarchy."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexweave.functions.cells import lca, parent, resolution

PLACE = ("lca_res", "inner_cell", "outer_cell", "inner_res", "outer_res")


def enrich(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds the place columns. They depend on the pair alone, so this runs once for a pair, not once a level.

    lca_res: the coarser need of both segments. inner: between the end of A and the start of B, outer: between
    the start of A and the end of B. A direct pair meets in one cell, so its inner resolution is that cell's.
    Unknown segments give nulls, which no level takes.
    """
    a = edges.select(F.col("id").alias("from_edge"), F.col("from_cell").alias("a_start"), F.col("to_cell").alias("a_end"), F.col("lca_res").alias("a_res"))
    b = edges.select(F.col("id").alias("to_edge"), F.col("from_cell").alias("b_start"), F.col("to_cell").alias("b_end"), F.col("lca_res").alias("b_res"))
    joined = pairs.join(a, "from_edge", "left").join(b, "to_edge", "left")
    placed = joined.withColumns(
        {
            "lca_res": F.greatest("a_res", "b_res"),
            "inner_cell": lca("a_end", "b_start"),
            "outer_cell": lca("a_start", "b_end"),
        }
    )
    placed = placed.withColumns(
        {
            "inner_res": resolution("inner_cell"),
            "outer_res": resolution("outer_cell"),
        }
    )
    return placed.select(*pairs.columns, *PLACE)


def assign_cells(placed: DataFrame, level: int) -> DataFrame:
    """Rows for the cells of one level in which a pair takes part: one scan, and one row where both cells agree."""
    def at(side: str) -> F.Column:
        usable = (F.col("lca_res") <= level) & (F.col(f"{side}_res") >= level)
        return F.when(usable, parent(f"{side}_cell", level))

    cells = F.array_distinct(F.array_compact(F.array(at("inner"), at("outer"))))
    return placed.select("from_edge", "to_edge", "cost", "via_edge", F.explode(cells).alias("current_cell"))


class Level(NamedTuple):
    """What takes part at a level: rows, cells, a fingerprint of the pairs, rows of the largest cell, and about how many
    pairs its cells give if each start reaches each end."""

    level: int
    active: int
    cells: int
    mark: int
    largest: int
    expected: int


def level_profile(placed: DataFrame) -> dict[int, Level]:
    """The levels at which pairs take part; at most 17 rows reach the driver.

    Two neighbouring levels with the same rows, cells and fingerprint deal the same pairs into the same cells.
    """
    sides = F.array(*[F.struct(F.col(f"{s}_cell").alias("cell"), F.col(f"{s}_res").alias("res"), F.lit(s).alias("side")) for s in ("inner", "outer")])
    taking = placed.select("from_edge", "to_edge", "lca_res", F.explode(sides).alias("at")).filter(F.col("lca_res") <= F.col("at.res"))
    spread = taking.select("from_edge", "to_edge", "at.side", "at.cell", F.explode(F.sequence("lca_res", F.col("at.res"))).alias("level"))
    ends = F.approx_count_distinct("from_edge", 0.1) * F.approx_count_distinct("to_edge", 0.1)
    cells = spread.groupBy("level", parent("cell", F.col("level")).alias("held")).agg(
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(from_edge, to_edge, side))").alias("x"), ends.alias("pairs")
    )
    sums = F.sum("n").alias("n"), F.count("*").alias("cells"), F.expr("bit_xor(x)").alias("x"), F.max("n").alias("largest"), F.sum("pairs").alias("pairs")
    return {r.level: Level(*r) for r in cells.groupBy("level").agg(*sums).collect()}
