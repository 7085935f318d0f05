"""Arithmetic on 64-bit hexagonal cell ids as native column expressions.

A cell id keeps its resolution in bits 52-55, its base cell in bits 45-51 and one
3-bit digit per resolution below (digit i at bit 3 * (15 - i); unused digits are 7).
Cell 0 stands for the whole world, at resolution -1. A null cell gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MAX_RES = 15
GLOBAL_CELL = 0
GLOBAL_RES = -1

_DIGIT_BITS = 45
_RES_SHIFT = 52
_CLEAR_RES = ~(15 << _RES_SHIFT)


def _long(x: Column | int | str) -> Column:
    return (F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x).cast("long")


def resolution(cell: Column | str) -> Column:
    """Resolution 0..15 of a cell; -1 for the global cell."""
    c = _long(cell)
    return F.when(c == 0, F.lit(GLOBAL_RES)).otherwise(F.shiftright(c, _RES_SHIFT).bitwiseAND(15).cast("int"))


def base_cell(cell: Column | str) -> Column:
    return F.shiftright(_long(cell), _DIGIT_BITS).bitwiseAND(127).cast("int")


def parent(cell: Column | str, res: Column | int) -> Column:
    """Ancestor at resolution `res`: the global cell below 0, the cell itself where it is coarser than `res`."""
    c, r = _long(cell), _long(res)
    unused = F.call_function("shiftleft", F.lit(1).cast("long"), (3 * (MAX_RES - r)).cast("int")) - 1
    at = c.bitwiseAND(_CLEAR_RES).bitwiseOR(F.call_function("shiftleft", r, F.lit(_RES_SHIFT))).bitwiseOR(unused)
    return F.when((c == 0) | (r < 0), F.lit(0).cast("long")).when(r > resolution(c), c).otherwise(at)


def lca_resolution(a: Column | str, b: Column | str) -> Column:
    """Resolution of the finest cell that holds both; -1 across base cells."""
    a, b = _long(a), _long(b)
    differing = a.bitwiseXOR(b).bitwiseAND((1 << _DIGIT_BITS) - 1)
    top_digit = F.floor((F.length(F.bin(differing)) - 1) / F.lit(3)).cast("int")
    finest = F.least(resolution(a), resolution(b))
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("int"))
        .when((a == 0) | (b == 0) | (base_cell(a) != base_cell(b)), F.lit(GLOBAL_RES))
        .when(differing == 0, finest)
        .otherwise(F.least(finest, F.lit(MAX_RES - 1) - top_digit))
    )


def lca(a: Column | str, b: Column | str) -> Column:
    """The finest common ancestor of two cells; the global cell where there is none."""
    return parent(a, lca_resolution(a, b))


def contains(outer: Column | str, inner: Column | str) -> Column:
    """Whether `outer` is `inner` or one of its ancestors; the global cell contains all."""
    return parent(inner, resolution(outer)) == _long(outer)


def position(cell: Column | str) -> Column:
    """A cell without its resolution bits: a key in whose order a cell's descendants stand together, the cell itself last."""
    return _long(cell).bitwiseAND(_CLEAR_RES)


def inside(place: Column | str, outer: Column | int) -> Column:
    """Whether a cell of this position is `outer` or one of its descendants: one range, which a scan can push down.

    The unused digits of a cell are 7, which no descendant has; so its range runs from its own digits and zeros to itself.
    """
    c, p = _long(outer), F.col(place) if isinstance(place, str) else place
    free = F.call_function("shiftleft", F.lit(1).cast("long"), (3 * (MAX_RES - resolution(c))).cast("int")) - 1
    low = F.when(c == 0, F.lit(-(1 << 63))).otherwise(position(c).bitwiseAND(F.bitwise_not(free)))
    high = F.when(c == 0, F.lit((1 << 63) - 1)).otherwise(position(c))
    return p.between(low, high)


#: SQL bodies of the functions of cells, by name and parameters; those further down use those before.
SQL_FUNCTIONS = {
    "cell_resolution(cell BIGINT) RETURNS INT": "CASE WHEN cell = 0 THEN -1 ELSE CAST(shiftright(cell, 52) & 15 AS INT) END",
    "cell_base(cell BIGINT) RETURNS INT": "CAST(shiftright(cell, 45) & 127 AS INT)",
    "cell_parent(cell BIGINT, res INT) RETURNS BIGINT": f"CASE WHEN cell = 0 OR res < 0 THEN 0 WHEN res > cell_resolution(cell) THEN cell ELSE (cell & {_CLEAR_RES}) | shiftleft(CAST(res AS BIGINT), 52) | (shiftleft(1L, 3 * (15 - res)) - 1) END",
    "cell_lca_resolution(a BIGINT, b BIGINT) RETURNS INT": f"CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a = 0 OR b = 0 OR cell_base(a) <> cell_base(b) THEN -1 WHEN (a ^ b) & {(1 << 45) - 1} = 0 THEN least(cell_resolution(a), cell_resolution(b)) ELSE least(cell_resolution(a), cell_resolution(b), 14 - CAST(floor((length(bin((a ^ b) & {(1 << 45) - 1})) - 1) / 3) AS INT)) END",
    "cell_lca(a BIGINT, b BIGINT) RETURNS BIGINT": "cell_parent(a, cell_lca_resolution(a, b))",
    "cell_contains(outer_cell BIGINT, cell BIGINT) RETURNS BOOLEAN": "cell_parent(cell, cell_resolution(outer_cell)) = outer_cell",
}


def register(spark: SparkSession) -> None:
    """The functions of cells for SQL in this session, as SQL that the optimizer puts in their place."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
