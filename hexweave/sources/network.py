"""Road-network inputs: directed segments with cells, and which segment follows which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexweave.functions.cells import inside, lca_resolution, position

EDGE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("from_cell", T.LongType()),
        T.StructField("to_cell", T.LongType()),
        T.StructField("lca_res", T.IntegerType()),
        T.StructField("length", T.DoubleType()),
        T.StructField("maxspeed", T.DoubleType()),
    ]
)
GRAPH_SCHEMA = T.StructType([T.StructField("from_edge", T.LongType()), T.StructField("to_edge", T.LongType())])


def _read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """By header names, so other columns and another column order do no harm; no inference pass."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    missing = set(schema.names) - set(raw.columns)
    if missing:
        raise ValueError(f"{path} has no column {', '.join(sorted(missing))}")
    return raw.select([F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in schema])


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header line, as load_edges and load_graph read it."""
    rows.write.option("header", True).csv(path)


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    """Segments of a CSV file or folder, with their costs: one scan for both."""
    return with_cost(_read_csv(spark, path, EDGE_SCHEMA))


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    """Successor pairs (from_edge, to_edge) of a CSV file or folder."""
    return _read_csv(spark, path, GRAPH_SCHEMA)


def with_cost(edges: DataFrame) -> DataFrame:
    """Seconds along a segment; infinite where its speed is not above 0, null where length or speed is."""
    cost = F.when(F.col("maxspeed") > 0, F.col("length") / F.when(F.col("maxspeed") > 0, F.col("maxspeed")))
    return edges.withColumn(
        "cost", cost.otherwise(F.when(F.col("maxspeed").isNotNull(), F.lit(float("inf")))).cast("double")
    )


def grid_network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A one-way street grid with a node for each supplier: (edges with cost and end nodes, graph).

    A side may have 2 ** 15 nodes, as cells have 15 digits.
    """
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("i"))
    side = supplier.agg(F.ceil(F.sqrt(F.count("*"))).cast("long").alias("w"))
    node = supplier.crossJoin(F.broadcast(side)).select(  # one row on the right
        "i", "w", (F.col("i") % F.col("w")).alias("x"), F.floor(F.col("i") / F.col("w")).cast("long").alias("y")
    )
    cell = F.lit((1 << 59) + (15 << 52)) + F.when(4 * F.col("y") >= 3 * F.col("w"), F.lit(21 << 45)).otherwise(F.lit(20 << 45))
    bits = F.greatest(F.lit(5), F.length(F.bin(F.col("w") - 1)))  # digits of a cell: as many as the side needs

    def with_digit(so_far: Column, k: Column) -> Column:
        x, y = (F.call_function("shiftright", F.col(c), bits - k).bitwiseAND(1) for c in "xy")
        return so_far + F.call_function("shiftleft", x + 2 * y, 3 * (15 - k))

    cell = F.aggregate(F.sequence(F.lit(1), bits), cell, with_digit)
    node = node.withColumn("cell", cell)
    turn = F.explode(
        F.array(*[F.struct(F.lit(d).alias("dir"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for d, (dx, dy) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])])
    )
    step = node.select("*", turn.alias("t")).select("i", "w", "x", "y", "cell", "t.dir", (F.col("x") + F.col("t.dx")).alias("nx"), (F.col("y") + F.col("t.dy")).alias("ny"))
    step = step.filter((F.col("nx") >= 0) & (F.col("nx") < F.col("w")) & (F.col("ny") >= 0) & ((7 * F.col("x") + 3 * F.col("y") + F.col("dir")) % 5 != 0))
    step = step.withColumn("to_node", F.col("ny") * F.col("w") + F.col("nx"))
    ends = node.select(F.col("i").alias("to_node"), F.col("cell").alias("to_cell"))
    edges = step.join(ends, "to_node").select(
        (4 * F.col("i") + F.col("dir")).alias("id"),
        F.col("cell").alias("from_cell"),
        "to_cell",
        lca_resolution("cell", "to_cell").alias("lca_res"),
        (8 * (1 + (13 * F.col("x") + 7 * F.col("y") + 5 * F.col("dir")) % 16)).cast("double").alias("length"),
        F.pow(F.lit(2.0), (F.col("x") + F.col("y") + F.col("dir")) % 4).alias("maxspeed"),
        F.col("i").alias("from_node"),
        "to_node",
    )
    edges = with_cost(edges)
    graph = edges.select(F.col("id").alias("from_edge"), "to_node").join(
        edges.select(F.col("id").alias("to_edge"), F.col("from_node").alias("to_node")), "to_node"
    )
    return edges, graph.select("from_edge", "to_edge")


def base_pairs(edges: DataFrame, graph: DataFrame) -> DataFrame:
    """A shortcut for each distinct successor pair: cost of its first segment, direct (via its end).

    A pair whose first segment is unknown has a null cost.
    """
    cost = edges.select(F.col("id").alias("from_edge"), "cost")
    return (
        graph.select("from_edge", "to_edge").distinct().join(cost, "from_edge", "left")
        .select("from_edge", "to_edge", "cost", F.col("to_edge").alias("via_edge"))
    )


def audit_input(edges: DataFrame, graph: DataFrame) -> DataFrame:
    """Counts of input faults: (fault, n). Ids and cells that a CSV file spells wrongly are null here."""
    by_edge = {
        "null_id": F.col("id").isNull(),
        "null_cell": F.col("from_cell").isNull() | F.col("to_cell").isNull(),
        "null_cost": F.col("length").isNull() | F.col("maxspeed").isNull(),
        "impassable": F.col("maxspeed") <= 0,
        "wrong_lca_res": ~F.col("lca_res").eqNullSafe(lca_resolution("from_cell", "to_cell")),
    }
    by_pair = {
        "null_pair": F.col("from_edge").isNull() | F.col("to_edge").isNull(),
        "unknown_from_edge": F.col("from_edge").isNotNull() & F.col("a").isNull(),
        "unknown_to_edge": F.col("to_edge").isNotNull() & F.col("b").isNull(),
        "self_pair": F.col("from_edge") == F.col("to_edge"),
    }
    ids = edges.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("times"))
    known = ids.select("id")
    pairs = graph.join(known.withColumnRenamed("id", "a"), F.col("a") == F.col("from_edge"), "left").join(known.withColumnRenamed("id", "b"), F.col("b") == F.col("to_edge"), "left")
    counted = [_counts(edges, by_edge), _counts(ids, {"repeated_id": F.col("times") > 1}), _counts(pairs, by_pair)]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def _counts(rows: DataFrame, faults: dict[str, Column]) -> DataFrame:
    """(fault, n) of each condition, by one aggregate."""
    all_ = rows.agg(*[F.count_if(c).alias(name) for name, c in faults.items()])
    return all_.select(F.explode(F.array(*[F.struct(F.lit(name).alias("fault"), F.col(name).alias("n")) for name in faults])).alias("x")).select("x.fault", "x.n")


#: A column of written tables alone: the pruning cell's position.
POSITION = "cell_position"


def write_shortcuts(shortcuts: DataFrame, path: str) -> None:
    """As Parquet in the order of pruning cells' positions, so that row groups prune on a cell with its descendants, and with
    bloom filters of both ends, so that they prune on a pair."""
    placed = shortcuts.withColumn(POSITION, position("cell"))
    writer = placed.repartitionByRange(POSITION, "from_edge").sortWithinPartitions(POSITION, "from_edge").write.mode("overwrite")
    for end in ("from_edge", "to_edge"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{end}", "true").option(f"parquet.enable.dictionary#{end}", "false")
    writer.parquet(path)


def read_shortcuts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(POSITION)


def shortcuts_inside(spark: SparkSession, path: str, cell: int) -> DataFrame:
    """The written shortcuts whose pruning cell is `cell` or lies in it, by one range of positions."""
    return spark.read.parquet(path).filter(inside(POSITION, cell)).drop(POSITION)


def lookup(spark: SparkSession, path: str, pairs: list[tuple[int, int]]) -> DataFrame:
    """The written shortcuts of these pairs (from_edge, to_edge), some few."""
    any_of = F.lit(False)
    for a, b in pairs:
        any_of = any_of | ((F.col("from_edge") == a) & (F.col("to_edge") == b))
    ends = F.col("from_edge").isin([a for a, _ in pairs]) & F.col("to_edge").isin([b for _, b in pairs])
    return read_shortcuts(spark, path).filter(ends & any_of)
