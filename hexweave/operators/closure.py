"""Cheapest paths inside each cell: of all pairs, by joins or by a grouped kernel; and from given starts to given ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexweave.operators.reduce import changed, min_path
from hexweave.operators.sweeps import closed_matrix, costs_of, give_costs, swept
from hexweave.storage import Scope, cut

KEYS = ("from_edge", "to_edge", "current_cell")
SCHEMA = "from_edge long, to_edge long, cost double, via_edge long, current_cell long"
#: Arcs of a cell up to which a task can hold them, as many as a matrix has.
TASK_ARCS = 1 << 21
#: Pairs that a group of the kernel gives at most, unless one start has more; numbers in one of its matrices.
GROUP_PAIRS, MATRIX = 500_000, 1 << 21
#: Pairs of segments for an arc, up to which a cell is closed as a matrix.
DENSE = 8
#: Rows from which on a task hands over what it has found.
OUT_ROWS = 50_000


def usable_arcs(active: DataFrame) -> DataFrame:
    """What a closure may walk: finite costs, no self pairs, the cheapest of repeated pairs."""
    finite = active.filter(F.col("cost").isNotNull() & (F.col("cost") < float("inf")) & (F.col("from_edge") != F.col("to_edge")))
    return min_path(finite, *KEYS)


def extend(left: DataFrame, right: DataFrame) -> DataFrame:
    """One path step inside a cell: every row of `left` followed by every row of `right` that starts where it ends."""
    a, b = left.alias("a"), right.alias("b")
    on = (F.col("a.current_cell") == F.col("b.current_cell")) & (F.col("a.to_edge") == F.col("b.from_edge")) & (F.col("a.from_edge") != F.col("b.to_edge"))
    return a.join(b, on).select(
        "a.from_edge", "b.to_edge", (F.col("a.cost") + F.col("b.cost")).alias("cost"), F.col("a.to_edge").alias("via_edge"), "a.current_cell"
    )


def closure_join(active: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Semi-naive path doubling: only rows improved in a round are joined again, on either side, and a round writes one table.

    Ends when a round improves nothing; raises if that takes more than `max_rounds`.
    """
    with Scope() as own:
        state = cut(usable_arcs(active).withColumn("fresh", F.lit(True)))
        for done in range(max_rounds + 1):
            if state.filter("fresh").isEmpty():
                own.keep_only(state)
                return state.drop("fresh")
            if done == max_rounds:
                raise RuntimeError(f"paths still improve after {max_rounds} rounds")
            delta, found = state.filter("fresh"), extend(state.filter("fresh"), state)
            if done:  # at first all rows are fresh
                found = found.unionByName(extend(state.filter("NOT fresh"), delta))
            both = state.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True)))
            best = both.groupBy(*KEYS).agg(F.min(F.struct("cost", "fresh", "via_edge")).alias("best"))  # of equal costs the known one stays
            was, state = state, cut(best.select(*KEYS, "best.cost", "best.via_edge", "best.fresh"))
            own.keep_only(was, state)


def _relaxed(own: np.ndarray, n: int, f: np.ndarray, t: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost, segment before) of each start and each of n segments, over arcs (f, t, c) in the order of t.

    A round relaxes the arcs of segments that got cheaper for any start, for all starts at once. A segment's predecessor
    changes only where its cost falls, so predecessors have no cycles, free ones neither.
    """
    cost, before = np.full((len(own), n), np.inf), np.full((len(own), n), -1, np.int32)
    cost[np.arange(len(own)), own] = 0
    active = np.zeros(n, bool)
    active[own] = True
    while len(on := np.flatnonzero(active[f])):
        tried = cost[:, f[on]] + c[on]
        heads = np.flatnonzero(np.diff(t[on], prepend=-1))
        to, sizes = t[on][heads], np.diff(heads, append=len(on))
        best = np.minimum.reduceat(tried, heads, axis=1)
        better = best < cost[:, to]
        least = np.minimum.reduceat(np.where(tried == np.repeat(best, sizes, axis=1), f[on].astype(np.int32), n), heads, axis=1)
        cost[:, to] = np.where(better, best, cost[:, to])
        before[:, to] = np.where(better, least, before[:, to])
        active[:] = False
        active[to[better.any(0)]] = True
    return cost, before


def _block_paths(arcs: dict[str, np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Cheapest paths of one cell from a block of its starts: columns of from_edge, to_edge, cost and via_edge, for every few starts.
    A cell most of whose pairs are arcs, as those of coarse levels, is closed as one matrix."""
    ids = np.unique(np.concatenate([arcs["from_edge"], arcs["to_edge"]]))
    f, t = np.searchsorted(ids, arcs["from_edge"]), np.searchsorted(ids, arcs["to_edge"])
    order = np.lexsort((f, t))
    f, t, c, via = f[order], t[order], arcs["cost"][order], arcs["via_edge"][order]
    direct = t * len(ids) + f
    starts = np.unique(f)[arcs["block"][0] :: arcs["blocks"][0]]
    if len(ids) ** 2 <= min(MATRIX, DENSE * len(c)):
        cost = np.full((len(ids), len(ids)), np.inf)
        cost[f, t] = c
        way = closed_matrix(cost)
        np.fill_diagonal(cost, np.inf)
        row, to = np.nonzero(np.isfinite(cost[starts]))
        start = starts[row]
        arc = np.minimum(np.searchsorted(direct, to * len(ids) + start), len(via) - 1)
        yield [ids[start], ids[to], cost[start, to], np.where(way[start, to] < 0, via[arc], ids[way[start, to]])]
        return
    step = max(1, MATRIX // max(len(c), len(ids)))
    for lo in range(0, len(starts), step):
        own = starts[lo : lo + step]
        cost, before = _relaxed(own, len(ids), f, t, c)
        cost[np.arange(len(own)), own] = np.inf
        row, to = np.nonzero(np.isfinite(cost))
        last, start = before[row, to], own[row]
        arc = np.searchsorted(direct, to * len(ids) + start)
        middle = np.where(last == start, via[np.minimum(arc, len(via) - 1)], ids[last])
        yield [ids[start], ids[to], cost[row, to], middle]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The arcs of each block of a cell, whose rows come one after another."""
    held: list[dict[str, np.ndarray]] = []

    def whole() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for b in batches:
        if not b.num_rows:
            continue
        rows = {c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(b.schema.names)}
        cell, block = rows["current_cell"], rows["block"]
        ends = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1])) + 1
        if held and (held[-1]["current_cell"][-1], held[-1]["block"][-1]) != (cell[0], block[0]):
            yield whole()
            held = []
        for lo, hi in zip([0, *ends], [*ends, b.num_rows]):
            held.append({c: x[lo:hi] for c, x in rows.items()})
            if hi < b.num_rows:
                yield whole()
                held = []
    if held:
        yield whole()


def _group_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of the blocks in a task, the small ones together: a batch has OUT_ROWS rows or those of one more few starts."""
    made, n = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made)], names=["from_edge", "to_edge", "cost", "via_edge", "current_cell"])

    for arcs in _groups(batches):
        for columns in _block_paths(arcs):
            made.append([*columns, np.full(len(columns[0]), arcs["current_cell"][0])])
            n += len(columns[0])
            if n >= OUT_ROWS:
                yield batch()
                made, n = [], 0
    if made:
        yield batch()


def _by_blocks(dealt: DataFrame) -> DataFrame:
    """Paths of arcs that are dealt to blocks of cells. Blocks are many and small, so they go to Python by the task, not one by one.

    Arcs without a cell take part in none; one without a middle segment is taken as direct."""
    dealt = dealt.filter("current_cell IS NOT NULL").withColumn("via_edge", F.coalesce("via_edge", "to_edge"))
    return dealt.repartition("current_cell", "block").sortWithinPartitions("current_cell", "block").mapInArrow(_group_paths, SCHEMA)


def closure_grouped(active: DataFrame, most_arcs: int = TASK_ARCS, pairs: int = GROUP_PAIRS) -> DataFrame:
    """The same closure by relaxations over arrays. A cell's starts are dealt to blocks, each with all arcs of the cell, so
    that no block gives more than `pairs` pairs; cells of more than `most_arcs` arcs go by joins."""
    arcs = cut(usable_arcs(active))
    cells = arcs.groupBy("current_cell").agg(F.count("*").alias("arcs"), (F.count_distinct("from_edge") * F.count_distinct("to_edge")).alias("pairs"))
    cells = cells.select("current_cell", "arcs", F.ceil(F.col("pairs") / pairs).cast("int").alias("blocks"))
    most = cells.agg(F.max("arcs").alias("arcs"), F.max("blocks").alias("blocks")).first()
    if not most.arcs or most.arcs <= most_arcs and most.blocks == 1:  # a block a cell
        return arcs.select("*", F.lit(1).alias("blocks"), F.lit(0).alias("block")).transform(_by_blocks)
    cells = cut(cells)
    sized = arcs.join(cells.filter(F.col("arcs") <= most_arcs).select("current_cell", "blocks"), "current_cell")
    dealt = sized.select(*arcs.columns, "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    grouped = _by_blocks(dealt)
    large = cells.filter(F.col("arcs") > most_arcs).select("current_cell")
    if most.arcs <= most_arcs:
        return grouped
    return grouped.unionByName(closure_join(arcs.join(large, "current_cell", "left_semi")))


def closure_auto(active: DataFrame, group_arcs: int = TASK_ARCS) -> DataFrame:
    """The grouped kernel for cells of at most `group_arcs` arcs, which are all that a task can hold, joins for the others: a join makes a
    row for each way through each segment of a cell, an array needs none."""
    return closure_grouped(active, group_arcs)


def _one_cell(base: DataFrame) -> DataFrame:
    return cut(usable_arcs(base.select("from_edge", "to_edge", "cost", "via_edge", F.lit(0).cast("long").alias("current_cell"))))


def closure_whole(base: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(from_edge, to_edge, cost): the closure of a network that is one cell, of distinct `pairs` alone where there are some, by
    sweeps; by joins, all pairs, where it has more than TASK_ARCS arcs."""
    arcs = _one_cell(base)
    if arcs.count() > TASK_ARCS:
        return closure_join(arcs).select("from_edge", "to_edge", "cost")
    return swept(arcs, give_costs, "from_edge long, to_edge long, cost double") if pairs is None else costs_of(arcs, pairs)


KERNELS = {"join": closure_join, "grouped": closure_grouped, "auto": closure_auto}


def paths_between(base: DataFrame, starts: DataFrame, ends: DataFrame | None = None, limit: float = float("inf"), max_rounds: int = 10_000) -> DataFrame:
    """(from_edge, to_edge, cost, via_edge): cheapest paths of at most `limit` from each edge of `starts` to each of `ends`
    (all where there are none), over the direct pairs of `base`. via_edge is the segment before the end, or the end itself.

    Only rows of the starts are extended, by one arc a round where they got cheaper. With ends, each segment first
    learns how far its nearest end is, from the ends backwards, and a path that cannot reach one within the limit is given up.
    """
    arcs = cut(usable_arcs(base.select("from_edge", "to_edge", "cost", "via_edge", F.lit(0).cast("long").alias("current_cell"))).select("from_edge", "to_edge", "cost"))
    if ends is not None:
        ends = cut(ends.select(F.col("edge").cast("long").alias("to_edge")).distinct())
        back = ends.select(F.col("to_edge").alias("edge"), F.lit(0.0).alias("cost"), "to_edge")
        turned = arcs.select(F.col("to_edge").alias("edge"), F.col("from_edge").alias("further"), F.col("cost").alias("by"))
        nearest = _expanded(back.select("edge", "cost", F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("via_edge")), turned, limit, max_rounds)
        rest = cut(nearest.select("edge", F.col("cost").alias("rest")))
    else:
        rest = None
    first = starts.select(F.col("edge").cast("long").alias("edge")).distinct()
    if rest is not None:
        first = first.join(rest, "edge", "left_semi")
    onward = arcs.select(F.col("from_edge").alias("edge"), F.col("to_edge").alias("further"), F.col("cost").alias("by"))
    rows = _expanded(first.select("edge", F.lit(0.0).alias("cost"), F.col("edge").alias("key"), F.col("edge").alias("via_edge")), onward, limit, max_rounds, rest)
    rows = rows.filter("key <> edge").select(F.col("key").alias("from_edge"), F.col("edge").alias("to_edge"), "cost", F.when(F.col("via_edge") == F.col("key"), F.col("edge")).otherwise(F.col("via_edge")).alias("via_edge"))
    return rows if ends is None else rows.join(ends, "to_edge", "left_semi").select("from_edge", "to_edge", "cost", "via_edge")


def _expanded(seeds: DataFrame, arcs: DataFrame, limit: float, max_rounds: int, rest: DataFrame | None = None) -> DataFrame:
    """(edge, cost, key, via_edge): least cost of each edge and key, by rounds of one arc (edge, further, by) from the seeds."""
    with Scope() as own:
        known = delta = cut(seeds)
        for _ in range(max_rounds):
            found = delta.join(arcs, "edge").select(F.col("further").alias("edge"), (F.col("cost") + F.col("by")).alias("cost"), "key", F.col("edge").alias("via_edge")).filter(F.col("cost") <= limit)
            if rest is not None:
                found = found.join(rest, "edge").filter(F.col("cost") + F.col("rest") <= limit).drop("rest")
            was = known, delta
            delta = cut(changed(known, min_path(found, "edge", "key"), "edge", "key").select(known.columns))
            if delta.isEmpty():
                own.keep_only(known)
                return known
            known = cut(min_path(known.unionByName(delta), "edge", "key").select(known.columns))
            own.keep_only(*was, known, delta)
        raise RuntimeError(f"paths still improve after {max_rounds} rounds")
