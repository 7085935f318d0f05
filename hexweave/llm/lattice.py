"""Near-duplicate vectors by hashing to points of the E8 lattice.

Each of TABLES tables projects a unit vector at random to BLOCKS times 8 coordinates and decodes each 8 to the nearest
point of E8; the points together are a cell. A vector stands in its own cell and looks into PROBES neighbouring ones:
those with the least distance among cells one step of one block away. A cell's vectors are dealt into blocks of rows,
and each two blocks meet in a task, which counts the pairs whose cosine, in double precision, reaches the threshold. A
number of links and a least neighbour for each vector leave it, not the pairs.

Vectors that are null, zero, or hold nulls or numbers that are not finite link with nothing, nor do vectors of unequal
length. Equal vectors are one class, compared once; copies count in n_links. Rows that repeat a vec_id are one vector,
their greatest array. Rows with a null vec_id link with nothing and are kept. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexweave.llm.graph import components
from hexweave.llm.text import mix
from hexweave.storage import cut

TABLES = 12
BLOCKS = 2
SCALE = 1.3
PROBES = 4
COSINE = 0.9
#: Rows of a cell that one block holds.
BLOCK_ROWS = 256
_U = np.uint64


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    r = np.rint(x)
    odd = (r.sum(1).astype(np.int64) & 1) == 1
    gap = x - r
    worst = np.abs(gap).argmax(1)
    at = np.flatnonzero(odd)
    r[at, worst[at]] += np.where(gap[at, worst[at]] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: integers of even sum, or the same moved by a half in each coordinate."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


def shortest_steps() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to neighbouring points."""
    pairs = [[s if k == i else t if k == j else 0 for k in range(8)] for i, j in combinations(range(8), 2) for s, t in product((-1, 1), repeat=2)]
    halves = [s for s in product((-0.5, 0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + halves, dtype=float)


_STEPS = shortest_steps()


def projection(dim: int, table: int) -> np.ndarray:
    return np.random.default_rng([dim, table]).normal(size=(dim, 8 * BLOCKS)) / np.sqrt(8)


def _cell(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    """A 64-bit name of each row of lattice coordinates."""
    h = np.full(len(points), table * 1_000_003 + dim, dtype=_U)
    for k in range(points.shape[1]):
        h = mix(h * _U(0x9E3779B97F4A7C15) + (2 * points[:, k]).astype(np.int64).view(_U))
    return h.view(np.int64)


def cells(x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """(own cell, PROBES neighbouring cells) of unit vectors."""
    y = SCALE * (x @ projection(x.shape[1], table))
    own = [nearest_e8(y[:, 8 * k : 8 * k + 8]) for k in range(BLOCKS)]
    gaps = np.concatenate([2 - 2 * ((y[:, 8 * k : 8 * k + 8] - p) @ _STEPS.T) for k, p in enumerate(own)], axis=1)
    near = np.argpartition(gaps, PROBES, axis=1)[:, :PROBES]
    home = _cell(np.concatenate(own, axis=1), table, x.shape[1])
    probes = np.empty((len(x), PROBES), np.int64)
    for j in range(PROBES):
        moved = [p.copy() for p in own]
        for k in range(BLOCKS):
            at = np.flatnonzero(near[:, j] // len(_STEPS) == k)
            moved[k][at] += _STEPS[near[at, j] % len(_STEPS)]
        probes[:, j] = _cell(np.concatenate(moved, axis=1), table, x.shape[1])
    return home, probes


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector, key): finite vectors that are not zero, one row an id; equal directions of equal length share a key."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    big = F.lit(float("inf"))
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big)) & F.exists("vector", lambda v: v != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & fine)
    return rows.groupBy("vec_id").agg(F.max("vector").alias("vector")).withColumn("key", F.sha2(F.array_join(F.transform("vector", lambda v: v.cast("string")), ","), 256))


def _sketch(classes: DataFrame) -> DataFrame:
    """(cls, copies, vector, cells): a class's own cell and those that it looks into, table by table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(lo, 2000) for lo in range(0, whole.num_rows, 2000)):
                dims = b.column(2).value_lengths().to_numpy()
                flat, ends = b.column(2).flatten().to_numpy(), np.cumsum(dims)
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    x = _units(np.stack([flat[ends[i] - dim : ends[i]] for i in at]))
                    named = np.empty((len(at), TABLES, PROBES + 1), np.int64)
                    for table in range(TABLES):
                        named[:, table, 0], named[:, table, 1:] = cells(x, table)
                    lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * TABLES * (PROBES + 1), named.ravel())
                    yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(at)) for i in range(3)), lists], names=["cls", "copies", "vector", "cells"])

    return classes.select("cls", "copies", "vector").mapInArrow(run, "cls long, copies long, vector array<double>, cells array<long>")


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _meet(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether rows of a table's cells (own, then looked into) meet in a's own cell, and in b's."""
    return (a[:, :1] == b).any(1), (b[:, :1] == a).any(1)


def first_met(i: np.ndarray, j: np.ndarray, named: np.ndarray, bucket: int) -> np.ndarray:
    """Which pairs of rows meet in this cell of the last table of `named` (rows, tables, cells) and in none before it.

    Two that look into each other's cells meet twice in a table: the lesser cell comes first.
    """
    fresh = np.arange(len(i))
    for table in range(named.shape[1] - 1):
        here, there = _meet(named[i[fresh], table], named[j[fresh], table])
        fresh = fresh[~(here | there)]
    last = named[:, -1]
    here, there = _meet(last[i[fresh]], last[j[fresh]])
    least = np.minimum(last[i[fresh], 0], last[j[fresh], 0])
    return fresh[~(here & there) | (least == bucket)]


def _roots(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each row reaches over the pairs (i, j) of rows."""
    least = ids.copy()
    while True:
        was = least.copy()
        np.minimum.at(least, i, was[j])
        np.minimum.at(least, j, least[i])
        if (least == was).all():
            return least


def _compare(rows: DataFrame, cosine: float) -> DataFrame:
    """(cls, others, root) of each class with links that no earlier cell counts, at most a row a class and group.

    `others` counts the vectors linked so, copies included, and `root` is the least class that these links reach here.
    Rows are sorted by group: the cell and its two blocks.
    """
    key = ("bucket", "table", "p", "q")

    def links(ids: np.ndarray, side: np.ndarray, named: np.ndarray, bucket: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        guest = named[:, -1, 0] != bucket
        i, j = np.nonzero(x @ x.T >= cosine - 1e-6)
        keep = (i < j) & ~(guest[i] & guest[j]) & ((side[i] != side[j]) | (side[i] == 2)) & (ids[i] != ids[j])
        i, j = i[keep], j[keep]
        exact = (x[i] * x[j]).sum(1) >= cosine
        i, j = i[exact], j[exact]
        if not len(i):
            return i, j
        fresh = first_met(i, j, named, bucket)
        return i[fresh], j[fresh]

    def changes(t: pa.Table) -> np.ndarray:
        """The rows at which another group begins, but the first."""
        new = np.zeros(max(t.num_rows - 1, 0), bool)
        for c in key:
            v = t.column(c).to_numpy()
            new |= v[1:] != v[:-1]
        return np.flatnonzero(new) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            ids, side, copies, bucket = (t.column(c).to_numpy() for c in ("cls", "side", "copies", "bucket"))
            flat, ends, named, stops = (f(t.column(c).combine_chunks()) for c in ("vector", "cells") for f in (lambda v: v.flatten().to_numpy(), lambda v: np.cumsum(v.value_lengths().to_numpy())))
            starts = np.concatenate([[0], changes(t)])
            found = []
            for lo, hi in zip(starts, [*starts[1:], t.num_rows]):
                if hi - lo < 2:
                    continue
                dim, n = (e[lo] - (e[lo - 1] if lo else 0) for e in (ends, stops))
                x = _units(flat[ends[lo] - dim : ends[hi - 1]].reshape(hi - lo, dim))
                i, j = links(ids[lo:hi], side[lo:hi], named[stops[lo] - n : stops[hi - 1]].reshape(hi - lo, -1, PROBES + 1), bucket[lo], x)
                if len(i):
                    others = np.zeros(hi - lo, np.int64)
                    np.add.at(others, i, copies[lo:hi][j])
                    np.add.at(others, j, copies[lo:hi][i])
                    at = np.flatnonzero(others)
                    found.append((ids[lo:hi][at], others[at], _roots(i, j, ids[lo:hi])[at]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["cls", "others", "root"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if len(at := changes(held)):
                yield from done(held.slice(0, at[-1]))
                held = held.slice(at[-1])
        if held is not None and held.num_rows:
            yield from done(held)

    return rows.select(*key, "side", "cls", "copies", "vector", "cells").mapInArrow(run, "cls long, others long, root long")


def link_counts(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(cls, others, root): links that some cell finds and the cosine confirms, each counted once; see _compare.

    The first cell in which two classes meet counts their link, which each tells from both lists of cells, so the pairs
    themselves stay in the tasks.
    """
    known = cut(_sketch(classes))
    width = PROBES + 1
    at = known.select("cls", F.posexplode("cells").alias("place", "bucket"))
    sizes = at.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("place") % width == 0).alias("homes"))
    shared = cut(sizes.filter("n > 1 AND homes > 0").select("bucket", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("parts")))
    placed = at.join(shared, "bucket").withColumn("part", F.pmod(F.xxhash64("cls", "bucket"), F.col("parts")).cast("int"))
    # Block p meets block q in group (min, max); the row's side says which it came from, 2 where both are one.
    met = placed.select("bucket", "place", "cls", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    grouped = met.select(
        "bucket", F.floor(F.col("place") / width).cast("int").alias("table"), F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"),
        F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1).alias("side"),
        "cls",
    )
    rows = grouped.join(known, "cls").withColumn("cells", F.slice("cells", F.lit(1), (F.col("table") + 1) * width))
    return _compare(rows.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "table", "p", "q"), cosine)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    fine = cut(usable(vectors))
    classes = cut(fine.groupBy("key").agg(F.min("vec_id").alias("cls"), F.count("*").alias("copies"), F.max("vector").alias("vector")))
    links = cut(link_counts(classes, cosine))
    labels = components(links.filter("cls <> root"), "cls", "root")
    linked = links.groupBy("cls").agg(F.sum("others").alias("others"))
    joined = classes.select("key", "cls", "copies").join(linked, "cls", "left").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    joined = cut(joined.select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component_id")))
    known = cut(fine.select("vec_id", "key").join(joined, "key").select("vec_id", "n_links", "component_id"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(known, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
