"""Near-duplicate documents by one-permutation MinHash.

A document's set holds the hashes of its distinct shingles of WIDTH words (A-Z in lower case; with fewer words, the
whole sequence as one). One hash function deals the set into bands * rows bins and keeps the least of each; an empty bin
borrows from a full one that a second hash of the bin's number picks (optimal densification). `rows` successive bins are
a band, equal bands make a bucket. `layout` chooses both for a threshold, where a pair then shares no bucket with a
probability of some 2e-5 (MISS).

Equal sets are one class first, so thousands of exact copies are one member of a bucket. A bucket's candidate edges are
a star: its centre is the member that meets most others over all its buckets, which in a family of copies is the text
that they were made from, and each other member is compared with it alone. Candidates are confirmed on full sets. Most
buckets are one part of a component then. Of the others, all members but the centre are compared in blocks inside tasks,
which give only links between parts, at most one less than the parts: so no pair of a bucket is left out, and what
leaves a task does not grow with the square of a bucket.

A full set holds 64-bit hashes of shingles, so a link is exact but for equal hashes of unequal shingles.

Documents with null or empty text, or without words, have an empty set, are linked with nothing and are kept. Rows
that repeat a doc_id are one document that links wherever one of its texts does; n_shingles is of the row's own text. A
null doc_id links with nothing. An empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexweave.llm.graph import components
from hexweave.llm.tables import cut_texts, map_texts, whole_groups
from hexweave.llm.text import Texts, mix, windows
from hexweave.storage import cut

WIDTH = 5
#: Links hold where 100 * intersection >= PERCENT * union.
PERCENT = 85
#: How likely a pair at the threshold shares no bucket, at most.
MISS = 2e-5
#: Rows of a bucket that one block holds.
BLOCK_ROWS = 256
#: Columns of one 0-1 matrix.
COLUMNS = 2048
_U = np.uint64
_ATTEMPTS = 1024


def layout(percent: int) -> tuple[int, int]:
    """(rows, bands) for a threshold: fewer rows below 85, and bands enough for MISS."""
    rows = 7 if percent >= 85 else 6 if percent >= 75 else 4
    shared = (percent / 100) ** rows
    return rows, ceil(log(MISS) / log1p(-shared)) if shared < 1 else 1


ROWS, BANDS = layout(PERCENT)


@cache
def _picks(bins: int) -> np.ndarray:
    """Which bin an empty bin asks at each attempt."""
    at = np.arange(bins, dtype=_U)[:, None] * _U(1 << 32) + np.arange(_ATTEMPTS, dtype=_U)[None, :]
    return (mix(at + _U(0x51ED2701)) % _U(bins)).astype(np.int64)


def shingle_sets(texts: Texts, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted set of each text."""
    words = texts.words
    h, at = windows(words.lower, words.first, width)
    first = np.searchsorted(at, words.first)
    out = []
    for i in range(texts.n):
        own = h[first[i] : first[i + 1]]
        if not len(own) and words.counts[i]:
            few = words.lower[words.first[i] : words.first[i + 1]]
            own = np.frombuffer(hashlib.blake2b(few.tobytes(), digest_size=8).digest(), dtype=_U)
        out.append(np.unique(own))
    return out


def signature(shingles: np.ndarray, n_bins: int = ROWS * BANDS) -> np.ndarray:
    """The least shingle of each bin, empty bins filled; shingles are sorted, and bins are ranges of them."""
    picks = _picks(n_bins)
    bins = ((shingles >> _U(32)) * _U(n_bins) >> _U(32)).astype(np.int64)
    full, at = np.unique(bins, return_index=True)
    out = np.zeros(n_bins, _U)
    out[full] = shingles[at]
    have = np.zeros(n_bins, bool)
    have[full] = True
    empty = np.flatnonzero(~have)
    for lo, hi in ((0, 32), (32, 256), (256, _ATTEMPTS)):
        if not len(empty):
            break
        hit = have[picks[empty, lo:hi]]
        got = hit.any(1)
        own = empty[got]
        out[own] = out[picks[own, lo + hit[got].argmax(1)]]
        empty = empty[~got]
    if len(empty):  # no full bin among the attempts: the next full one
        out[empty] = out[full[np.searchsorted(full, empty) % len(full)]]
    return out


def _set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) of each row, bands for a threshold."""
    n_rows, n_bands = layout(percent)

    def kernel(texts: Texts) -> dict:
        n, keys, bands = [], [], []
        salt = np.arange(1, n_bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
        for own in shingle_sets(texts):
            n.append(len(own))
            if not len(own):
                keys.append(None)
                bands.append([])
                continue
            keys.append(_set_key(own))
            rows = signature(own, n_rows * n_bands).reshape(n_bands, n_rows)
            h = salt.copy()
            for j in range(n_rows):
                h = mix(h + rows[:, j]) * _U(0xD6E8FEB86659FD93)
            bands.append(h.view(np.int64))
        return {"n_shingles": np.array(n, np.int64), "set_key": pa.array(keys, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64()))}

    return map_texts(docs, ["doc_id"], "n_shingles long, set_key binary, bands array<long>", kernel)


def full_sets(docs: DataFrame) -> DataFrame:
    """(set_key, shingles) of each row: the full set, sorted."""

    def kernel(texts: Texts) -> dict:
        sets = shingle_sets(texts)
        return {"set_key": pa.array([_set_key(own) for own in sets], pa.binary()), "shingles": pa.array([own.view(np.int64) for own in sets], pa.list_(pa.int64()))}

    return map_texts(docs, [], "set_key binary, shingles array<long>", kernel)


def stars(members: DataFrame) -> DataFrame:
    """(bucket, centre): of each bucket's members (bucket, cls, n) the one that meets most others, n being a bucket's size."""
    meets = members.groupBy("cls").agg(F.sum("n").alias("meets"))
    return members.join(meets, "cls").groupBy("bucket").agg(F.max_by("cls", F.struct("meets", -F.col("cls"))).alias("centre"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that link by their full sets (cls, n_shingles, shingles)."""
    a, b = (sets.select(F.col("cls").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    common = F.size(F.array_intersect("set_a", "set_b"))
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    linked = 100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)
    return pairs.join(b, "b").join(a, "a").filter(fits).filter(linked).select("a", "b")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two sets share, by products of 0-1 matrices over the hashes that two sets hold or more."""
    n = len(sets)
    of = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    column, of = (np.cumsum(often) - 1)[column[keep]], of[keep]
    out = np.zeros((n, n), np.int64)
    for lo in range(0, int(often.sum()), COLUMNS):
        at = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
        held = np.zeros((n, COLUMNS), np.float32)  # counts up to 2 ** 24 are exact
        held[of[at], column[at] - lo] = 1
        out += (held @ held.T).astype(np.int64)
    return out


def spanning_links(ids: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (a, b) between rows of different parts, at most one less than there are parts, that join what all links join."""
    sizes, common = np.array([len(s) for s in sets]), common_counts(sets)
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    root = {int(p): int(p) for p in parts}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1) & (parts[:, None] != parts[None, :]))):
        p, q = find(int(parts[i])), find(int(parts[j]))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return out


def rest_of_buckets(members: DataFrame, centres: DataFrame, labels: DataFrame) -> DataFrame:
    """(group, cls, component): the members to compare of the buckets that hold several parts, in blocks.

    A bucket's centre was compared with each of its members, so it is left out. Buckets of equal members count once.
    Each two blocks of BLOCK_ROWS members meet in a group.
    """
    known = labels.select(F.col("node").alias("cls"), "component")
    placed = members.join(centres, "bucket").filter(F.col("cls") != F.col("centre")).join(known, "cls", "left")
    placed = cut(placed.select("bucket", "cls", F.coalesce("component", "cls").alias("component")))
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"), F.expr("bit_xor(xxhash64(cls))").alias("held"), F.expr("bit_xor(xxhash64(cls, 1))").alias("held_too"))
    once = open_.filter("x < y").groupBy("n", "held", "held_too").agg(F.min("bucket").alias("bucket"))
    blocks = once.select("bucket", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    at = placed.join(cut(blocks), "bucket").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    met = at.select("bucket", "cls", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return met.select(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("group"), "cls", "component")


def compare_groups(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between parts of each group of (group, cls, component, shingles), as many as join them."""

    def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
        group, ids, parts = (t.column(c).to_numpy() for c in ("group", "cls", "component"))
        shingles = t.column("shingles").combine_chunks()
        flat, ends = shingles.flatten().to_numpy(), np.concatenate([[0], np.cumsum(shingles.value_lengths().to_numpy())])
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        found = []
        for lo, hi in zip(starts, [*starts[1:], len(group)]):
            if (parts[lo:hi] != parts[lo]).any():
                found += spanning_links(ids[lo:hi], parts[lo:hi], [flat[ends[i] : ends[i + 1]] for i in range(lo, hi)], percent)
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return whole_groups(rows.select("group", "cls", "component", "shingles"), links, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = cut_texts(sketches(docs, percent))
    classes = sketch.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("of"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    one = sketch.join(classes.select("cls", "set_key", F.col("of").alias("doc_id")), ["doc_id", "set_key"]).dropDuplicates(["cls"])
    one = cut(one.select("cls", "doc_id", "set_key", "n_shingles", "bands"))
    bands = one.select("cls", F.explode("bands").alias("bucket"))
    shared = cut(bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    members = cut(bands.join(shared, "bucket").select("bucket", "cls", "n"))
    met = cut(one.select("cls", "doc_id", "set_key", "n_shingles").join(members.select("cls").distinct(), "cls", "left_semi"))
    texts = docs.join(met.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")  # one plan at all sizes
    sets = cut_texts(full_sets(texts)).dropDuplicates(["set_key"]).join(met, "set_key").select("cls", "n_shingles", "shingles")
    sets = cut(sets)
    centres = cut(stars(members))
    star = members.join(centres, "bucket").filter(F.col("cls") != F.col("centre"))
    star = star.select(F.least("cls", "centre").alias("a"), F.greatest("cls", "centre").alias("b")).distinct()
    # Texts of one document.
    own = sketch.select("doc_id", "set_key").join(classes, "set_key").groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("most"))
    own = own.filter("a < most").select("doc_id", "a").join(sketch.select("doc_id", "set_key").join(classes, "set_key"), "doc_id").filter("a < cls").select("a", F.col("cls").alias("b")).distinct()
    links = cut(confirm(star, sets, percent).unionByName(own))
    labels = components(links)
    rest = cut(rest_of_buckets(members, centres, labels))
    found = cut_texts(compare_groups(rest.join(sets, "cls"), percent))
    if not found.isEmpty():
        labels = components(links.unionByName(found))
    placed = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("set_key", "of", F.coalesce("component", "cls").alias("component"))
    placed = cut(placed)
    first = placed.groupBy("component").agg(F.min("of").alias("first"))
    placed = cut(placed.join(first, "component").select("set_key", "first"))
    out = sketch.select("doc_id", "n_shingles", "set_key").join(placed, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
