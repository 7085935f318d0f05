"""Documents drawn so that their n-grams look like a target's: importance weights over hashed n-grams, and Gumbel noise.

Tasks count the buckets of all runs of 1 to 3 words; a bucket's gain is the logarithm of its share in the target over its
share in the documents, and a document's weight is the sum of its features' gains, looked up in an array. A score is
the weight plus noise that depends on doc_id alone, so the highest scores are a draw without replacement by weight.

The draw: each task's eligible rows are a run. Ranges of the order of draw, whose ends come from a bounded sample of
keys, are counted exactly, so a range's first rank is known and ranges behind the draw's end are not looked at further. Spark
sorts each range's rows by run, and a tournament tree merges the runs of a range, up to the exact count, emitting
ranks. A range holds about RANGE_ROWS rows, whatever ties: the order goes on by row.

A null text has no words: no features, weight 0, not eligible. Repeated rows and doc_ids each are rows of their own, with one
noise; equal scores go by doc_id, a null one last (its noise is that of an empty id), then by row. Columns other than
doc_id and text are not looked at. An empty table gives an empty one; an empty target gives its share evenly.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexweave.llm.tables import cut_texts, whole_groups
from hexweave.llm.text import Texts, chunks
from hexweave.storage import cut

BUCKETS, ORDERS = 10_000, 3
PERCENT, LEAST_WORDS, SEED = 5, 20, 42
#: Bytes of text at a time.
BLOCK = 1 << 21
#: Drawn rows that a range is to hold, most ranges (which hold more then), keys of the sample for each range.
RANGE_ROWS, RANGES, KEYS = 1 << 12, 2000, 20
#: Lengths with a table of their own.
_LENGTHS = 512
_SPACE = zlib.crc32(b" ")


@cache
def _shifts() -> np.ndarray:
    """[length, byte place, byte]: what a byte of a CRC becomes when `length` bytes follow."""
    step = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    step ^= step[0]  # the linear part
    out = np.zeros((_LENGTHS, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, _LENGTHS):
        out[n] = step[out[n - 1] & np.uint32(255)] ^ (out[n - 1] >> np.uint32(8))
    return out


def follow(crc: np.ndarray, next_crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings joined, from theirs and the second one's length."""
    tables, crc, length = _shifts(), crc.copy(), length.copy()
    long = np.flatnonzero(length >= _LENGTHS)
    while len(long):
        x = crc[long]
        crc[long] = _look(tables, np.full(len(x), _LENGTHS - 1), x)
        length[long] -= _LENGTHS - 1
        long = long[length[long] >= _LENGTHS]
    return _look(tables, length, crc) ^ next_crc


def _look(tables: np.ndarray, n: np.ndarray, x: np.ndarray) -> np.ndarray:
    byte = np.uint32(255)
    return tables[n, 0, x & byte] ^ tables[n, 1, (x >> np.uint32(8)) & byte] ^ tables[n, 2, (x >> np.uint32(16)) & byte] ^ tables[n, 3, x >> np.uint32(24)]


def features(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(bucket of each run of n words, index of each text's first)] for n from 1 to ORDERS."""
    terms = texts.terms
    size = terms.ends - terms.starts
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    inside = texts.lowered[terms.inside]
    words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(inside)]).dictionary_encode()
    crc = np.array([zlib.crc32(w) for w in words.dictionary.to_pylist()], np.uint32)[words.indices.to_numpy()] if len(size) else np.zeros(0, np.uint32)
    spaced = follow(crc, np.full(len(crc), _SPACE, np.uint32), np.ones(len(crc), np.int64))
    out, run, length = [], crc, size  # the runs that begin at each word, while they stay in the words
    for n in range(1, ORDERS + 1):
        if n > 1:
            run = follow(spaced[: len(run) - 1], run[1:], length[1:])
            length = size[: len(run)] + 1 + length[1:]
        begins = _whole(terms.first, len(crc), n)[: len(run)]
        out.append(((run[begins] % np.uint32(BUCKETS)).astype(np.int64), np.concatenate([[0], np.cumsum(np.maximum(terms.counts - n + 1, 0))])))
    return out


def _whole(first: np.ndarray, words: int, n: int) -> np.ndarray:
    """Whether the run of n words that begins at each word stays in its text."""
    inside = np.ones(words, bool)
    for j in range(1, n):
        at = first[1:] - j
        inside[at[at >= first[:-1]]] = False
    return inside


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many features of all rows each bucket has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, texts in chunks(b.column(0), BLOCK):
                for at, _ in features(texts):
                    counts += np.bincount(at, minlength=BUCKETS)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own])], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target over its share in the source, each with one more."""
    s_all, t_all = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, least_words: int, seed: int) -> DataFrame:
    """(doc_id, n_features, weight, score, eligible, run, row) of each row; `run` numbers the task."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        row = part << 33
        for b in batches:
            for lo, texts in chunks(b.column(1), BLOCK):
                weight, n = np.zeros(texts.n, np.int64), np.zeros(texts.n, np.int64)
                for at, first in features(texts):
                    sums = np.concatenate([[0], np.cumsum(shared.value[at])])
                    weight += sums[first[1:]] - sums[first[:-1]]
                    n += np.diff(first)
                ids = b.column(0).slice(lo, texts.n)
                score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
                rows = row + np.arange(texts.n)
                row += texts.n
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(weight), pa.array(score), pa.array(texts.terms.counts >= least_words), pa.array(np.full(texts.n, part)), pa.array(rows)], names=["doc_id", "n_features", "weight", "score", "eligible", "run", "row"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_features long, weight long, score long, eligible boolean, run long, row long")


Key = tuple[int, bool, int, int]


def keys(table: pa.Table | pa.RecordBatch) -> list[Key]:
    """Each row's place in the order of draw, by comparison."""
    score, doc_id, row = (table.column(c).to_pylist() for c in ("score", "doc_id", "row"))
    return [(-s, i is None, i or 0, r) for s, i, r in zip(score, doc_id, row)]


def in_order(runs: Sequence[Sequence[Key]], most: int) -> Iterator[tuple[int, int]]:
    """(run, place in it) of the first `most` keys of sorted runs together: a tournament tree whose nodes keep losers."""
    leaves = 1 << max(0, len(runs) - 1).bit_length()
    heads = [(run[0], k) if len(run) else None for k, run in enumerate(runs)] + [None] * (leaves - len(runs))
    at = [0] * len(runs)

    def before(a, b) -> bool:
        return b is None or a is not None and a < b

    winners, losers = [None] * leaves + heads, [None] * leaves
    for node in range(leaves - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if before(a, b) else (b, a)
    best = winners[1]
    for _ in range(most):
        if best is None:
            return
        k = best[1]
        yield k, at[k]
        at[k] += 1
        best = (runs[k][at[k]], k) if at[k] < len(runs[k]) else None
        node = (leaves + k) // 2
        while node:  # up the tree, against those that lost there
            if not before(best, losers[node]):
                best, losers[node] = losers[node], best
            node //= 2


def _ends(eligible: DataFrame, want: int, high: int, ranges: int) -> list[Key]:
    """Ends of `ranges` ranges of the first `want` rows or so, from some KEYS keys for each. `high`: a score that most rows are below."""
    one_in = max(1, want // (KEYS * ranges))
    sample = eligible.filter((F.col("score") >= high) & (F.pmod(F.xxhash64("row"), F.lit(one_in)) == 0)).select("score", "doc_id", "row").toArrow()
    known = sorted(keys(sample))
    each = max(1, want // (ranges * one_in))
    return known[each::each]


def draw(rows: DataFrame, percent: int = PERCENT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of all rows of `scored`: ranks from 1 for the share drawn, else null."""
    eligible, result = rows.filter("eligible"), ["doc_id", "n_features", "weight", "score"]
    # A bound that the draw's end is above, but for the sketch's error; rows below it are one range more.
    told = eligible.agg(F.count("*").alias("n"), F.percentile_approx("score", max(0.0, 1 - 1.5 * percent / 100), 10_000).alias("high")).first()
    want = percent * told.n // 100
    if not want:
        return rows.select(*result, F.lit(None).cast("long").alias("rank"))
    ends = _ends(eligible, want, told.high, min(RANGES, -(-want // range_rows)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group = [bisect_right(ends, k) for k in keys(b)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(group, pa.int64())], names=[*b.schema.names, "group"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = cut(eligible.mapInArrow(place, f"{kinds}, group long"))
    sizes = {r.group: r["count"] for r in placed.groupBy("group").count().collect()}  # RANGES and few more rows
    first, before = {}, 0
    for group in sorted(sizes):
        if before < want:
            first[group] = before
        before += sizes[group]

    def merge(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group = table.column("group").to_numpy()
        for own in np.split(np.arange(len(group)), np.flatnonzero(np.diff(group)) + 1) if len(group) else ():
            part = table.slice(own[0], len(own))
            run = part.column("run").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(run)]]).tolist()
            order = keys(part)
            base = first[int(group[own[0]])]
            rank = np.zeros(len(own), np.int64)
            runs = [order[lo:hi] for lo, hi in zip(starts, starts[1:])]
            for k, (r, at) in enumerate(in_order(runs, min(len(own), want - base)), base + 1):
                rank[starts[r] + at] = k
            told = part.select(result).append_column("rank", pa.array(rank, mask=rank == 0))
            yield from told.combine_chunks().to_batches()

    last = max(first)
    kind = "doc_id long, n_features long, weight long, score long, rank long"
    merged = whole_groups(placed.filter(F.col("group") <= last), merge, kind, ("run", F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    rest = placed.filter(F.col("group") > last).select(result).unionByName(rows.filter("NOT eligible").select(result))
    return merged.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each document, towards the texts of `target`."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return draw(cut_texts(scored(docs, gain, least_words, seed)), percent)
