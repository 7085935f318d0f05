"""Operator 13 against plain loops."""

import hashlib
import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from hexweave.llm import registry, resampling
from hexweave.llm.text import chunks


def buckets(text):
    words = brute.TERM.findall(brute.lower(text or ""))
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def expected(docs, target, percent=5, least=20):
    """[(doc_id, n_features, weight, score, rank)] of (doc_id, text) rows."""
    own = [buckets(t) for _, t in docs]
    s, t = Counter(x for b, _ in own for x in b), Counter(x for text in target for x in buckets(text)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    rows = []
    for (i, _), (at, n) in zip(docs, own):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in at)
        rows.append([i, len(at), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_crc_of_joined_strings():
    rng = random.Random(1)
    for size in (0, 1, 7, 511, 512, 513, 5000):
        a, b = rng.randbytes(9), rng.randbytes(size)
        told = resampling.follow(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([size]))
        assert told[0] == zlib.crc32(a + b)


def test_features():
    texts = ["", "a", "A b", "one TWO three four", "Ünï 漢字 x9-y", None, "w" * 600 + " " + "v" * 1200 + " z", "  ", "p q r"]
    for limit in (1, 1 << 20):
        for lo, some in chunks(pa.array(texts), limit):
            made = resampling.features(some)
            for i in range(some.n):
                assert [int(x) for at, first in made for x in at[first[i] : first[i + 1]]] == buckets(texts[lo + i])[0]


@pytest.mark.parametrize("seed", range(8))
def test_tournament(seed):
    rng = random.Random(seed)
    runs = [sorted((rng.randrange(20), False, rng.randrange(3), rng.random()) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(9))]
    whole = sorted(x for run in runs for x in run)
    for most in (0, 1, 5, len(whole), len(whole) + 3):
        assert [runs[k][at] for k, at in resampling.in_order(runs, most)] == whole[:most]


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, target = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    out = registry.op13_resampling(spark, sf)
    assert out.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert got(out) == expected([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])


@pytest.mark.parametrize("range_rows", [1, 7, 50, 10_000])
def test_draw_over_ranges(spark, range_rows):
    """Ties, repeated rows, null ids and many runs: the ranks are those of one sorted list."""
    rng = random.Random(range_rows)
    rows = [(rng.choice([None, *range(40)]), 1, 2, rng.choice([5, 5, 5, rng.randrange(9)]), rng.random() < 0.9, k % 13, k) for k in range(700)]
    table = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long, eligible boolean, run long, row long").repartition(5)
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for percent in (0, 5, 60, 100):
        want = percent * len(order) // 100
        told = resampling.draw(table, percent, range_rows).collect()
        assert len(told) == len(rows)
        ranked = sorted((r for r in told if r["rank"] is not None), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, want + 1))
        assert [(r.doc_id, r.score) for r in ranked] == [(r[0], r[3]) for r in order[:want]]


def test_odd_and_empty_tables(spark, odd, empty):
    said = spark.createDataFrame([(1, "many words"), (2, None)], "item_id long, text string")
    assert got(resampling.resample(odd, said, 50, 3)) == expected([(r.doc_id, r.text) for r in odd.collect()], ["many words", None], 50, 3)
    assert resampling.resample(empty, said).count() == 0
    twice = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (7, "e f g h")], "doc_id long, text string")
    assert got(resampling.resample(twice, said.limit(0), 50, 3)) == expected([tuple(r) for r in twice.collect()], [], 50, 3)
