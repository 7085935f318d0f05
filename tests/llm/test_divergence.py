"""Operator 12 against SQL and against plain loops."""

import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import brute
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import assert_same  # noqa: E402

from hexweave.llm import divergence  # noqa: E402
from hexweave.llm.oracles import divergence_sql  # noqa: E402

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def expected(rows, least, top):
    """Of (lang, source, text) rows."""
    total, docs, own = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = LETTERS.findall(brute.lower(text or ""))
        total[lang or ""].update(words)
        docs[lang or ""].update(set(words))
        own[lang or "", source or ""].update(words)
    out = []
    for lang in total:
        kept = [t for t, d in docs[lang].items() if d >= least]

        def chances(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        q, groups = chances(total[lang]), {s: (c, chances(c)) for (la, s), c in own.items() if la == lang}
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for source, (counts, p) in groups.items():
            pairs = [(other, sum(gap(p[t], r[t]) for t in kept)) for other, (_, r) in groups.items() if other != source]
            terms = [(t, gap(p[t], q[t])) for t in kept if counts[t] and p[t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(items[:most], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def random_rows(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "ünï", "漢字", "a1b", "x-y", "É", "zz", "q", *(f"w{chr(97 + k)}" for k in range(20))]
    return [(rng.choice(["en", "en", "de", None, "xx"]), rng.choice(["a", "a", "b", "c", None, "é"]), " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(30)))) for _ in range(n)]


@pytest.mark.parametrize("seed,n,least,top", [(1, 300, 10, 10), (2, 120, 2, 3), (3, 60, 1, 1), (4, 30, 40, 5)])
def test_random_tables(spark, seed, n, least, top):
    rows = [*random_rows(seed, n), ("en", "none", None), ("en", "none", ""), ("lone", "a", "word word")]
    out = divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string").repartition(5), least, top)
    assert out.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert got(out) == expected(rows, least, top)


def test_small_blocks(spark, monkeypatch):
    """Tasks flush often and take few pairs at a time: the same sums."""
    monkeypatch.setattr(divergence, "PAIRS", 2)
    rows = random_rows(5, 200)
    counts = divergence.term_counts(spark.createDataFrame(rows, "lang string, source string, text string"))
    want = defaultdict(Counter)
    for lang, source, text in rows:
        for t in LETTERS.findall(brute.lower(text)):
            want[lang or "", source or ""][t] += 1
    assert {(r.lang, r.source, r.term): r.n for r in counts.collect()} == {(*g, t): n for g, c in want.items() for t, n in c.items()}
    batch = pa.RecordBatch.from_pylist([{"lang": "x", "posting": [{"source": s, "p": p, "zero": 3} for s, p in (("b", 50), ("a", 90), ("c", 7))]}] * 3)
    sums = Counter()
    for b in divergence._pairs(batch):
        for r in b.to_pylist():
            sums[r["a"], r["b"]] += r["value"]
    gap = lambda a, b: (a - b) ** 2 // (a + b)
    p = {"a": 90, "b": 50, "c": 7}
    assert sums == {(x, y): 3 * (gap(p[x], p[y]) - gap(p[x], 3) - gap(3, p[y])) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))}


def test_the_search_stops(spark):
    """Rows behind a bound below the last of the top are not evaluated; an equal bound is."""
    rows = [("x", "s", t, p, q, most) for t, p, q, most in (("b", 100, 10, 80), ("c", 90, 10, 73), ("a", 90, 10, 64), ("never", None, None, 63), ("never", None, None, 5))]
    rows += [("x", "t", "z", 5, 1, 9)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "term", "p", "q", "most"), r)) for r in part]) for part in (rows[:3], rows[3:])]
    out = [tuple(r.values()) for b in divergence.best_first(iter(batches), 2) for r in b.to_pylist()]
    assert out == [("x", "s", "b", 73, 1), ("x", "s", "a", 64, 2), ("x", "t", "z", 2, 1)]


def test_bounds_leave_terms_out(spark, documents):
    """Fewer terms than there are reach the search, and the result is SQL's."""
    taken = []
    whole = divergence.candidates

    def watched(occurrences, *rest):
        out = whole(occurrences, *rest)
        taken.append((occurrences.filter("p > q").count(), out.count()))
        return out

    divergence.candidates = watched
    try:
        assert_same(spark, "/root/testdata/sf0.01", lambda s, d: divergence.audit(documents), divergence_sql())
    finally:
        divergence.candidates = whole
    assert taken[0][1] < taken[0][0] / 5


def test_odd_and_empty_tables(spark, odd, empty):
    rows = [(r.lang, str(r.source), r.text) for r in odd.collect()]
    assert got(divergence.audit(odd.unionByName(odd), 2, 4)) == expected(rows + rows, 2, 4)
    assert divergence.audit(empty).count() == 0


def test_exact_quotients(spark):
    big = 9 * 10**13
    rows = [(n, total, kept) for n, total, kept in ((0, 0, 1), (big, big, 7), (big - 1, big, 10**6), (123456789, 987654321987, 31))]
    made = spark.createDataFrame(rows, "n long, t long, v long").select("n", "t", "v", divergence.probability("n", "t", "v").alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 2) // (r.t + 2 * r.v) for r in made)
