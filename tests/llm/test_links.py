"""Operators 6, 7 and 8 and the components that they share."""

import sys
from pathlib import Path

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hexweave.llm import graph, lattice, licenses, minhash

SF = "/root/testdata/sf0.01"


def _documents(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}


def test_near_documents(documents):
    want = brute.near_documents([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    assert _documents(documents) == want


def test_chains_and_groups_of_copies(spark):
    """A bucket with several parts, none of which is linked with its first member."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(6):
        base = list(rng.choice(words, 300))
        for k in range(8):  # a chain: each differs from the one before by a word
            base = base.copy()
            base[10 * k + 5] = f"x{k}"
            texts += [" ".join(base)] * (1 + 3 * (k % 2))
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    got = _documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute.near_documents(rows)


def test_near_documents_of_odd_tables(odd, empty):
    got = _documents(odd)
    assert got == brute.near_documents([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert minhash.near_duplicates(empty).count() == 0
    twice = minhash.near_duplicates(odd.unionByName(odd)).collect()
    assert len(twice) == 20 and {(r.doc_id, r.component_id) for r in twice} == {(i, c) for i, (_, c) in got.items()}


def test_repeated_and_null_ids(spark):
    """A document links wherever one of its texts does, whichever row comes first; a null id links with nothing."""
    long, short = " ".join(f"l{i}" for i in range(200)), " ".join(f"s{i}" for i in range(30))
    rows = [(5, long), (9, short), (9, long.replace("l7 ", "x ")), (2, short), (None, long), (None, short), (7, "alone " * 9), (7, "alone " * 9)]
    for some in (rows, rows[::-1]):
        got = minhash.near_duplicates(spark.createDataFrame(some, "doc_id long, text string")).collect()
        assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(5, 196, 2, False), (9, 26, 2, False), (9, 196, 2, False), (2, 26, 2, True), (None, 196, None, True), (None, 26, None, True), (7, 1, 7, True)}
        assert len(got) == 8


def test_a_bucket_without_links_gives_no_pairs(spark, monkeypatch):
    """What leaves the tasks that compare a bucket's members are links between parts, not pairs; blocks cover all pairs."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):  # copies of one text with a tenth changed: similar to it, hardly to each other
        at = set(rng.choice(200, 6, replace=False).tolist())
        rows.append((i, " ".join(f"x{i}_{k}" if k in at else w for k, w in enumerate(base))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = minhash.sketches
    monkeypatch.setattr(minhash, "sketches", lambda *a: made(*a).withColumn("bands", F.array(F.lit(7).cast("long"))))
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    compared, found = minhash.compare_groups, []
    monkeypatch.setattr(minhash, "compare_groups", lambda *a: found.append(compared(*a)) or found[-1])
    assert _documents(docs) == brute.near_documents(rows)
    assert found[0].count() == 0
    more = [(100 + i, t.replace("w50 ", "y ")) for i, t in rows]  # a link to each
    both = spark.createDataFrame(rows + more, "doc_id long, text string")
    assert _documents(both) == brute.near_documents(rows + more)
    assert 0 < found[1].count() <= 60 * 45  # parts less one in each pair of blocks


def test_common_counts():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 3000, n).astype(np.int64)) for n in (1, 5, 800, 900, 40)]
    got = minhash.common_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_densified_bins_come_from_the_set():
    for n in (1, 2, 7, 100, 5000):
        own = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
        assert set(minhash.signature(own)) <= set(own)


def _vectors(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(df).collect()}


def test_lattice_recall_of_planted_pairs(spark):
    """Pairs of each band of cosines, and groups, among vectors that are like none of them."""
    rng = np.random.default_rng(12)

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    def at(x, cosine):
        y = rng.normal(size=x.shape)
        y = unit(y - (y * x).sum(-1, keepdims=True) * x)
        return cosine[:, None] * x + np.sqrt(1 - cosine[:, None] ** 2) * y

    bands, rows = ((0.901, 0.92), (0.92, 0.95), (0.95, 0.999)), []
    for k, (lo, hi) in enumerate(bands):
        a = unit(rng.normal(size=(300, 64)))
        for side, x in enumerate((a, at(a, rng.uniform(lo, hi, 300)))):
            rows += [(10_000 * (k + 1) + 2 * i + side, v.tolist()) for i, v in enumerate(x)]
    centres = unit(rng.normal(size=(10, 64)))
    rows += [(50_000 + 100 * g + i, v.tolist()) for g in range(10) for i, v in enumerate(at(np.repeat(centres[g : g + 1], 30, 0), np.full(30, 0.965)))]
    rows += [(90_000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 64)))]
    got = _vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    links, n = brute.near_vectors(rows), {i: 0 for i, _ in rows}
    for a, b in links:
        n[a], n[b] = n[a] + 1, n[b] + 1
    assert all(got[i][0] <= n[i] for i in n), "a link below the threshold"
    for lo, least in ((10_000, 550), (20_000, 590), (30_000, 590), (50_000, 1000)):
        want, found = (sum(v for i, v in x.items() if lo <= i < lo + 10_000) for x in (n, {i: g[0] for i, g in got.items()}))
        assert want >= least and found >= 0.95 * want, (lo, found, want)
    assert sum(v for i, v in n.items() if i >= 90_000) == 0


def test_lattice_on_embeddings(spark):
    """Nothing is linked that brute force does not link; these vectors hold no near pair."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    links = brute.near_vectors([(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()])
    got = _vectors(df)
    n = {i: 0 for i in got}
    for a, b in links:
        n[a], n[b] = n[a] + 1, n[b] + 1
    assert all(got[i][0] <= n[i] for i in n), "a link below the threshold"
    assert sum(g[0] for g in got.values()) >= 0.98 * sum(n.values())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [1.0, nan]), (5, [inf, 1.0]), (6, [1.0, 1.0]), (7, [2.0, 2.0]), (8, [1.0, 1.0]), (9, []), (10, [1.0, -1.0]), (11, [1.0, 1.0, 0.0]), (12, [1e-30, 1e-30])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label string")
    got = _vectors(df)
    alone = {1, 2, 3, 4, 5, 9, 10, 11}
    assert all(got[i] == (0, i, True) for i in alone)
    assert {i: got[i] for i in (6, 7, 8, 12)} == {6: (3, 6, True), 7: (3, 6, False), 8: (3, 6, False), 12: (3, 6, False)}
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_groups_of_copies_give_counts_and_not_pairs(spark, monkeypatch):
    """Blocks, both cells of a table and all tables count a link once; rows that leave the tasks do not grow with the square."""
    rng = np.random.default_rng(7)
    bases = rng.normal(size=(3, 16))
    rows = [(1000 - i, [float(v) for v in bases[i % 3] + 0.02 * rng.normal(size=16)]) for i in range(240)]
    rows += [(2000 + i, rows[i][1]) for i in range(5)] + [(None, rows[0][1]), (None, None)]
    monkeypatch.setattr(lattice, "BLOCK_ROWS", 16)
    compared, found = lattice._compare, []
    monkeypatch.setattr(lattice, "_compare", lambda *a: found.append(compared(*a)) or found[-1])
    out = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = {i: 0 for i, _ in rows if i}
    links = brute.near_vectors([r for r in rows if r[0]])
    for a, b in links:
        want[a], want[b] = want[a] + 1, want[b] + 1
    assert {r.vec_id: r.n_links for r in out if r.vec_id} == want and len(out) == len(rows)
    assert {r.vec_id: r.component_id for r in out if r.vec_id} == brute.union(links, set(want))
    assert [(r.n_links, r.component_id, r.kept) for r in out if r.vec_id is None] == [(0, None, True)] * 2
    assert found[0].filter("cls <> root").select("cls", "root").distinct().count() < len(links) / 4


def test_first_met():
    """Of all cells in which two rows meet, as host or guest but not both as guests, exactly one has their pair."""
    rng = np.random.default_rng(2)
    named = rng.integers(0, 9, (40, 4, 3))
    named[:, :, 1:] = (named[:, :, :1] + 1 + np.argsort(rng.random((40, 4, 8)), 2)[:, :, :2]) % 9  # three different cells a table
    named += 10 * np.arange(4)[None, :, None]
    met, counted = set(), []
    for table in range(4):
        for bucket in range(10 * table, 10 * table + 9):
            at = np.flatnonzero((named[:, table] == bucket).any(1))
            i, j = np.nonzero(np.triu(np.ones((len(at), len(at)), bool), 1))
            host = named[at, table, 0] == bucket
            i, j = i[host[i] | host[j]], j[host[i] | host[j]]
            met |= set(zip(at[i].tolist(), at[j].tolist()))
            fresh = lattice.first_met(i, j, named[at, : table + 1], bucket)
            counted += zip(at[i[fresh]].tolist(), at[j[fresh]].tolist())
    assert len(counted) == len(set(counted)) and set(counted) == met and len(met) > 500


def test_nearest_lattice_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * 2
    p = lattice.nearest_e8(x)
    own = ((x - p) ** 2).sum(1)
    steps = lattice.shortest_steps()
    assert len(steps) == 240 and np.allclose((steps**2).sum(1), 2)
    assert all((((x - p - s) ** 2).sum(1) >= own - 1e-9).all() for s in steps)
    assert np.allclose(lattice.nearest_e8(p), p)


def _scan(docs):
    return {r.doc_id: r for r in licenses.scan(docs).collect()}


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_license_scan(request, table):
    docs = request.getfixturevalue(table)
    got = _scan(docs)
    for r in docs.select("doc_id", "text").collect():
        n, hits, first, last, labels = brute.phrase_places(r.text)
        more = brute.line_labels(r.text, licenses.TEMPLATES, licenses.STOP, licenses.THRESHOLD)
        for label, share in brute.run_labels(r.text, licenses.TEMPLATES, licenses.STOP, licenses.THRESHOLD).items():
            more[label] = max(share, more.get(label, 0))
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (n, hits, first, last)
        assert g.base_labels == ",".join(sorted(labels)) and g.labels == ",".join(sorted(labels | set(more)))
        assert abs(g.score - (1.0 if labels else max(more.values(), default=0.0))) < 1e-12


def test_license_phrases(spark):
    rows = [
        (1, "Released UNDER the-MIT\nlicense; under the mit license under the mit license"), (2, "apache license version 20"), (3, "CC-BY-NC cc by nc by nc"), (4, "under the mit licenseé"),
        (5, "Licensed under the GNU General Public License, version 3."), (6, "licensed GNU general public license version"), (7, "K cc by nc"), (8, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ]
    got = _scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {i: got[i].n_base for i in got} == {1: 3, 2: 0, 3: 2, 4: 0, 5: 0, 6: 0, 7: 1, 8: 0}
    assert got[5].labels == "gpl-3" and got[6].labels == "" and got[8].labels == "bsd" and (got[5].base_labels, got[5].score) == ("", 1.0)


def test_licenses_of_repeated_and_null_ids(spark):
    """Each row by itself; lengths of nulls are 0 whatever the session's settings."""
    rows = [(1, "licensed under the GNU general"), (1, "public license version 3"), (None, "Licensed under the GNU General Public License version 3"), (None, None), (1, "Licensed under the GNU\nGeneral Public License version 3"), (2, None)]
    was = spark.conf.get("spark.sql.ansi.enabled")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        got = licenses.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, id string")).collect()
        assert sorted((str(r.doc_id), r.n_words, r.labels, r.score) for r in got) == sorted([("1", 5, "", 0.0), ("1", 4, "", 0.0), ("None", 9, "gpl-3", 1.0), ("None", 0, "", 0.0), ("1", 9, "gpl-3", 1.0), ("2", 0, "", 0.0)])
    spark.conf.set("spark.sql.ansi.enabled", was)


def test_license_scan_of_an_empty_table(empty):
    assert licenses.scan(empty).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
def test_components(spark, pairs):
    pairs = [(a, b) for a, b in pairs if a != b]
    if not pairs:
        return
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == brute.union(pairs, {x for p in pairs for x in p})


def test_components_of_a_long_path(spark):
    rng = np.random.default_rng(1)
    ids = [int(i) for i in rng.permutation(400)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")).collect()}
    assert set(got.values()) == {0} and len(got) == 400


@pytest.mark.parametrize("seed", [None, 0, 1])
def test_bridges_between_parts_of_one_bucket(spark, monkeypatch, seed):
    """Two parts that only members other than their least link; all documents share their one bucket."""
    made = minhash.sketches
    one = F.when(F.size("bands") > 0, F.array(F.lit(7).cast("long"))).otherwise(F.col("bands"))
    monkeypatch.setattr(minhash, "sketches", lambda *a: made(*a).withColumn("bands", one))
    rng = np.random.default_rng(seed or 0)
    rows, ids = [], [1, 2, 6, 3] if seed is None else [int(i) for i in rng.permutation(40) + 1]
    for chain in np.split(np.array(ids), [] if seed is None else [12, 30]):
        words = [f"c{chain[0]}w{i}" for i in range(100)]
        for k, i in enumerate(chain):  # neighbours have 91 of 101 shingles in common, the next but one 86 of 106
            words[5 * k % 100 if k < 20 else 5 * k % 100 + 2] = f"x{i}"
            rows.append((int(i), " ".join(words)))
    if seed is None:
        rows += [(i, " ".join(f"d{i}w{k}" for k in range(100))) for i in (4, 5)]
    got = _documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute.near_documents(rows)
    assert len({c for _, c in got.values()}) == 3


def test_wrapped_notices(spark):
    """Notices on two lines and more, in comments, within other words; words that are far apart are no notice."""
    grant, bsd, gpl = (licenses.TEMPLATES[k] for k in ("mit-grant", "bsd", "gpl-3"))
    far = "\n".join(w + "\n" + "other words stand here\n" * 5 for w in gpl.split())
    rows = [
        (1, "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\")"),
        (2, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
        (3, "/* " + grant.replace("any person", "any person\r\n *\r\n * ") + " */"), (4, "one two " + "\n\n".join(bsd.upper().split())), (5, "x\n" * 50 + "Licensed under the\nGNU General Public\nLicense, version 3"), (6, far),
        (8, " ".join(bsd.split()[:14]) + "\n" + "no more of it"), (9, None),
    ]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("mit-grant", 1.0), 2: ("bsd", 1.0), 3: ("mit-grant", 1.0), 4: ("bsd", 1.0), 5: ("gpl-3", 1.0), 6: ("", 0.0), 8: ("", 0.0), 9: ("", 0.0)}


def test_wrapped_notices_in_sql(spark, tmp_path):
    """Spark, SQL and plain loops agree on notices over several lines, with insertions, cut short and twice."""
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from oracle import assert_same

    from hexweave.llm.oracles import licenses_sql

    rng, rows = np.random.default_rng(5), []
    for label, text in licenses.TEMPLATES.items():
        words = text.split()
        for k, every in enumerate((2, 3, 5, 100)):
            lines = ["# " + " ".join(words[i : i + every]) for i in range(0, len(words), every)]
            noisy = [w for x in words for w in ([x] if rng.random() < 0.8 else [x, "noise", "more"])]
            rows += [(len(rows), "code\n" + "\n".join(lines) + "\nend"), (len(rows) + 1, "\n".join(noisy)), (len(rows) + 2, "\n".join(words[:-2] if k else words[2:] + ["x"] * 60 + words[:2])), (len(rows) + 3, text.upper() + "\n" + text)]
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "License " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert_same(spark, str(tmp_path), lambda s, d: licenses.scan(s.read.parquet(f"{d}/documents.parquet")), licenses_sql())
    got, met = _scan(docs), 0
    for i, text in rows:
        more = [f(text, licenses.TEMPLATES, licenses.STOP, licenses.THRESHOLD) for f in (brute.line_labels, brute.run_labels)]
        labels = {*more[0], *more[1], *brute.phrase_places(text)[4]}
        assert got[i].labels == ",".join(sorted(labels)), (i, text)
        met += set(more[1]) > set(more[0])
    assert met >= 12


def test_repeated_rows_cost_like_other_rows(spark):
    """Rows alike in id and text are looked at once: their runs do not meet each other."""
    notice = licenses.TEMPLATES["bsd"].replace(" forms", "\nforms")
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(notice).alias("text"))
    rows = licenses.scan(docs).groupBy("labels", "n_words").count().collect()
    assert [(r.labels, r["count"]) for r in rows] == [("bsd", 3000)]
    assert licenses.wrapped_matches(licenses._keyed(docs)).count() == 1
