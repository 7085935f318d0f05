"""Query and SQL side by side."""

import os
from collections import Counter
from glob import glob

import duckdb


def views(sf_dir):
    con = duckdb.connect()
    for p in glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows)


def assert_same(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    want = views(sf_dir).sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = _rows(got.columns, map(tuple, got.collect())), _rows(want.columns, want.fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
