"""Hand-made networks for what the grid has none of."""

import heapq
import random
from itertools import pairwise
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hexweave.functions import cells
from hexweave.operators import audit, paths, stats
from hexweave.operators import closure as closure_module
from hexweave.operators import sweeps
from hexweave.operators.closure import closure_auto, closure_grouped, closure_join, closure_whole
from hexweave.operators.pairs import assign_cells, enrich
from hexweave.operators.reduce import merge_min, min_path
from hexweave.plans import hierarchy
from hexweave.plans.hierarchy import Options, build_shortcuts
from hexweave import storage
from hexweave.sources import network

INF = float("inf")
ARCS = "from_edge long, to_edge long, cost double, via_edge long, current_cell long"
KERNELS = [closure_join, closure_grouped, closure_auto]


def cell(base, *digits):
    c = (1 << 59) | (15 << 52) | (base << 45)
    for k, d in enumerate([*digits, *[0] * (15 - len(digits))], 1):
        c |= d << 3 * (15 - k)
    return c


def lca_res(a, b):
    """By the digits, one by one."""
    if (a >> 45) & 127 != (b >> 45) & 127:
        return -1
    for k in range(1, 16):
        if (a >> 3 * (15 - k)) & 7 != (b >> 3 * (15 - k)) & 7:
            return k - 1
    return 15


def _edges(spark, rows):
    """(id, from_cell, to_cell, length, maxspeed)"""
    full = [(i, a, b, None if a is None or b is None else lca_res(a, b), n, v) for i, a, b, n, v in rows]
    return network.with_cost(spark.createDataFrame(full, network.EDGE_SCHEMA))


def _graph(spark, pairs):
    return spark.createDataFrame(pairs, network.GRAPH_SCHEMA)


def _dijkstra(follow, start):
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, at = heapq.heappop(heap)
        for to, c in follow.get(at, ()) if d <= best[at] else ():
            if d + c < best.get(to, INF):
                best[to] = d + c
                heapq.heappush(heap, (d + c, to))
    return {k: v for k, v in best.items() if k != start}


def test_cells(spark):
    rng = random.Random(4)
    rows = [(cell(rng.choice([3, 4]), *(rng.randrange(3) for _ in range(rng.randrange(16)))), cell(3, *(rng.randrange(3) for _ in range(5)))) for _ in range(300)] + [(0, cell(3)), (cell(3), 0), (0, 0), (None, cell(3))]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", cells.lca_resolution("a", "b").alias("r"), cells.lca("a", "b").alias("l"), cells.parent("a", 4).alias("p"), cells.resolution("a").alias("s"), cells.contains(cells.lca("a", "b"), "b").alias("c")).collect()
    for r in got:
        if r.a is None:
            assert r.r is None and r.l is None and r.s is None
        elif 0 in (r.a, r.b):
            assert (r.r, r.l) == (-1, 0)
        else:
            assert r.r == lca_res(r.a, r.b) and r.s == 15 and (r.p >> 52) & 15 == 4 and r.c
            assert r.l == 0 if r.r < 0 else (r.l >> 52) & 15 == r.r


def test_costs(spark):
    rows = [(1, cell(3), cell(3, 1), 8.0, 2.0), (2, cell(3), cell(3), 8.0, 0.0), (3, cell(3), cell(3), 8.0, -1.0), (4, cell(3), cell(3), None, 2.0), (5, cell(3), cell(3), 8.0, None), (6, cell(3), None, 0.0, 1.0)]
    edges = _edges(spark, rows)
    assert {r.id: r.cost for r in edges.collect()} == {1: 4.0, 2: INF, 3: INF, 4: None, 5: None, 6: 0.0}
    graph = _graph(spark, [(1, 2), (1, 2), (9, 1), (1, 9), (1, 1)])
    faults = {r.fault: r.n for r in network.audit_input(edges, graph).collect()}
    assert faults == {"null_id": 0, "null_pair": 0, "null_cell": 1, "null_cost": 2, "impassable": 2, "wrong_lca_res": 0, "repeated_id": 0, "unknown_from_edge": 1, "unknown_to_edge": 1, "self_pair": 1}
    assert sorted((r.from_edge, r.to_edge, r.cost) for r in network.base_pairs(edges, graph).collect()) == sorted([(1, 2, 4.0), (9, 1, None), (1, 9, 4.0), (1, 1, 4.0)], key=str)


@pytest.mark.parametrize("kernel", KERNELS)
def test_closure_edge_cases(spark, kernel):
    big = 1 << 40
    arcs = [
        (1, 2, 1.0, 2, 7), (2, 3, 1.0, 3, 7), (1, 3, 5.0, 3, 7), (1, 3, 9.0, 3, 7), (3, 1, INF, 1, 7), (3, 3, 1.0, 3, 7), (4, 5, 0.0, 5, 7), (5, 4, 0.0, 4, 7),
        (1, 2, 3.0, 2, 8), (2, 3, None, 3, 8), (big, big + 1, 0.5, big + 1, 8), (big + 1, 1, 0.5, 1, 8),
    ]
    got = {(r.from_edge, r.to_edge, r.current_cell): r.cost for r in kernel(spark.createDataFrame(arcs, ARCS)).collect()}
    assert got == {(1, 2, 7): 1.0, (2, 3, 7): 1.0, (1, 3, 7): 2.0, (4, 5, 7): 0.0, (5, 4, 7): 0.0, (1, 2, 8): 3.0, (big, big + 1, 8): 0.5, (big + 1, 1, 8): 0.5, (big, 1, 8): 1.0, (big + 1, 2, 8): 3.5, (big, 2, 8): 4.0}
    assert kernel(spark.createDataFrame([], ARCS)).count() == 0


@pytest.mark.parametrize("kernel", KERNELS)
def test_long_chain_and_via(spark, kernel):
    """More than ten one-step rounds; every via splits its row's cost."""
    arcs = [(i, i + 1, 1.0, i + 1, 0) for i in range(40)]
    rows = {(r.from_edge, r.to_edge): (r.cost, r.via_edge) for r in kernel(spark.createDataFrame(arcs, ARCS)).collect()}
    assert len(rows) == 40 * 41 // 2 and rows[0, 40][0] == 40
    for (a, b), (cost, via) in rows.items():
        assert via == b and cost == 1 or rows[a, via][0] + rows[via, b][0] == cost


def test_join_kernel_says_when_it_does_not_settle(spark):
    arcs = spark.createDataFrame([(i, i + 1, 1.0, i + 1, 0) for i in range(40)], ARCS)
    with pytest.raises(RuntimeError):
        closure_join(arcs, max_rounds=2)


def test_auto_kernel_splits_by_size(spark):
    arcs = spark.createDataFrame([(i, i + 1, 1.0, i + 1, i // 10 % 2) for i in range(40)] + [(1, 2, 1.0, 2, 5)], ARCS)
    rows = [sorted((r.from_edge, r.to_edge, r.cost, r.current_cell) for r in k.collect()) for k in (closure_auto(arcs, 3), closure_join(arcs))]
    assert rows[0] == rows[1]


def test_ties_and_nulls(spark):
    schema = "from_edge long, to_edge long, cost double, via_edge long"
    a = spark.createDataFrame([(1, 2, 3.0, 9), (1, 2, None, 1), (1, 2, 3.0, 4), (5, 6, None, 6)], schema)
    b = spark.createDataFrame([(1, 2, 3.0, 3), (7, 8, 1.0, 8)], schema)
    assert sorted(map(tuple, min_path(a, "from_edge", "to_edge").collect())) == [(1, 2, 3.0, 4)]
    assert sorted(map(tuple, merge_min(a, b).collect())) == [(1, 2, 3.0, 3), (7, 8, 1.0, 8)]


def test_equal_cells_give_one_row(spark):
    a, b = cell(3, 1, 2), cell(3, 1, 3)
    edges = _edges(spark, [(1, a, b, 1.0, 1.0), (2, b, a, 1.0, 1.0)])
    placed = enrich(network.base_pairs(edges, _graph(spark, [(1, 2)])), edges)
    assert assign_cells(placed, 1).count() == 1 and assign_cells(placed, 0).count() == 0


def _random_network(seed, n=26):
    """Random one-way streets between nodes of two base cells."""
    rng = random.Random(seed)
    node = [cell(rng.choice([20, 20, 21]), *(rng.randrange(2) for _ in range(4)), i % 7, i // 7) for i in range(n)]
    ends = [(i, (i + 1) % n) for i in range(n)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
    ends = [(i, j) for i, j in dict.fromkeys(ends) if i != j]
    rows = [(k, node[i], node[j], float(rng.randrange(9)), float(rng.choice([1, 2, 4, 0 if k % 11 == 5 else 1]))) for k, (i, j) in enumerate(ends)]
    graph = [(a, b) for a, (_, j) in enumerate(ends) for b, (i, _) in enumerate(ends) if i == j]
    return rows, graph


@pytest.mark.parametrize("seed,kernel", [(1, "auto"), (2, lambda level: "join" if level == 0 else "grouped")])
def test_random_networks(spark, seed, kernel):
    """Valid pairs with true costs, nothing else: against Dijkstra over the whole network."""
    rows, graph = _random_network(seed)
    out = build_shortcuts(_edges(spark, rows), _graph(spark, graph), Options(kernel=kernel, watch=((0, 1),)))
    cost = {i: n / v if v > 0 else INF for i, _, _, n, v in rows}
    at = {i: (a, b) for i, a, b, _, _ in rows}
    follow = {}
    for a, b in graph:
        if cost[a] < INF:
            follow.setdefault(a, []).append((b, cost[a]))
    want = {}
    for a in at:
        for b, c in _dijkstra(follow, a).items():
            need = max(lca_res(*at[a]), lca_res(*at[b]))
            if need <= max(lca_res(at[a][1], at[b][0]), lca_res(at[a][0], at[b][1])):
                want[a, b] = c
    got = {(r.from_edge, r.to_edge): r.cost for r in out.final().collect()}
    assert {k: v for k, v in got.items() if v < INF and k[0] != k[1]} == want
    assert len(out.levels) == 33 and out.watched().count() > 0


def test_csv_and_parquet(spark, tmp_path):
    rows, graph = _random_network(3, 8)
    lines = ["highway,maxspeed,id,from_cell,to_cell,lca_res,length"] + [f"primary,{v},{i},{a},{b},{lca_res(a, b)},{n}" for i, a, b, n, v in rows] + ["x,fast,999,1,2,3,4"]
    (tmp_path / "edges.csv").write_text("\n".join(lines))
    (tmp_path / "graph.csv").write_text("\n".join(["from_edge,to_edge"] + [f"{a},{b}" for a, b in graph]))
    edges, pairs = network.load_edges(spark, str(tmp_path / "edges.csv")), network.load_graph(spark, str(tmp_path / "graph.csv"))
    assert {r.id: r.cost for r in edges.collect()} == {r.id: r.cost for r in _edges(spark, rows).collect()} | {999: None}
    final = build_shortcuts(edges.filter("id < 999"), pairs).final()
    network.write_shortcuts(final, str(tmp_path / "out"))
    back = network.read_shortcuts(spark, str(tmp_path / "out"))
    assert back.dtypes == [("from_edge", "bigint"), ("to_edge", "bigint"), ("cost", "double"), ("via_edge", "bigint"), ("inside", "tinyint"), ("cell", "bigint")]
    assert audit.compare(final, back).first()["matched"] == back.count()
    with pytest.raises(ValueError):
        network.load_graph(spark, str(tmp_path / "edges.csv"))


def test_comparison_reports_both_sides(spark):
    schema = "incoming_edge long, outgoing_edge long, cost double, via_edge long, inside int, cell long"
    a = spark.createDataFrame([(1, 2, 1.0, 2, 0, 5), (1, 3, 2.0, 2, None, 5)], schema)
    b = spark.createDataFrame([(1, 3, 2.5, 3, 1, 5), (4, 5, 1.0, 5, 0, 5)], schema.replace("incoming", "from").replace("outgoing", "to"))
    r = audit.compare(a, b).first()
    assert (r.ref_rows, r.new_rows, r.matched, r.only_ref, r.only_new, r.cost_differs, r.inside_differs, r.via_differs, r.cell_differs) == (2, 2, 1, 1, 1, 1, 1, 1, 0)
    assert [tuple(x) for x in audit.top_differences(a, b).collect()] == [(1, 3, 2.0, 2.5, 0.5)]


def test_audits_find_faults(spark):
    s = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (8, 9, 1.0)], "from_edge long, to_edge long, cost double")
    r = audit.audit_closed(s).first()
    assert (r.pairs, r.improvable, r.max_gain) == (4, 1, 3.0)
    truth = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 2.0)], s.schema)
    r = audit.audit_optimal(s, truth).first()
    assert (r.pairs, r.optimal, r.unreachable, r.max_excess) == (4, 2, 1, 3.0)
    assert sorted(map(tuple, audit.sample_pairs(s, 2).collect())) == sorted(map(tuple, audit.sample_pairs(s.repartition(3), 2).collect()))


def test_unpack_stops_on_free_cycles(spark):
    schema = "from_edge long, to_edge long, cost double, via_edge long"
    s = spark.createDataFrame([(1, 2, 0.0, 3), (1, 3, 0.0, 2), (3, 2, 0.0, 1), (2, 3, 0.0, 1), (3, 1, 0.0, 2), (2, 1, 0.0, 3)], schema)
    with pytest.raises(RuntimeError):
        paths.unpack(s, s.filter("from_edge = 1 AND to_edge = 2").select("from_edge", "to_edge"), max_rounds=3)


def test_long_paths(spark):
    """Two hundred segments: by jumps where each via is the next segment, by halves where vias are a closure's own."""
    n = 200
    base = spark.createDataFrame([(i, i + 1, 1.0, i + 1, 0) for i in range(n)], ARCS)
    whole, arcs = closure_join(base), paths.whole_costs(base)
    via = paths.canonical_via(closure_join(arcs.selectExpr("*", "0L AS current_cell")), arcs)
    wanted = whole.filter(f"from_edge = 0 AND to_edge IN (1, 63, {n})").select("from_edge", "to_edge")
    for got in (paths.walk(via, wanted), paths.unpack(whole, wanted)):
        rows = sorted((r.to_edge, r.pos, r.edge) for r in got.collect())
        assert rows == sorted((t, i, i) for t in (1, 63, n) for i in range(t + 1))


def test_walk_stops_on_free_cycles(spark):
    s = spark.createDataFrame([(1, 2, 3), (3, 2, 1)], "from_edge long, to_edge long, via_edge long")
    with pytest.raises(RuntimeError):
        paths.walk(s, s)


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        storage.shared_dir(Cluster)


def test_malformed_ids_are_counted(spark, tmp_path):
    (tmp_path / "edges.csv").write_text("id,from_cell,to_cell,lca_res,length,maxspeed\nx1,0,0,-1,1,1\n2,0,y,-1,1,1")
    (tmp_path / "graph.csv").write_text("from_edge,to_edge\n2,z\n2,2")
    edges, graph = network.load_edges(spark, str(tmp_path / "edges.csv")), network.load_graph(spark, str(tmp_path / "graph.csv"))
    faults = {r.fault: r.n for r in network.audit_input(edges, graph).collect()}
    assert (faults["null_id"], faults["null_pair"], faults["null_cell"], faults["self_pair"], faults["unknown_to_edge"]) == (1, 1, 1, 1, 0)


def test_unpack_walks_the_graph(spark):
    rows, graph = _random_network(5, 12)
    edges = _edges(spark, rows)
    built = build_shortcuts(edges, _graph(spark, graph))
    whole = closure_join(network.base_pairs(edges, _graph(spark, graph)).selectExpr("*", "0L AS current_cell"))
    done = {}
    for r in paths.unpack(whole, whole.select("from_edge", "to_edge")).collect():
        done.setdefault((r.from_edge, r.to_edge), []).append((r.pos, r.edge))
    cost = {i: n / v if v > 0 else INF for i, _, _, n, v in rows}
    price = {(r.from_edge, r.to_edge): r.cost for r in whole.collect()}
    for (a, b), hops in done.items():
        walk = [e for _, e in sorted(hops)]
        assert walk[0] == a and walk[-1] == b and all(p in set(graph) for p in pairwise(walk))
        assert abs(sum(cost[e] for e in walk[:-1]) - price[a, b]) < 1e-9
    assert stats.distribution(built.final(), "inside").agg({"percent": "sum"}).first()[0] == pytest.approx(100)


def _follow(pairs):
    out = {}
    for a, b, c in pairs:
        out.setdefault(a, []).append((b, c))
    return out


def _real_network(seed, n=60):
    """Arcs with costs that are no sums of powers of two, some of them 0, and cycles of these."""
    rng = random.Random(seed)
    arcs = {(i, i + 1): rng.choice([0.0, 8 / 2.7, 1 / 3, rng.random() * 30]) for i in range(n)}
    arcs |= {(rng.randrange(n), rng.randrange(n)): rng.choice([0.0, rng.random() * 90]) for _ in range(2 * n)}
    arcs |= {(5, 6): 0.0, (6, 5): 0.0, (6, 7): 0.0, (7, 5): 0.0}
    return [(a, b, c) for (a, b), c in sorted(arcs.items()) if a != b]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_paths_of_real_costs(spark, seed):
    """Every pair has a next segment and a walk that ends, whose cost is Dijkstra's, with free cycles too."""
    pairs = _real_network(seed)
    base = spark.createDataFrame([(a, b, c, b) for a, b, c in pairs], "from_edge long, to_edge long, cost double, via_edge long")
    arcs = paths.whole_costs(base)
    closed = closure_join(arcs.selectExpr("*", "0L AS current_cell"))
    via = paths.canonical_via(closed, arcs)
    want = {(a, b): c for a in {p[0] for p in pairs} for b, c in _dijkstra(_follow(pairs), a).items()}
    table = {(r.from_edge, r.to_edge): r for r in via.collect()}
    assert set(table) == set(want) and all(r.via_edge is not None and abs(r.cost - want[k]) < 1e-4 for k, r in table.items())
    step, walks = {(a, b): c for a, b, c in pairs}, {}
    for r in sorted(paths.walk(via, via).collect(), key=lambda r: r.pos):
        walks.setdefault((r.from_edge, r.to_edge), []).append(r.edge)
    assert set(walks) == set(want)
    for (a, b), edges in walks.items():
        assert (edges[0], edges[-1]) == (a, b) and len(set(edges)) == len(edges)
        assert abs(sum(step[h] for h in pairwise(edges)) - want[a, b]) < 1e-4


def test_chain_of_real_costs(spark):
    """41 segments of length / speed, where sums in another order differ in their last bits."""
    rng = random.Random(7)
    costs = [rng.uniform(5, 90) / rng.uniform(3, 30) for _ in range(41)]
    base = spark.createDataFrame([(i, i + 1, c, i + 1) for i, c in enumerate(costs)], "from_edge long, to_edge long, cost double, via_edge long")
    arcs = paths.whole_costs(base)
    via = paths.canonical_via(closure_join(arcs.selectExpr("*", "0L AS current_cell")), arcs)
    assert {(r.from_edge, r.to_edge): r.via_edge for r in via.collect()} == {(i, j): i + 1 for i in range(42) for j in range(i + 1, 42)}


def test_walk_names_what_is_missing(spark):
    schema = "from_edge long, to_edge long, via_edge long"
    with pytest.raises(ValueError, match="1 pairs have no next segment"):
        paths.walk(s := spark.createDataFrame([(1, 2, 2), (1, 3, None)], schema), s)
    with pytest.raises(ValueError, match="not in the table"):
        paths.walk(s := spark.createDataFrame([(1, 3, 2)], schema), s)
    assert paths.walk(s := spark.createDataFrame([(1, 2, 2)], schema), s.selectExpr("2L AS from_edge", "1L AS to_edge")).count() == 0


def test_few_pairs_need_few_jumps(spark, monkeypatch):
    """A table of jumps has a row for each start of the wanted ends, not for each pair."""
    n = 40
    via = spark.createDataFrame([(i, j, i + 1) for i in range(n) for j in range(i + 1, n)], "from_edge long, to_edge long, via_edge long")
    sizes = []
    whole = storage.cut

    def counted(df):
        out = whole(df)
        sizes.append((sorted(out.columns), out.count()))
        return out

    monkeypatch.setattr(paths, "cut", counted)
    wanted = spark.createDataFrame([(0, n - 1), (3, 9)], "from_edge long, to_edge long")
    rows = sorted((r.from_edge, r.pos, r.edge) for r in paths.walk(via, wanted).collect())
    assert rows == sorted([*((0, i, i) for i in range(n)), *((3, i - 3, i) for i in range(3, 10))])
    jumps = [k for columns, k in sizes if columns == ["edge", "jump", "to_edge"]]
    assert jumps and set(jumps) == {n - 1 + 9}


@pytest.mark.parametrize("pairs,most_arcs", [(1, 1 << 20), (7, 1 << 20), (10**6, 5), (10**6, 1 << 20)])
def test_grouped_kernel_by_blocks(spark, pairs, most_arcs, monkeypatch):
    """Blocks of starts give the pairs of the whole cell, none more than it may; vias split costs and have no cycles."""
    monkeypatch.setattr(closure_module, "MATRIX", 200)
    rows = [(a, b, c, b, cell) for cell, seed in ((7, 1), (8, 2)) for a, b, c in _real_network(seed, 14)] + [(1, 2, 1.0, 2, 9)]
    table = spark.createDataFrame(rows, ARCS)
    got = {(r.current_cell, r.from_edge, r.to_edge): r for r in closure_grouped(table, most_arcs, pairs).collect()}
    for cell in (7, 8, 9):
        follow = _follow([r[:3] for r in rows if r[4] == cell])
        want = {(cell, a, b): c for a in follow for b, c in _dijkstra(follow, a).items()}
        assert {k for k in got if k[0] == cell} == set(want)
        assert all(abs(got[k].cost - c) < 1e-9 for k, c in want.items())
    for (cell, a, b), r in got.items():
        seen = set()
        while (v := got[cell, a, b].via_edge) != b:
            assert v not in seen and abs(got[cell, a, v].cost + got[cell, v, b].cost - got[cell, a, b].cost) < 1e-9
            seen.add(v)
            b = v


def test_blocks_of_starts():
    """Each block gives the pairs of its own starts, about as many as the others."""
    rows = [(i, j, 1.0 + i, j, 0) for i in range(12) for j in range(12) if i != j]
    arcs = pd.DataFrame(rows, columns=["from_edge", "to_edge", "cost", "via_edge", "current_cell"])
    dealt = pd.concat([arcs.assign(block=k, blocks=5) for k in range(5)], ignore_index=True)
    for size in (7, 132, 1000):  # blocks end inside batches, and span them
        rows = pa.Table.from_pandas(dealt, preserve_index=False).to_batches(size)
        made = [pd.concat([pd.DataFrame(dict(zip(("from_edge", "to_edge"), columns))) for columns in closure_module._block_paths(block)]) for block in closure_module._groups(iter(rows))]
        assert [sorted(set(m.from_edge)) for m in made] == [list(range(k, 12, 5)) for k in range(5)]
        assert [len(m) for m in made] == [33, 33, 22, 22, 22]
        assert sum(b.num_rows for b in closure_module._group_paths(iter(rows))) == 132


def test_grouped_kernel_without_cells_and_middles(spark):
    """Rows without a cell take part in none, and rows without a middle segment are direct; ids above 2 ** 53 stay whole."""
    big = (1 << 60) + 1
    rows = [(1, big, 1.0, None, big), (big, 3, 2.0, 3, big), (1, 2, 1.0, 2, None), (2, 3, 1.0, 3, None), (1, 2, 5.0, 2, big + 2)]
    got = sorted(tuple(r) for r in closure_grouped(spark.createDataFrame(rows, ARCS)).collect())
    assert got == [(1, 2, 5.0, 2, big + 2), (1, 3, 3.0, big, big), (1, big, 1.0, big, big), (big, 3, 2.0, 3, big)]
    assert closure_grouped(spark.createDataFrame([], ARCS)).count() == 0


@pytest.mark.parametrize("seed", [1, 4])
def test_paths_between(spark, seed):
    pairs = _real_network(seed)
    base = spark.createDataFrame([(a, b, c, b) for a, b, c in pairs] + [(1, 99, None, 99), (2, 98, INF, 98)], "from_edge long, to_edge long, cost double, via_edge long")
    follow = _follow(pairs)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "edge long")
    for starts, ends, limit in (((0, 5, 44), (7, 60, 5, 777), 60.0), ((0, 3), None, 35.0), ((2,), (50, 51), INF), ((777,), (1,), INF), ((1, 2), (), INF)):
        got = {(r.from_edge, r.to_edge): r for r in closure_module.paths_between(base, ids(*starts), None if ends is None else ids(*ends), limit).collect()}
        want = {(a, b): c for a in starts for b, c in _dijkstra(follow, a).items() if (ends is None or b in ends) and c <= limit}
        assert set(got) == set(want) and all(abs(got[k].cost - c) < 1e-9 for k, c in want.items())


def test_work_of_paths_between_follows_the_starts(spark, monkeypatch):
    """On two chains that do not meet, only rows of the start's chain, and of its way to the end, are made."""
    pairs = [(i, i + 1, 1.0, i + 1) for k in (0, 1000) for i in range(k, k + 30)]
    sizes = []
    whole = closure_module.cut

    def counted(df):
        out = whole(df)
        if "key" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(closure_module, "cut", counted)
    base = spark.createDataFrame(pairs, "from_edge long, to_edge long, cost double, via_edge long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "edge long")
    assert [tuple(r)[:3] for r in closure_module.paths_between(base, ids(3), ids(8, 1008), 100.0).collect()] == [(3, 8, 5.0)]
    assert max(sizes) <= 9 + 9


def test_positions_are_ranges_of_descendants(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(400):
        a, b = (cell(rng.choice([3, 4]), *(rng.randrange(7) for _ in range(15))) for _ in "ab")
        rows.append((a, rng.choice([a, b]), rng.randrange(-1, 16), rng.randrange(-1, 16)))
    made = spark.createDataFrame(rows, "a long, b long, r long, s long").select(cells.parent("a", F.col("r")).alias("x"), cells.parent("b", F.col("s")).alias("y"))
    got = made.select(cells.contains("x", "y").alias("want"), cells.inside(cells.position("y"), F.col("x")).alias("got")).collect()
    assert all(r.want == r.got for r in got) and {r.want for r in got} == {True, False}


def _rows_read(df):
    """Rows that the scan gives, after row groups are skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while not plan.nodeName().startswith("Scan"):
        plan = plan.finalPhysicalPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.children().apply(0)
    return plan.metrics().apply("numOutputRows").value(), df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_scans_skip_what_a_cell_or_a_pair_does_not_need(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(40_000):
        c = cell(3, *(rng.randrange(3) for _ in range(6)))
        rows.append((i, rng.randrange(1 << 40), 1.0, i, 0, c))
    table = spark.createDataFrame(rows, "from_edge long, to_edge long, cost double, via_edge long, inside int, cell long").withColumn("cell", cells.parent("cell", F.pmod("from_edge", F.lit(7))))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        network.write_shortcuts(table.repartition(3), str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted = (cell(3, 1) & ~(15 << 52)) | (1 << 52) | ((1 << 42) - 1)
    part = network.shortcuts_inside(spark, str(tmp_path), wanted)
    read, plan = _rows_read(part)
    assert "GreaterThanOrEqual(cell_position" in plan and "LessThanOrEqual(cell_position" in plan
    assert part.count() == table.filter(cells.contains(F.lit(wanted), "cell")).count() > 0 and read < 40_000
    some = rows[77]
    found = network.lookup(spark, str(tmp_path), [(some[0], some[1]), (1, 1)])
    read, plan = _rows_read(found)
    assert [(r.from_edge, r.to_edge) for r in found.collect()] == [some[:2]] and read < 40_000 and "PushedFilters" in plan
    assert network.read_shortcuts(spark, str(tmp_path)).columns == table.columns


def test_sql_functions_are_inlined(spark):
    cells.register(spark)
    rng = random.Random(5)
    rows = [(cell(rng.choice([3, 4]), *(rng.randrange(7) for _ in range(rng.randrange(16)))), cell(3, *(rng.randrange(3) for _ in range(5))), rng.randrange(-1, 17)) for _ in range(200)] + [(0, cell(3), 2), (None, cell(3), 1)]
    spark.createDataFrame(rows, "a long, b long, r int").createOrReplaceTempView("some_cells")
    told = spark.sql("SELECT *, cell_parent(a, r) AS p, cell_lca(a, b) AS l, cell_lca_resolution(a, b) AS n, cell_contains(cell_lca(a, b), b) AS c FROM some_cells")
    plan = told._sc._jvm.PythonSQLUtils.explainString(told._jdf.queryExecution(), "formatted")
    assert "EvalPython" not in plan and "cell_parent(" not in plan
    same = told.select("*", cells.parent("a", F.col("r")).alias("p2"), cells.lca("a", "b").alias("l2"), cells.lca_resolution("a", "b").alias("n2"), cells.contains(cells.lca("a", "b"), "b").alias("c2"))
    assert all((r.p, r.l, r.n, r.c) == (r.p2, r.l2, r.n2, r.c2) for r in same.collect())


def test_a_build_keeps_few_tables(spark):
    """Two tables are left of all that the levels write, and never more than a level needs at a time."""
    here = Path(storage.shared_dir(spark).removeprefix("file://"))
    had, most = set(here.iterdir()), []
    whole = storage.cut

    def counted(df):
        out = whole(df)
        most.append(len(set(here.iterdir()) - had))
        return out

    rows, graph = _random_network(3, 12)
    for module in (hierarchy, closure_module):
        module.cut = counted
    try:
        out = build_shortcuts(_edges(spark, rows), _graph(spark, graph), Options(kernel="join"))
    finally:
        for module in (hierarchy, closure_module):
            module.cut = whole
    assert len(set(here.iterdir()) - had) == 2 and max(most) <= 9 < len(most)
    assert out.final().count() > 0


def _in_arrays(pairs, **kinds):
    """Rows as a task gets them: arcs, and by kind what else is said of segments."""
    rows = [(a, b, c, 0, 0.0) for a, b, c in pairs] + [row for more in kinds.values() for row in more]
    return dict(zip(("from_edge", "to_edge", "cost", "kind", "seconds"), map(np.array, zip(*rows))))


@pytest.mark.parametrize("core", [0, 7, 512])
def test_sweeps_find_least_costs(core, monkeypatch):
    """However few segments are left when elimination stops: against Dijkstra, with free cycles."""
    monkeypatch.setattr(sweeps, "CORE", core)
    pairs = _real_network(4)
    net = sweeps._prepared(_in_arrays(pairs))
    assert len(net["core"]) == min(core, len(net["ids"]))
    start, end, cost = next(sweeps.give_costs(net, sweeps._least(net, net["ends"]), net["ends"]))
    got = dict(zip(zip(start.tolist(), end.tolist()), cost.tolist()))
    want = {(a, b): c for a in {p[0] for p in pairs} for b, c in _dijkstra(_follow(pairs), a).items()}
    assert set(got) == set(want) and all(abs(got[k] - c) < 1e-9 for k, c in want.items())


def test_whole_closure_goes_by_sweeps(spark, monkeypatch):
    """Of pairs no table is written; a network with too many arcs for a task goes by joins."""
    base = spark.createDataFrame([(a, b, c, b) for a, b, c in _real_network(6)] + [(1, 99, None, 99), (2, 98, INF, 98), (3, 3, 1.0, 3)], "from_edge long, to_edge long, cost double, via_edge long")
    sizes, whole = [], storage.cut

    def counted(df):
        out = whole(df)
        sizes.append(out.count())
        return out

    for module in (closure_module, sweeps):
        monkeypatch.setattr(module, "cut", counted)
    got = {(r.from_edge, r.to_edge): r.cost for r in closure_whole(base).collect()}
    assert max(sizes) <= base.count() < len(got)
    monkeypatch.setattr(closure_module, "TASK_ARCS", 5)
    joined = {(r.from_edge, r.to_edge): r.cost for r in closure_whole(base).collect()}
    assert set(got) == set(joined) and all(abs(c - joined[k]) < 1e-9 for k, c in got.items())
    assert closure_whole(base.limit(0)).count() == 0


@pytest.mark.parametrize("core", [0, 7, 512])
def test_sweeps_find_next_segments(core, monkeypatch):
    """On whole-number costs: of the segments that lead on at least cost the least one, though many paths tie."""
    monkeypatch.setattr(sweeps, "CORE", core)
    rng = random.Random(8)
    step = {(a, b): ((rng.choice([0, 1, 2]) << 20) << 16) + 1 for a, b in {(rng.randrange(40), rng.randrange(40)) for _ in range(130)} if a != b}
    net = sweeps._prepared(_in_arrays([(a, b, c) for (a, b), c in step.items()]))
    start, end, seconds, via = next(sweeps.give_nexts(net, sweeps._least(net, net["ends"]), net["ends"]))
    follow = _follow([(a, b, c) for (a, b), c in step.items()])
    best = {a: _dijkstra(follow, a) | {a: 0} for a in range(40)}
    want = {(a, b): (int(c) >> 36, min(v for v, x in follow[a] if x + best[v].get(b, INF) == c)) for a in range(40) for b, c in best[a].items() if a != b}
    assert dict(zip(zip(start.tolist(), end.tolist()), zip(seconds.tolist(), via.tolist()))) == want


def test_next_segments_by_sweeps_and_by_joins(spark, monkeypatch):
    base = spark.createDataFrame([(a, b, c, b) for a, b, c in _real_network(9, 30)], "from_edge long, to_edge long, cost double, via_edge long")
    swept = sorted(map(tuple, paths.next_segments(base).collect()))
    monkeypatch.setattr(paths, "TASK_ARCS", 5)
    assert swept == sorted(map(tuple, paths.next_segments(base).collect())) and len(swept) > 200


def test_unpacking_between_some_ends(spark, monkeypatch):
    """Only tables of arcs and marks are written, no jumps; ends that are not there, or none at all, give nothing."""
    n = 40
    base = spark.createDataFrame([(i, i + 1, 1.0, i + 1) for i in range(n)], "from_edge long, to_edge long, cost double, via_edge long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "edge long")
    names, whole = [], storage.cut
    for module in (paths, sweeps):
        monkeypatch.setattr(module, "cut", lambda df: names.append(df.columns) or whole(df))
    rows = sorted((r.from_edge, r.to_edge, r.pos, r.edge) for r in paths.unpacked(base, ids(0, 30, 777), ids(9, 30, n, 888, None)).collect())
    assert rows == sorted((a, b, i - a, i) for a, b in ((0, 9), (0, 30), (0, n), (30, n)) for i in range(a, b + 1))
    assert names and not any("jump" in x for x in names)
    assert paths.unpacked(base, ids(0), ids()).count() == paths.unpacked(base.limit(0)).count() == 0


def test_whole_audit_finds_faults(spark):
    """Costs in a task that are too high by more than the tolerance are found by the arcs; those of the closure have none."""
    net = sweeps._prepared(_in_arrays([(i, i + 1, 1.0) for i in range(20)]))
    cost = sweeps._least(net, net["ends"])
    assert [x.tolist() for x in next(sweeps.give_gains(net, cost, net["ends"]))] == [[210], [0], [0.0]]
    cost[3, np.flatnonzero(net["ends"] == 9)] += 5
    assert [x.tolist() for x in next(sweeps.give_gains(net, cost, net["ends"]))] == [[210], [1], [5.0]]
    base = spark.createDataFrame([(a, b, c, b) for a, b, c in _real_network(2)], "from_edge long, to_edge long, cost double, via_edge long")
    whole = closure_join(base.selectExpr("*", "0L AS current_cell"))
    assert audit.audit_whole(base).first() == audit.audit_closed(whole, arcs=base).first()
    assert tuple(audit.audit_whole(base.limit(0)).first()) == (0, 0, 0.0)


def _in_arrays_whole(pairs, res):
    """With whole-number costs, and the resolution of some segments (None: a segment without one); seconds are the id's half."""
    segments = [(i, sweeps.NONE if r is None else r, 0, 3, i / 2) for i, r in res.items()]
    return _in_arrays([(a, b, (round(c * (1 << 20)) << 16) + 1) for a, b, c in pairs], segments=segments)


def test_ranges_without_unpacking():
    """Against the walk along next segments; unknown resolutions are left out, and null where a path has no other."""
    pairs = _real_network(11, 30)
    res = {i: None if i % 4 == 0 else i % 7 - 1 for i in range(28)}
    net = sweeps._prepared(_in_arrays_whole(pairs, res))
    cost = sweeps._least(net, net["ends"])
    start, end, _, via = next(sweeps.give_nexts(net, cost, net["ends"]))
    after = dict(zip(zip(start.tolist(), end.tolist()), via.tolist()))
    want = {}
    for a, b in after:
        walk = [a]
        while walk[-1] != b:
            walk.append(after[walk[-1], b])
        known = [res[i] for i in walk if res.get(i) is not None]
        want[a, b] = (len(walk), min(known, default=None), max(known, default=None))
    got = [x.tolist() for x in next(sweeps.give_ranges(net, cost, net["ends"]))]
    assert {(a, b): x for a, b, *x in zip(*got)} == {k: list(x) for k, x in want.items()}
    assert any(x[1] is None for x in want.values()) and max(x[0] for x in want.values()) > 8


def test_ranges_of_all_paths_by_sweeps_and_by_joins(spark, monkeypatch):
    pairs = _real_network(12, 20)
    base = spark.createDataFrame([(a, b, c, b) for a, b, c in pairs], "from_edge long, to_edge long, cost double, via_edge long")
    edges = spark.createDataFrame([(i, None if i == 3 else 1.0, None if i % 5 == 0 else i % 4) for i in range(19)], "id long, cost double, lca_res int")
    rows = [sorted(map(str, paths.unpacked_res_range(base, edges).collect()))]
    monkeypatch.setattr(paths, "TASK_ARCS", 5)
    assert rows[0] == sorted(map(str, paths.unpacked_res_range(base, edges).collect())) and len(rows[0]) > 100


def test_dense_cells_are_closed_without_joins(spark, monkeypatch):
    """A cell of more than 20,000 arcs, nearly all of its pairs: one matrix in a task, not a row for each way through a segment."""
    def joined(*_):
        raise AssertionError("goes by joins")

    monkeypatch.setattr(closure_module, "closure_join", joined)
    n, rng = 150, random.Random(10)
    arcs = [(a, b, float(rng.randrange(1, 99)), b, 0) for a in range(n) for b in range(n) if a != b]
    got = {(r.from_edge, r.to_edge): r.cost for r in closure_auto(spark.createDataFrame(arcs, ARCS)).collect()}
    follow = _follow([r[:3] for r in arcs])
    assert got == {(a, b): c for a in range(n) for b, c in _dijkstra(follow, a).items()}


def test_costs_of_some_pairs(spark):
    """Those that have a path, whatever the others are."""
    pairs = _real_network(14, 30)
    base = spark.createDataFrame([(a, b, c, b) for a, b, c in pairs], "from_edge long, to_edge long, cost double, via_edge long")
    best = {a: _dijkstra(_follow(pairs), a) for a in range(31)}
    wanted = [(a, b) for a in range(0, 31, 3) for b in range(31)] + [(777, 3), (3, 777), (None, 1), (2, None)]
    got = {(r.from_edge, r.to_edge): r.cost for r in closure_whole(base, spark.createDataFrame(wanted, "from_edge long, to_edge long")).collect()}
    want = {(a, b): best[a][b] for a, b in wanted if b in best.get(a, {}) and a != b}
    assert set(got) == set(want) and all(abs(got[k] - c) < 1e-9 for k, c in want.items())


def test_steps_of_paths_in_a_task():
    """Each path from its start to its end along arcs, place by place, at the cost of the pair."""
    pairs = _real_network(15, 30)
    net = sweeps._prepared(_in_arrays_whole(pairs, {}))
    cost = sweeps._least(net, net["ends"])
    walks = {}
    for a, b, pos, edge in sweeps.give_steps(net, cost, net["ends"]):
        for k, p, i in zip(zip(a.tolist(), b.tolist()), pos.tolist(), edge.tolist()):
            walks.setdefault(k, []).append(i)
            assert len(walks[k]) == p + 1
    step = {(a, b): c for a, b, c in pairs}
    want = {(a, b): c for a in {p[0] for p in pairs} for b, c in _dijkstra(_follow(pairs), a).items()}
    assert set(walks) == set(want)
    assert all((w[0], w[-1]) == k and abs(sum(step[h] for h in pairwise(w)) - want[k]) < 1e-4 for k, w in walks.items())


def test_all_paths_by_sweeps_and_by_joins(spark, monkeypatch):
    base = spark.createDataFrame([(a, b, c, b) for a, b, c in _real_network(16, 15)], "from_edge long, to_edge long, cost double, via_edge long")
    rows = sorted(map(tuple, paths.unpacked(base).collect()))
    monkeypatch.setattr(paths, "TASK_ARCS", 5)
    assert rows == sorted(map(tuple, paths.unpacked(base).collect())) and len(rows) > 300


def test_profiles_of_paths_in_a_task():
    """Seconds before a segment are those of the segments before it; what is not known of a segment is null."""
    chain = [(i, i + 1, 1.0) for i in range(9)]
    net = sweeps._prepared(_in_arrays_whole(chain, {i: None if i == 2 else i % 3 for i in range(9)}))
    rows = [row for x in sweeps.give_profiles(net, sweeps._least(net, net["ends"]), net["ends"]) for row in zip(*(pa.array(c).to_pylist() for c in x))]
    want = [(a, b, p, a + p, None if a + p == 9 else (a + p) / 2, sum(((a + q) / 2 for q in range(p)), 0.0), None if a + p in (2, 9) else (a + p) % 3) for a in range(9) for b in range(a + 1, 10) for p in range(b - a + 1)]
    assert sorted(map(str, rows)) == sorted(map(str, want))


def test_all_profiles_by_sweeps_and_by_joins(spark, monkeypatch):
    base = spark.createDataFrame([(a, b, c, b) for a, b, c in _real_network(17, 15)], "from_edge long, to_edge long, cost double, via_edge long")
    edges = spark.createDataFrame([(i, 1.5 * i, i % 4) for i in range(14)], "id long, cost double, lca_res int")
    rows = sorted(map(str, paths.unpacked_profile(base, edges).collect()))
    monkeypatch.setattr(paths, "TASK_ARCS", 5)
    assert rows == sorted(map(str, paths.unpacked_profile(base, edges).collect())) and len(rows) > 300


def test_a_round_of_joins_writes_one_table(spark, monkeypatch):
    """Forty segments in a chain take six rounds that improve paths and one that does not."""
    tables, whole = [], storage.cut
    monkeypatch.setattr(closure_module, "cut", lambda df: tables.append(1) or whole(df))
    arcs = spark.createDataFrame([(i, i + 1, 1.0, i + 1, 0) for i in range(40)], ARCS)
    assert closure_join(arcs).count() == 40 * 41 // 2 and len(tables) == 1 + 6 + 1


def test_a_round_of_joins_meets_fresh_rows_once(spark, monkeypatch):
    """Of fresh rows on both sides each way is made once, and of equal costs the known path keeps its middle."""
    made, once = [], closure_module.extend

    def counted(left, right):
        out = once(left, right)
        made.append(out.count())
        return out

    monkeypatch.setattr(closure_module, "extend", counted)
    rows = [(1, 2, 1.0, 2, 0), (2, 3, 1.0, 3, 0), (1, 3, 2.0, 3, 0), (3, 4, 1.0, 4, 0)]
    got = {(r.from_edge, r.to_edge): (r.cost, r.via_edge) for r in closure_join(spark.createDataFrame(rows, ARCS)).collect()}
    assert got[1, 3] == (2.0, 3) and got[1, 4][0] == 3.0 and made[0] == 3 and len(made) == 3


def test_middles_of_matrices_split_costs():
    """Middle segments lead to shorter and shorter hops that end in arcs, with free cycles too."""
    rng = random.Random(13)
    arcs = {(a, b): rng.choice([0.0, 1.0, 2.5, 7.0, 30.0]) for a in range(20) for b in range(20) if a != b and rng.random() < 0.6}
    rows = [(a, b, c, b, 0, 1, 0) for (a, b), c in arcs.items()]
    block = dict(zip(("from_edge", "to_edge", "cost", "via_edge", "current_cell", "blocks", "block"), map(np.array, zip(*rows))))
    made = list(closure_module._block_paths(block))
    assert len(made) == 1
    got = {(a, b): (c, v) for a, b, c, v in zip(*(x.tolist() for x in made[0]))}
    assert {k: c for k, (c, _) in got.items()} == {(a, b): c for a in range(20) for b, c in _dijkstra(_follow([(*k, c) for k, c in arcs.items()]), a).items()}

    def hops(a, b, depth=0):
        assert depth < 20
        cost, via = got[a, b]
        if via == b:
            assert arcs[a, b] == cost
            return 1
        assert got[a, via][0] + got[via, b][0] == cost
        return hops(a, via, depth + 1) + hops(via, b, depth + 1)

    assert max(hops(*k) for k in got) > 3


def test_profiles_of_whole_seconds_stay_whole():
    """Millionths of a second before a segment, summed in a task, are exact, as uneven_paths asks."""
    chain = [(i, i + 1, 1.0) for i in range(30)]
    micros = {i: 10**12 // (i + 3) for i in range(31)}
    rows = _in_arrays_whole(chain, {i: 1 for i in range(31)})
    told = rows["kind"] == 3
    rows["seconds"][told] = [float(micros[i]) for i in rows["from_edge"][told].tolist()]
    net = sweeps._prepared(rows)
    before = {(a, b, p): x for c in sweeps.give_profiles(net, sweeps._least(net, net["ends"]), net["ends"]) for a, b, p, x in zip(c[0].tolist(), c[1].tolist(), c[2].tolist(), c[5].tolist())}
    assert before == {(a, b, p): sum(micros[a + q] for q in range(p)) for a in range(30) for b in range(a + 1, 31) for p in range(b - a + 1)}
