"""DuckDB SQL with the results of the registered queries: recursive shortest paths, without any hierarchy."""

from __future__ import annotations


def res(c: str) -> str:
    return f"(CASE WHEN {c} = 0 THEN -1 ELSE ({c} >> 52) & 15 END)"


def parent(c: str, r: str) -> str:
    keep = ~(15 << 52)
    return f"(CASE WHEN {c} = 0 OR ({r}) < 0 THEN 0 WHEN ({r}) > {res(c)} THEN {c} ELSE ({c} & ({keep})) | (({r})::BIGINT << 52) | ((1::BIGINT << (3 * (15 - ({r})))::BIGINT) - 1) END)"


def lca_res(a: str, b: str) -> str:
    x = f"(xor({a}, {b}) & {(1 << 45) - 1})"
    low = f"least({res(a)}, {res(b)})"
    return f"(CASE WHEN {a} = 0 OR {b} = 0 OR (({a} >> 45) & 127) <> (({b} >> 45) & 127) THEN -1 WHEN {x} = 0 THEN {low} ELSE least({low}, 14 - ((length(bin({x})) - 1) // 3)) END)"


_BITS = "greatest(5, length(bin(w - 1)))"
_DIGITS = " + ".join(f"(CASE WHEN {_BITS} >= {k} THEN (((x >> greatest({_BITS} - {k}, 0)) & 1) + 2 * ((y >> greatest({_BITS} - {k}, 0)) & 1)) << {3 * (15 - k)} ELSE 0 END)" for k in range(1, 16))
_L = lca_res("n.cell", "m.cell")
_INNER, _OUTER = lca_res("a.to_cell", "b.from_cell"), lca_res("a.from_cell", "b.to_cell")
_PLACE = f"greatest(a.lca_res, b.lca_res) AS lca_res, a.lca_res AS a_res, b.lca_res AS b_res, {parent('a.to_cell', _INNER)} AS inner_cell, {parent('a.from_cell', _OUTER)} AS outer_cell, {_INNER} AS inner_res, {_OUTER} AS outer_res"

#: Nodes, segments, pairs.
NETWORK = f"""
w0 AS (SELECT ceil(sqrt(count(*)))::BIGINT AS w FROM supplier),
n0 AS (SELECT s_suppkey::BIGINT AS i, w, s_suppkey % w AS x, floor(s_suppkey / w::DOUBLE)::BIGINT AS y FROM supplier, w0),
n1 AS (SELECT *, {(1 << 59) + (15 << 52)} + CASE WHEN 4 * y >= 3 * w THEN {21 << 45} ELSE {20 << 45} END + {_DIGITS} AS cell FROM n0),
t0 AS (SELECT * FROM (VALUES (0, 1, 0), (1, -1, 0), (2, 0, 1), (3, 0, -1)) AS t(dir, dx, dy)),
e AS MATERIALIZED (
  SELECT 4 * n.i + dir AS id, n.cell AS from_cell, m.cell AS to_cell, ({_L})::INTEGER AS lca_res,
    (8 * (1 + (13 * n.x + 7 * n.y + 5 * dir) % 16))::DOUBLE AS length, power(2, (n.x + n.y + dir) % 4)::DOUBLE AS maxspeed,
    (8 * (1 + (13 * n.x + 7 * n.y + 5 * dir) % 16)) / power(2, (n.x + n.y + dir) % 4)::DOUBLE AS cost, n.i AS from_node, m.i AS to_node
  FROM n1 n, t0 JOIN n1 m ON m.x = n.x + dx AND m.y = n.y + dy WHERE (7 * n.x + 3 * n.y + dir) % 5 <> 0),
g AS MATERIALIZED (SELECT a.id AS from_edge, b.id AS to_edge FROM e a JOIN e b ON a.to_node = b.from_node),
b AS MATERIALIZED (SELECT from_edge, to_edge, cost, to_edge AS via_edge FROM (SELECT DISTINCT * FROM g) LEFT JOIN e ON from_edge = id),
placed AS (SELECT s.from_edge, s.to_edge, s.cost, s.via_edge, {_PLACE} FROM b s LEFT JOIN e a ON s.from_edge = a.id LEFT JOIN e b ON s.to_edge = b.id)"""

#: One step, and its merge with the pairs.
STEP = """
x1 AS (SELECT a.from_edge, c.to_edge, min(a.cost + c.cost) AS cost FROM b a JOIN b c ON a.to_edge = c.from_edge AND a.from_edge <> c.to_edge AND a.from_edge <> a.to_edge AND c.from_edge <> c.to_edge GROUP BY ALL),
m1 AS (SELECT from_edge, to_edge, min(cost) AS cost FROM (SELECT from_edge, to_edge, cost FROM b UNION ALL SELECT * FROM x1) GROUP BY ALL)"""


def closure(arcs: str, name: str = "p") -> str:
    """A recursive term: cheapest paths over the arcs (f, t, k, c), inside each k."""
    return f"""
{name}_arc AS MATERIALIZED ({arcs}),
{name}(f, t, k, c) USING KEY (f, t, k) AS (SELECT f, t, k, c FROM {name}_arc WHERE f <> t UNION
  (SELECT f, t, k, min(c) FROM (SELECT p.f, r.t, p.k, p.c + r.c AS c FROM {name} p JOIN {name}_arc r ON p.t = r.f AND p.k = r.k WHERE p.f <> r.t AND r.f <> r.t) n
   WHERE NOT EXISTS (SELECT 1 FROM recurring.{name} q WHERE q.f = n.f AND q.t = n.t AND q.k = n.k AND q.c <= n.c) GROUP BY f, t, k))"""


ALL = closure("SELECT from_edge AS f, to_edge AS t, 0::BIGINT AS k, cost AS c FROM b")


def published(pairs: str) -> str:
    return f"""SELECT from_edge, to_edge, cost, (CASE WHEN lca_res > inner_res THEN -2 WHEN a_res = b_res THEN 0 WHEN a_res < b_res THEN -1 ELSE 1 END)::INTEGER AS inside,
      {parent("outer_cell", "least(a_res, b_res)")} AS cell
    FROM (SELECT s.from_edge, s.to_edge, s.cost, {_PLACE} FROM {pairs} s JOIN e a ON s.from_edge = a.id JOIN e b ON s.to_edge = b.id) q
    WHERE lca_res <= inner_res OR lca_res <= outer_res"""


FINAL = f"final AS ({published('(SELECT f AS from_edge, t AS to_edge, c AS cost FROM p UNION ALL SELECT from_edge, to_edge, cost FROM b WHERE from_edge = to_edge)')})"


def assigned(level: int) -> str:
    sides = " UNION ".join(f"SELECT from_edge, to_edge, cost, {parent(f'{s}_cell', str(level))} AS current_cell FROM placed WHERE lca_res <= {level} AND {s}_res >= {level}" for s in ("inner", "outer"))
    return sides


def next_segments(cost: str, name: str = "via") -> tuple[str, str]:
    """Cheapest paths by whole costs, whose low bits count segments, and the segment after the first of each."""
    whole = f"floor(({cost}) * 1048576 + 0.5)::BIGINT * 65536 + 1"
    arcs = f"SELECT from_edge AS f, to_edge AS t, 0::BIGINT AS k, min({whole}) AS c FROM b WHERE from_edge <> to_edge GROUP BY ALL"
    return closure(arcs, f"{name}_w"), f"""
{name}_try AS (SELECT f, t, c, t AS m FROM {name}_w_arc UNION ALL SELECT a.f, w.t, a.c + w.c, a.t FROM {name}_w_arc a JOIN {name}_w w ON a.t = w.f WHERE a.f <> w.t),
{name} AS MATERIALIZED (SELECT f AS from_edge, t AS to_edge, floor(min(c) / 65536) / 1048576 AS cost, arg_min(m, (c, m)) AS via_edge FROM {name}_try GROUP BY ALL)"""


VIA = ",".join(next_segments("cost"))
UNPACK = """
un(from_edge, to_edge, pos, edge) AS (SELECT from_edge, to_edge, 0::BIGINT, from_edge FROM via
  UNION ALL SELECT u.from_edge, u.to_edge, u.pos + 1, v.via_edge FROM un u JOIN via v ON v.from_edge = u.edge AND v.to_edge = u.to_edge WHERE u.edge <> u.to_edge),
flat AS MATERIALIZED (SELECT * FROM un),
prof AS (SELECT f.*, e.cost AS edge_cost, coalesce(sum(e.cost) OVER (PARTITION BY from_edge, to_edge ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cost_before, e.lca_res FROM flat f JOIN e ON e.id = f.edge)"""
CROSSING = "SELECT id FROM e WHERE lca_res = -1"
HALVES = f"""
h1 AS (SELECT *, to_edge AS via_edge FROM ({published('b')})),
h3 AS MATERIALIZED (SELECT from_edge, to_edge, min(cost) AS cost, arg_min(via, (cost, via)) AS via_edge FROM (SELECT from_edge, to_edge, 2 * cost AS cost, to_edge AS via FROM b
  UNION ALL SELECT a.from_edge, c.to_edge, a.cost + c.cost, a.to_edge FROM b a JOIN b c ON a.to_edge = c.from_edge AND a.from_edge <> c.to_edge AND a.from_edge <> a.to_edge AND c.from_edge <> c.to_edge) GROUP BY ALL),
h2 AS (SELECT p.*, h3.via_edge FROM ({published('h3')}) p JOIN h3 USING (from_edge, to_edge))"""


def passes() -> tuple[str, list[tuple[str, int, int]]]:
    """Both passes over the levels, one after the other: what takes part at a level, what gets cheaper, and the pairs then."""
    steps = [("forward", r) for r in range(15, -2, -1)] + [("backward", r) for r in range(16)]
    parts = ["s0 AS MATERIALIZED (SELECT from_edge, to_edge, min(cost) AS cost FROM b WHERE cost IS NOT NULL GROUP BY ALL)"]
    for k, (_, level) in enumerate(steps, 1):
        sides = " UNION ALL ".join(f"SELECT from_edge, to_edge, cost, {parent(f'{x}_cell', str(level))} AS cell FROM q{k} WHERE lca_res <= {level} AND {x}_res >= {level}" for x in ("inner", "outer"))
        parts += [
            f"q{k} AS (SELECT s.from_edge, s.to_edge, s.cost, {_PLACE} FROM s{k - 1} s JOIN e a ON s.from_edge = a.id JOIN e b ON s.to_edge = b.id)",
            f"a{k} AS MATERIALIZED ({sides})",
            closure(f"SELECT from_edge AS f, to_edge AS t, cell AS k, min(cost) AS c FROM a{k} WHERE from_edge <> to_edge GROUP BY ALL", f"c{k}"),
            f"i{k} AS MATERIALIZED (SELECT n.* FROM (SELECT f AS from_edge, t AS to_edge, min(c) AS cost FROM c{k} GROUP BY ALL) n LEFT JOIN s{k - 1} s USING (from_edge, to_edge) WHERE s.cost IS NULL OR n.cost < s.cost)",
            f"s{k} AS MATERIALIZED (SELECT from_edge, to_edge, min(cost) AS cost FROM (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM i{k}) GROUP BY ALL)",
        ]
    return ",".join(x.strip() for x in parts), [(phase, level, k) for k, (phase, level) in enumerate(steps, 1)]


def _with(*parts: str, body: str) -> str:
    return f"WITH RECURSIVE {', '.join(p.strip() for p in (NETWORK, *parts))} {body}"


def _distribution(table: str, column: str) -> str:
    return f"SELECT {column}, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM {table})::DOUBLE AS percent FROM {table} GROUP BY {column}"


def oracle_sql() -> dict[str, str]:
    level2 = closure(f"SELECT from_edge AS f, to_edge AS t, current_cell AS k, cost AS c FROM ({assigned(2)})")
    by_cell = "SELECT f AS from_edge, t AS to_edge, c AS cost, k AS current_cell FROM p"
    final = _with(ALL, FINAL, body="SELECT * FROM final")
    faults = {"null_id": "e WHERE id IS NULL", "null_pair": "g WHERE from_edge IS NULL OR to_edge IS NULL", "null_cell": "e WHERE from_cell IS NULL OR to_cell IS NULL", "null_cost": "e WHERE length IS NULL OR maxspeed IS NULL", "impassable": "e WHERE maxspeed <= 0", "wrong_lca_res": f"e WHERE lca_res IS DISTINCT FROM {lca_res('from_cell', 'to_cell')}", "repeated_id": "(SELECT id FROM e GROUP BY id HAVING count(*) > 1)", "unknown_from_edge": "g ANTI JOIN e ON g.from_edge = e.id", "unknown_to_edge": "g ANTI JOIN e ON g.to_edge = e.id", "self_pair": "g WHERE from_edge = to_edge"}
    active = " UNION ALL ".join(f"SELECT {level} AS level, {parent(f'{s}_cell', str(level))} AS cell FROM placed WHERE lca_res <= {level} AND {s}_res >= {level}" for level in range(-1, 16) for s in ("inner", "outer"))
    both = "r.cost IS NOT NULL AND n.cost IS NOT NULL"
    levels, steps = passes()
    uneven = ",".join(next_segments("(SELECT length / (maxspeed * 0.3) FROM e WHERE id = from_edge)"))
    return {
        "uneven_via": _with(uneven, body="SELECT * FROM via"),
        "uneven_paths": _with(uneven, UNPACK, body="SELECT from_edge, to_edge, pos, edge, coalesce(sum(floor(length / (maxspeed * 0.3) * 1e6 + 0.5)::BIGINT) OVER (PARTITION BY from_edge, to_edge ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS micros_before FROM flat JOIN e ON e.id = edge"),
        "routes_within": _with(ALL, body=f"SELECT f AS from_edge, t AS to_edge, c AS cost FROM p WHERE f IN ({CROSSING}) AND t IN ({CROSSING}) AND c <= 400"),
        "routes_unpacked": _with(VIA, UNPACK, body=f"SELECT * FROM flat WHERE from_edge IN ({CROSSING}) AND to_edge IN ({CROSSING})"),
        "edge_costs": _with(body="SELECT id, from_node, to_node, length, maxspeed, cost FROM e"),
        "edge_lca": _with(body=f"SELECT id, from_cell, to_cell, lca_res, {parent('from_cell', lca_res('from_cell', 'to_cell'))} AS lca_cell, ({res('from_cell')})::INTEGER AS res, {parent('from_cell', '3')} AS parent_3 FROM e"),
        "base_pairs": _with(body="SELECT * FROM b"),
        "input_faults": _with(body=" UNION ALL ".join(f"SELECT '{k}' AS fault, count(*) AS n FROM {v}" for k, v in faults.items())),
        "pair_enrichment": _with(body="SELECT from_edge, to_edge, cost, via_edge, lca_res, inner_cell, outer_cell, inner_res::INTEGER AS inner_res, outer_res::INTEGER AS outer_res FROM placed"),
        "assign_level_2": _with(body=assigned(2)),
        "assign_level_global": _with(body=assigned(-1)),
        "finalize_base": _with(body=published("b")),
        "extend_once": _with(STEP, body="SELECT * FROM x1"),
        "merge_min": _with(STEP, body="SELECT * FROM m1"),
        "convergence_changes": _with(STEP, body="SELECT * FROM m1 WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.from_edge = m1.from_edge AND b.to_edge = m1.to_edge AND b.cost <= m1.cost)"),
        "closure_all": _with(ALL, body=by_cell),
        "closure_level_2_join": _with(level2, body=by_cell),
        "closure_level_2_grouped": _with(level2, body=by_cell),
        "closure_level_2_auto": _with(level2, body=by_cell),
        "shortcuts_mixed": final,
        "csv_edges": _with(body="SELECT id, from_cell, to_cell, lca_res, length, maxspeed, cost FROM e"),
        "csv_graph": _with(body="SELECT from_edge, to_edge FROM g"),
        "parquet_round_trip": _with(f"fb AS ({published('b')})", body="SELECT *, to_edge AS via_edge FROM fb"),
        "via_contract": _with(ALL, FINAL, VIA, body="SELECT count(*) AS published, count(*) FILTER (via_edge <> final.to_edge AND (c1.c IS NULL OR c2.c IS NULL OR abs(final.cost - c1.c - c2.c) > 1e-9)) AS broken FROM final LEFT JOIN via USING (from_edge, to_edge) LEFT JOIN p c1 ON c1.f = final.from_edge AND c1.t = via_edge LEFT JOIN p c2 ON c2.f = via_edge AND c2.t = final.to_edge"),
        "level_activity": _with(body=f"SELECT level::INTEGER AS level, sum(n)::BIGINT AS active, count(*) AS cells FROM (SELECT level, cell, count(*) AS n FROM ({active}) GROUP BY ALL) GROUP BY level"),
        "level_stats": _with(levels, body=" UNION ALL ".join(f"SELECT '{phase}' AS phase, {level}::INTEGER AS level, (SELECT count(*) FROM a{k}) AS active, (SELECT count(*) FROM i{k}) AS improved" for phase, level, k in steps)),
        "watch_trace": _with(levels, "top AS MATERIALIZED (SELECT from_edge, to_edge FROM b WHERE from_edge <> to_edge ORDER BY from_edge DESC, to_edge DESC LIMIT 5)", body=" UNION ALL ".join(f"SELECT '{phase}' AS phase, {level}::INTEGER AS level, from_edge, to_edge, cost FROM s{k} JOIN top USING (from_edge, to_edge)" for phase, level, k in steps)),
        "inside_cell": _with(f"fb AS ({published('b')})", f"one AS (SELECT arg_max({parent('from_cell', '1')}, id) AS x FROM e)", body=f"SELECT fb.*, to_edge AS via_edge FROM fb, one WHERE {parent('cell', res('x'))} = x"),
        "lookup_pairs": _with(f"fb AS ({published('b')})", body="SELECT fb.*, to_edge AS via_edge, lca_res, inner_cell, outer_cell, inner_res::INTEGER AS inner_res, outer_res::INTEGER AS outer_res FROM (SELECT * FROM fb ORDER BY from_edge DESC, to_edge DESC LIMIT 5) fb JOIN placed USING (from_edge, to_edge)"),
        "sql_cells": _with(body=f"SELECT id, ({res('from_cell')})::INTEGER AS res, ((from_cell >> 45) & 127)::INTEGER AS base, {parent('to_cell', '3')} AS parent_3, lca_res, {parent('from_cell', lca_res('from_cell', 'to_cell'))} AS lca_cell, {parent('to_cell', res(parent('from_cell', '2')))} = {parent('from_cell', '2')} AS near FROM e"),
        "sample_pairs": _with(body="SELECT from_edge, to_edge, cost FROM b ORDER BY md5(from_edge || '-' || to_edge || '-42'), from_edge, to_edge LIMIT 50"),
        "shortcuts_join": final,
        "shortcuts_grouped": final,
        "shortcuts_auto": final,
        "audit_closed": _with(ALL, body="SELECT count(*) AS pairs, count(*) FILTER (c - two > 1e-9) AS improvable, coalesce(max(CASE WHEN c - two > 1e-9 THEN c - two END), 0)::DOUBLE AS max_gain FROM p LEFT JOIN (SELECT a.f, d.t, min(a.c + d.c) AS two FROM p a JOIN p d ON a.t = d.f AND a.f <> d.t GROUP BY ALL) q USING (f, t)"),
        "audit_optimal": _with(ALL, FINAL, body="SELECT count(*) AS pairs, count(*) FILTER (abs(cost - c) <= 1e-6) AS optimal, count(*) FILTER (c IS NULL) AS unreachable, coalesce(avg(cost - c), 0)::DOUBLE AS mean_excess, coalesce(max(cost - c), 0)::DOUBLE AS max_excess FROM final LEFT JOIN p ON f = from_edge AND t = to_edge"),
        "compare_outputs": _with(STEP, HALVES, body=f"SELECT count(r.cost) AS ref_rows, count(n.cost) AS new_rows, count(*) FILTER ({both}) AS matched, count(*) FILTER (n.cost IS NULL) AS only_ref, count(*) FILTER (r.cost IS NULL) AS only_new, count(*) FILTER (abs(r.cost - n.cost) > 1e-6) AS cost_differs, count(*) FILTER ({both} AND r.inside IS DISTINCT FROM n.inside) AS inside_differs, count(*) FILTER ({both} AND r.cell IS DISTINCT FROM n.cell) AS cell_differs, count(*) FILTER ({both} AND r.via_edge IS DISTINCT FROM n.via_edge) AS via_differs, coalesce(max(abs(r.cost - n.cost)), 0)::DOUBLE AS max_gap, coalesce(avg(abs(r.cost - n.cost)), 0)::DOUBLE AS mean_gap FROM h1 r FULL JOIN h2 n ON r.from_edge = n.from_edge AND r.to_edge = n.to_edge"),
        "top_differences": _with(STEP, HALVES, body="SELECT r.from_edge, r.to_edge, r.cost AS ref_cost, n.cost AS new_cost, abs(r.cost - n.cost) AS gap FROM h1 r JOIN h2 n ON r.from_edge = n.from_edge AND r.to_edge = n.to_edge WHERE r.cost <> n.cost ORDER BY gap DESC, 1, 2 LIMIT 10"),
        "inside_distribution": _with(ALL, FINAL, body=_distribution("final", "inside")),
        "lca_res_distribution": _with(body=_distribution("e", "lca_res")),
        "top_speeds": _with(body="SELECT maxspeed, count(*) AS n FROM e GROUP BY maxspeed ORDER BY n DESC, maxspeed LIMIT 3"),
        "canonical_via": _with(VIA, body="SELECT * FROM via"),
        "unpack_path": _with(VIA, UNPACK, body="SELECT * FROM flat"),
        "path_profile": _with(VIA, UNPACK, body="SELECT from_edge, to_edge, pos, edge, edge_cost, cost_before, lca_res FROM prof"),
        "path_res_range": _with(VIA, UNPACK, body="SELECT from_edge, to_edge, count(*) AS n_edges, min(lca_res) AS min_res, max(lca_res) AS max_res FROM prof GROUP BY ALL"),
        "unpack_all_paths": _with(VIA, UNPACK, body="SELECT * FROM flat"),
        "all_path_profiles": _with(VIA, UNPACK, body="SELECT from_edge, to_edge, pos, edge, edge_cost, cost_before, lca_res FROM prof"),
        "all_path_res_ranges": _with(VIA, UNPACK, body="SELECT from_edge, to_edge, count(*) AS n_edges, min(lca_res) AS min_res, max(lca_res) AS max_res FROM prof GROUP BY ALL"),
        "route_cost": _with(body="SELECT from_edge, to_edge, b.cost + e.cost AS route_cost FROM b LEFT JOIN e ON to_edge = id"),
        "explain_pair": _with(body="SELECT from_edge, to_edge, lca_res, inner_cell, inner_res::INTEGER AS inner_res, outer_cell, outer_res::INTEGER AS outer_res, greatest(inner_res - lca_res + 1, 0)::INTEGER AS inner_levels, greatest(outer_res - lca_res + 1, 0)::INTEGER AS outer_levels FROM placed"),
        "cell_prune": _with(f"fb AS ({published('b')})", body=f"SELECT from_edge, to_edge, cell, {parent('from_cell', '2')} AS high_cell FROM fb JOIN e ON from_edge = id WHERE {parent('cell', res(parent('from_cell', '2')))} = {parent('from_cell', '2')}"),
    }
