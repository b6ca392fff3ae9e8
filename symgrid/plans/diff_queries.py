"""Queries of diffs between consecutive exports, with SQL to compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from symgrid.operators.diffs import Diff
from symgrid.plans.explore import Explore
from symgrid.plans.registry import query

C = F.col

#: pr: pairs of exports; sy: the symbols of each; st: what became of each symbol between the two of a pair.
_PAIRS = """, ex AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY exported_at, repo_id) AS o FROM snapshots WHERE export_state = 'complete'),
pr AS (SELECT a.repo_id AS repo_a, b.repo_id AS repo_b FROM ex a JOIN ex b ON a.project = b.project AND a.o + 1 = b.o)"""
_STATUS = f"""{_PAIRS},
sy AS (SELECT *, module || '::' || name AS symbol, CASE WHEN strpos(hash, ':') = 0 THEN hash ELSE substr(hash, strpos(hash, ':') + 1) END AS body FROM n WHERE module IS NOT NULL AND name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo_id, module || '::' || name ORDER BY hash DESC) = 1),
sa AS (SELECT pr.*, sy.* EXCLUDE (repo_id) FROM pr JOIN sy ON sy.repo_id = repo_a), sb AS (SELECT pr.*, sy.* EXCLUDE (repo_id) FROM pr JOIN sy ON sy.repo_id = repo_b),
st AS (SELECT coalesce(b.repo_a, a.repo_a) AS repo_a, coalesce(b.repo_b, a.repo_b) AS repo_b, coalesce(b.symbol, a.symbol) AS symbol, CASE WHEN a.symbol IS NULL THEN 'added' WHEN b.symbol IS NULL THEN 'removed' WHEN a.body <> b.body THEN 'modified' ELSE 'unchanged' END AS status,
  CASE WHEN b.symbol IS NULL THEN a.name ELSE b.name END AS name, CASE WHEN b.symbol IS NULL THEN a.module ELSE b.module END AS module, CASE WHEN b.symbol IS NULL THEN a.kind ELSE b.kind END AS kind, CASE WHEN b.symbol IS NULL THEN a.file_path ELSE b.file_path END AS file_path, CASE WHEN b.symbol IS NULL THEN a.caller_count ELSE b.caller_count END AS caller_count
  FROM sa a FULL OUTER JOIN sb b ON a.repo_a = b.repo_a AND a.repo_b = b.repo_b AND a.symbol = b.symbol),
ma AS (SELECT pr.*, caller_module AS f, callee_module AS t, edge_count FROM pr JOIN me ON me.repo_id = repo_a), mb AS (SELECT pr.*, caller_module AS f, callee_module AS t, edge_count FROM pr JOIN me ON me.repo_id = repo_b),
md AS (SELECT repo_a, repo_b, f, t, 'added' AS status, edge_count AS count FROM mb WHERE (repo_a, repo_b, f, t) NOT IN (SELECT (repo_a, repo_b, f, t) FROM ma) UNION ALL SELECT repo_a, repo_b, f, t, 'removed', edge_count FROM ma WHERE (repo_a, repo_b, f, t) NOT IN (SELECT (repo_a, repo_b, f, t) FROM mb))
"""


@query(f"{_STATUS} SELECT * FROM st")
def diff_status(c):
    return Diff(c).status


@query(f"""{_STATUS} SELECT pr.*, coalesce(added, 0) AS added, coalesce(modified, 0) AS modified, coalesce(unchanged, 0) AS unchanged, coalesce(removed, 0) AS removed, coalesce(similarity, 0) AS similarity, coalesce(module_edges_added, 0) AS module_edges_added, coalesce(module_edges_removed, 0) AS module_edges_removed FROM pr
LEFT JOIN (SELECT repo_a, repo_b, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'removed') AS removed, round_even(count(*) FILTER (status IN ('modified', 'unchanged')) / count(*), 3) AS similarity FROM st GROUP BY 1, 2) s ON s.repo_a = pr.repo_a AND s.repo_b = pr.repo_b
LEFT JOIN (SELECT repo_a, repo_b, count(*) FILTER (status = 'added') AS module_edges_added, count(*) FILTER (status = 'removed') AS module_edges_removed FROM md GROUP BY 1, 2) m ON m.repo_a = pr.repo_a AND m.repo_b = pr.repo_b""")
def diff_summary(c):
    return Diff(c).summary()


@query(f"{_STATUS} SELECT repo_a, repo_b, status, CAST(row_number() OVER (PARTITION BY repo_a, repo_b, status ORDER BY module, name) AS INTEGER) AS row_no, module, name, kind, caller_count FROM st WHERE status IN ('added', 'removed') QUALIFY row_no <= 50")
def diff_symbol_lists(c):
    return Diff(c).symbol_lists()


@query(f'{_STATUS} SELECT repo_a, repo_b, status, CAST(row_number() OVER (PARTITION BY repo_a, repo_b, status ORDER BY f, t) AS INTEGER) AS row_no, f AS "from", t AS "to", count FROM md QUALIFY row_no <= 30')
def diff_module_edge_lists(c):
    return Diff(c).module_edge_lists()


_GRAPH = f"""{_STATUS},
ce AS (SELECT DISTINCT e.repo_id, a.symbol AS src, b.symbol AS dst FROM e JOIN sy a ON a.repo_id = e.repo_id AND a.hash = caller_hash JOIN sy b ON b.repo_id = e.repo_id AND b.hash = callee_hash),
cs AS (SELECT pr.*, 'a' AS side, src, dst FROM pr JOIN ce ON ce.repo_id = repo_a UNION ALL SELECT pr.*, 'b', src, dst FROM pr JOIN ce ON ce.repo_id = repo_b),
nb AS (SELECT repo_a, repo_b, side, src AS symbol, dst AS near, 'callee' AS role FROM cs UNION ALL SELECT repo_a, repo_b, side, dst, src, 'caller' FROM cs),
rk AS (SELECT c.repo_a, c.repo_b, nb.near, coalesce(w.caller_count, 0) AS k, w.status AS near_status, CASE WHEN c.status = 'modified' THEN 3 ELSE 4 END AS most, row_number() OVER (PARTITION BY c.repo_a, c.repo_b, c.symbol, role ORDER BY coalesce(w.caller_count, 0) DESC, near) AS r
  FROM st c JOIN nb ON nb.repo_a = c.repo_a AND nb.repo_b = c.repo_b AND nb.symbol = c.symbol AND nb.side = CASE WHEN c.status = 'removed' THEN 'a' ELSE 'b' END JOIN st w ON w.repo_a = c.repo_a AND w.repo_b = c.repo_b AND w.symbol = near WHERE c.status <> 'unchanged'),
cx AS (SELECT DISTINCT repo_a, repo_b, near, k FROM rk WHERE r <= most AND near_status = 'unchanged'),
nc AS (SELECT repo_a, repo_b, count(*) AS changed FROM st WHERE status <> 'unchanged' GROUP BY ALL),
ck AS (SELECT repo_a, repo_b, near FROM (SELECT cx.*, changed, row_number() OVER (PARTITION BY cx.repo_a, cx.repo_b ORDER BY k DESC, near) AS r, count(*) OVER (PARTITION BY cx.repo_a, cx.repo_b) AS total FROM cx JOIN nc ON nc.repo_a = cx.repo_a AND nc.repo_b = cx.repo_b) WHERE total + changed <= 120 OR r <= 120 - changed),
dn AS (SELECT repo_a, repo_b, symbol, name, module, kind, caller_count, status FROM st WHERE status <> 'unchanged' UNION ALL SELECT st.repo_a, st.repo_b, symbol, name, module, kind, caller_count, 'context' FROM st JOIN ck ON ck.repo_a = st.repo_a AND ck.repo_b = st.repo_b AND ck.near = st.symbol),
de AS (SELECT repo_a, repo_b, src, dst, CASE WHEN count(DISTINCT side) = 2 THEN 'unchanged' WHEN min(side) = 'b' THEN 'added' ELSE 'removed' END AS status FROM cs WHERE (repo_a, repo_b, src) IN (SELECT (repo_a, repo_b, symbol) FROM dn) AND (repo_a, repo_b, dst) IN (SELECT (repo_a, repo_b, symbol) FROM dn) GROUP BY ALL)"""
_TURNED = "regexp_replace({x}, '^(.*?)::(.*)$', '\\2::\\1')"


@query(f"{_GRAPH} SELECT repo_a, repo_b, name || '::' || module AS id, name, module, kind, caller_count, status FROM dn")
def diff_graph_nodes(c):
    return Diff(c).graph()[0]


@query(f"{_GRAPH} SELECT repo_a, repo_b, {_TURNED.format(x='src')} AS source, {_TURNED.format(x='dst')} AS target, status FROM de")
def diff_graph_edges(c):
    return Diff(c).graph()[1]


@query(f"{_GRAPH} SELECT repo_a, repo_b, {_TURNED.format(x='src')} AS source, {_TURNED.format(x='dst')} AS target, status FROM de WHERE (repo_a, repo_b, src) IN (SELECT (repo_a, repo_b, symbol) FROM dn WHERE status <> 'context') AND (repo_a, repo_b, dst) IN (SELECT (repo_a, repo_b, symbol) FROM dn WHERE status <> 'context')")
def diff_changed_only(c):
    d = Diff(c)
    return d.changed_only(*d.graph())[1]


_OVERLAY = f"""{_STATUS}, ov AS (SELECT pr.repo_a, pr.repo_b AS repo_id, n.module, count(*) AS symbol_count, round(avg(CASE st.status WHEN 'added' THEN 0.0 WHEN 'modified' THEN 0.25 WHEN 'removed' THEN 1.0 ELSE 0.5 END), 3) AS diff_status_value
FROM pr JOIN n ON n.repo_id = pr.repo_b LEFT JOIN st ON st.repo_a = pr.repo_a AND st.repo_b = pr.repo_b AND st.symbol = n.module || '::' || n.name GROUP BY ALL)"""


@query(f"{_OVERLAY} SELECT * FROM ov")
def diff_overlay(c):
    return Diff(c).overlay(Explore(c, ["module"], ["symbol_count"]))


@query(f"{_OVERLAY} SELECT repo_a, repo_id, count(*) FILTER (diff_status_value = 0) AS added, count(*) FILTER (diff_status_value = 0.25) AS modified, count(*) FILTER (diff_status_value = 0.5) AS unchanged, count(*) FILTER (diff_status_value = 1) AS removed FROM ov GROUP BY 1, 2")
def diff_legend(c):
    d = Diff(c)
    return d.legend(d.overlay(Explore(c, ["module"], ["symbol_count"])))


@query(f"{_OVERLAY} SELECT repo_a, repo_id, module AS id, diff_status_value FROM ov WHERE diff_status_value < 0.49 AND module IS NOT NULL")
def diff_highlighted(c):
    d = Diff(c)
    return d.highlighted(d.overlay(Explore(c, ["module"], ["symbol_count"])), "module")


def _edges(dimension: str, value: str) -> str:
    return f"""{_STATUS}, g AS (SELECT repo_id, hash, module || '::' || name AS symbol, {value} AS d FROM n), ge AS (SELECT e.repo_id, a.d AS source, b.d AS target, count(*) AS weight FROM e JOIN g a ON a.repo_id = e.repo_id AND a.hash = caller_hash JOIN g b ON b.repo_id = e.repo_id AND b.hash = callee_hash WHERE a.d <> b.d GROUP BY ALL),
cg AS (SELECT DISTINCT st.repo_a, st.repo_b, g.d FROM st JOIN g ON g.symbol = st.symbol AND g.repo_id IN (st.repo_a, st.repo_b) WHERE st.status <> 'unchanged')
SELECT pr.repo_a, pr.repo_b, source, target, weight, CASE WHEN (repo_a, source, target) NOT IN (SELECT (repo_id, source, target) FROM ge) THEN 'added' WHEN (repo_a, repo_b, source) IN (SELECT (repo_a, repo_b, d) FROM cg) OR (repo_a, repo_b, target) IN (SELECT (repo_a, repo_b, d) FROM cg) THEN 'modified' ELSE 'unchanged' END AS diff_status FROM pr JOIN ge ON ge.repo_id = repo_b"""


@query(_edges("module", "module"))
def diff_edges_of_modules(c):
    return Diff(c).edge_overlay(Explore(c), "module")


@query(_edges("symbol", "module || '::' || name"))
def diff_edges_of_symbols(c):
    return Diff(c).edge_overlay(Explore(c), "symbol")


@query(f"""{_PAIRS}, top AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY caller_count DESC NULLS LAST, hash) <= 120), lay AS (SELECT *, CASE WHEN p > 0.6 THEN 0 WHEN p > 0.3 THEN 1 WHEN p > 0.1 THEN 2 WHEN p > 0.02 THEN 3 ELSE 4 END AS layer FROM (
  SELECT *, coalesce(caller_count / nullif(max(caller_count) OVER (PARTITION BY repo_id), 0), 0) AS p FROM top WHERE name IS NOT NULL AND module IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY repo_id, name, module ORDER BY hash DESC) = 1),
a AS (SELECT pr.*, lay.* EXCLUDE (repo_id) FROM pr JOIN lay ON lay.repo_id = repo_a), b AS (SELECT pr.*, lay.* EXCLUDE (repo_id) FROM pr JOIN lay ON lay.repo_id = repo_b)
SELECT repo_a, repo_b, name, module, CASE WHEN b.hash IS NULL THEN 'removed' WHEN a.hash IS NULL THEN 'added' ELSE 'common' END AS diff_status, CASE WHEN b.hash IS NULL THEN a.hash ELSE b.hash END AS hash, CASE WHEN b.hash IS NULL THEN a.layer ELSE b.layer END AS layer, CASE WHEN b.hash IS NULL THEN a.caller_count ELSE b.caller_count END AS caller_count
FROM a FULL OUTER JOIN b USING (repo_a, repo_b, name, module)""")
def diff_building(c):
    return Diff(c).building()[0].select("repo_a", "repo_b", "name", "module", "diff_status", "hash", "layer", "caller_count")


@query(f"""{_PAIRS}, top AS (SELECT repo_id, hash FROM n QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY caller_count DESC NULLS LAST, hash) <= 120), be AS (SELECT e.repo_id, caller_hash AS source, callee_hash AS target FROM e JOIN top a ON a.repo_id = e.repo_id AND a.hash = caller_hash JOIN top b ON b.repo_id = e.repo_id AND b.hash = callee_hash)
SELECT pr.*, source, target FROM pr JOIN be ON be.repo_id = repo_a UNION ALL SELECT pr.*, source, target FROM pr JOIN be ON be.repo_id = repo_b""")
def diff_building_edges(c):
    return Diff(c).building()[1]
