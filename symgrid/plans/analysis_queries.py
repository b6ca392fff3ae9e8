"""Queries of coupling, module graph, dead code, load-bearing symbols, layers, cycles, details and triage, with SQL to compare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrid.functions import scalars
from symgrid.operators import analyses as A
from symgrid.operators import details
from symgrid.plans.registry import REACH, query
from symgrid.sources.catalog import Catalog

C = F.col

# coupling

_COUP = """coup AS (SELECT repo_id, module, CAST(coalesce(sum(ca), 0) AS BIGINT) AS ca, CAST(coalesce(sum(ce), 0) AS BIGINT) AS ce FROM (
SELECT repo_id, callee_module AS module, edge_count AS ca, 0 AS ce FROM me WHERE caller_module <> callee_module UNION ALL SELECT repo_id, caller_module, 0, edge_count FROM me WHERE caller_module <> callee_module) GROUP BY ALL)"""
_INSTABILITY = "round_even(CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) > 0 THEN ce / (ca + ce) ELSE 0 END, 3) AS instability"


@query(f", {_COUP} SELECT repo_id, module, ca, ce, {_INSTABILITY} FROM coup")
def coupling(c):
    return A.coupling(c)


_STATS = f"""{_COUP}, stats AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY ca + ce DESC, module) AS INTEGER) AS row_no FROM (
SELECT s.repo_id, s.module, symbol_count, total_complexity, avg_complexity, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, {_INSTABILITY} FROM (
SELECT repo_id, module, count(*) AS symbol_count, CAST(coalesce(sum(complexity), 0) AS BIGINT) AS total_complexity, round_even(coalesce(round(avg(complexity), 6), 0), 2) AS avg_complexity FROM n WHERE module IS NOT NULL GROUP BY ALL) s
LEFT JOIN coup ON coup.repo_id = s.repo_id AND coup.module = s.module))"""


@query(f", {_STATS} SELECT * FROM stats")
def module_stats(c):
    return A.module_stats(c)


@query(f""", {_STATS}, top AS (SELECT * FROM stats WHERE row_no <= 12), k AS (SELECT repo_id, caller_module, callee_module, CAST(sum(edge_count) AS BIGINT) AS count FROM me GROUP BY ALL), most AS (SELECT repo_id, greatest(max(count), 1) AS most FROM k GROUP BY 1)
SELECT repo_id, caller_module, callee_module, caller_no, callee_no, count, round(r, 6) AS ratio, CASE WHEN r > 0.6 THEN 3 WHEN r > 0.3 THEN 2 WHEN r > 0 THEN 1 ELSE 0 END AS heat FROM (
SELECT a.repo_id, a.module AS caller_module, b.module AS callee_module, a.row_no AS caller_no, b.row_no AS callee_no, coalesce(count, 0) AS count, coalesce(count, 0) / coalesce(most, 1) AS r FROM top a JOIN top b ON a.repo_id = b.repo_id
LEFT JOIN k ON k.repo_id = a.repo_id AND k.caller_module = a.module AND k.callee_module = b.module LEFT JOIN most ON most.repo_id = a.repo_id)""")
def heatmap(c):
    return A.heatmap(c)


def _rolled(column: str, depth: int) -> str:
    return f"CASE WHEN coalesce({column}, '') = '' THEN '__unknown__' WHEN {column} LIKE '\\_\\_%' ESCAPE '\\' THEN {column} ELSE array_to_string(string_split(replace({column}, '/', '.'), '.')[:{depth}], '.') END"


_HIDDEN = "LIKE '\\_\\_%' ESCAPE '\\'"
_MG = f"""mg AS (SELECT repo_id, module, count(*) AS k, coalesce(sum(complexity), 0) AS x, {_rolled("module", 2)} AS id FROM n WHERE module IS NOT NULL GROUP BY ALL),
deep AS (SELECT repo_id, CAST(least(6, coalesce(max(CASE WHEN module NOT {_HIDDEN} THEN len(string_split(replace(module, '/', '.'), '.')) END), 1)) AS INTEGER) AS max_depth FROM mg GROUP BY 1),
mn AS (SELECT repo_id, id, CAST(sum(k) AS BIGINT) AS symbol_count, CAST(sum(x) AS BIGINT) AS complexity, count(*) FILTER (module <> id) AS submodule_count FROM mg WHERE id NOT {_HIDDEN} GROUP BY ALL),
re AS (SELECT repo_id, src, dst, CAST(sum(k) AS BIGINT) AS count FROM (SELECT repo_id, {_rolled("caller_module", 2)} AS src, {_rolled("callee_module", 2)} AS dst, coalesce(edge_count, 0) AS k FROM me) GROUP BY ALL),
cross_ AS (SELECT * FROM re WHERE src <> dst AND src NOT {_HIDDEN} AND dst NOT {_HIDDEN}),
gn AS (SELECT mn.*, CAST(coalesce((SELECT sum(count) FROM cross_ c WHERE c.repo_id = mn.repo_id AND c.dst = mn.id), 0) AS BIGINT) AS afferent, CAST(coalesce((SELECT sum(count) FROM cross_ c WHERE c.repo_id = mn.repo_id AND c.src = mn.id), 0) AS BIGINT) AS efferent,
CAST(coalesce((SELECT sum(count) FROM re WHERE re.repo_id = mn.repo_id AND re.src = mn.id AND re.dst = mn.id), 0) AS BIGINT) AS intra_calls, max_depth FROM mn JOIN deep ON deep.repo_id = mn.repo_id),
gi AS (SELECT *, round_even(CASE WHEN afferent + efferent > 0 THEN efferent / (afferent + efferent) ELSE 0.5 END, 3) AS instability FROM gn)"""


@query(f", {_MG} SELECT * FROM gi")
def module_graph_nodes(c):
    return A.module_graph(c)[0]


@query(f""", {_MG} SELECT c.repo_id, src AS "from", dst AS "to", count, round_even(count / nullif(most, 0), 3) AS weight FROM cross_ c JOIN (SELECT repo_id, max(count) AS most FROM cross_ GROUP BY 1) m ON m.repo_id = c.repo_id
WHERE (c.repo_id, src) IN (SELECT (repo_id, id) FROM mn) AND (c.repo_id, dst) IN (SELECT (repo_id, id) FROM mn)""")
def module_graph_edges(c):
    return A.module_graph(c)[1]


@query(f""", {_MG} SELECT repo_id, count(*) AS modules, CAST(sum(symbol_count) AS BIGINT) AS symbols, round(avg(instability), 2) AS avg_instability, first(id ORDER BY afferent + efferent DESC, id) AS most_coupled FROM gi GROUP BY 1""")
def module_graph_totals(c):
    return A.module_graph_totals(A.module_graph(c)[0])


_FANIN = """fan AS (SELECT n.repo_id, n.hash, count(DISTINCT s.module) AS calling_module_count FROM n JOIN e ON e.repo_id = n.repo_id AND e.callee_hash = n.hash JOIN alln s ON s.repo_id = e.repo_id AND s.hash = e.caller_hash
WHERE s.module IS NOT NULL AND s.module <> n.module AND s.module <> '__external__' GROUP BY ALL)"""


def _high(least: int, limit: int) -> str:
    return f"""SELECT n.repo_id, CAST(row_number() OVER (PARTITION BY n.repo_id ORDER BY calling_module_count DESC, caller_count DESC NULLS LAST, n.hash) AS INTEGER) AS row_no, n.hash, name, module, file_path, caller_count, callee_count, risk, calling_module_count
FROM fan JOIN n ON n.repo_id = fan.repo_id AND n.hash = fan.hash WHERE calling_module_count >= {least} QUALIFY row_no <= {limit}"""


@query(f", {_FANIN} {_high(3, 100)}")
def high_fan_in(c):
    return A.high_fan_in(c)


def _declared(otherwise: str) -> str:
    words = ", ".join(f"'{w}'" for w in scalars.LOAD_BEARING_WORDS)
    return f"""CASE WHEN lower(coalesce(module, '')) LIKE '%engine%' THEN 'explicit' WHEN list_has_any(string_split(translate(lower(coalesce(module, '')), '.-', '//'), '/'), [{words}]) THEN 'auto' ELSE '{otherwise}' END AS declaration"""


@query(f", {_FANIN} SELECT *, {_declared('unexpected')} FROM ({_high(3, 100)})")
def load_bearing(c):
    return A.load_bearing(c, ["engine"])


@query("""SELECT e.repo_id, CAST(row_number() OVER (PARTITION BY e.repo_id ORDER BY coalesce(call_count, 1) DESC, caller_hash, callee_hash) AS INTEGER) AS row_no, a.name AS caller_name, caller_hash, a.file_path AS caller_file, b.name AS callee_name, callee_hash, b.file_path AS callee_file, coalesce(call_count, 1) AS call_count
FROM e JOIN n a ON a.repo_id = e.repo_id AND a.hash = caller_hash JOIN n b ON b.repo_id = e.repo_id AND b.hash = callee_hash WHERE a.module = 'core' AND b.module = 'common.util' QUALIFY row_no <= 50""")
def module_edge_details(c):
    return A.edge_details(c, "core", "common.util")


# dead code, layers


def _any(column: str, parts: list[str], ends: bool) -> str:
    return " OR ".join((f"starts_with({column}, '{p}') OR ends_with({column}, '{p}')" if ends else f"contains({column}, '{p}')") for p in parts)


_DEADSQL = f"""SELECT repo_id, hash, name, module, file_path, kind, complexity, line_start, line_end, CASE WHEN lower(coalesce(name, '')) IN ({", ".join(f"'{x}'" for x in A.ENTRYPOINTS)}) OR {_any("coalesce(name, '')", A.FRAMEWORK_NAMES, True)} OR {_any("lower(coalesce(file_path, ''))", A.FRAMEWORK_PATHS, False)} OR kind = 'class' THEN 'caution'
WHEN starts_with(coalesce(name, ''), '_') AND coalesce(complexity, 0) <= 8 THEN 'safe' ELSE 'review' END AS confidence FROM n WHERE caller_count = 0 AND kind IN ('function', 'method', 'class')"""
_TIERS = "count(*) AS dead, count(*) FILTER (confidence = 'safe') AS safe, count(*) FILTER (confidence = 'review') AS review, count(*) FILTER (confidence = 'caution') AS caution, CAST(sum(coalesce(nullif(line_end, 0), line_start, 0) - coalesce(line_start, 0)) AS BIGINT) AS lines"


@query(_DEADSQL)
def dead_code(c):
    return A.dead_code(c)


@query(f"SELECT * FROM ({_DEADSQL}) QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY complexity DESC NULLS LAST, name ASC NULLS FIRST, hash) <= 200")
def dead_code_listed(c):
    return A.dead_code(c, 200)


@query(f"""SELECT t.repo_id, total, coalesce(dead, 0) AS dead, coalesce(safe, 0) AS safe, coalesce(review, 0) AS review, coalesce(caution, 0) AS caution, coalesce(lines, 0) AS lines, round(coalesce(dead, 0) / total, 6) AS dead_ratio FROM (SELECT repo_id, count(*) AS total FROM n GROUP BY 1) t
LEFT JOIN (SELECT repo_id, {_TIERS} FROM ({_DEADSQL}) GROUP BY 1) d ON d.repo_id = t.repo_id""")
def dead_summary(c):
    return A.dead_summary(c)


@query(f"SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY dead DESC, file) AS INTEGER) AS row_no FROM (SELECT repo_id, coalesce(nullif(file_path, ''), 'unknown') AS file, {_TIERS} FROM ({_DEADSQL}) GROUP BY ALL)")
def dead_by_file(c):
    return A.dead_by_file(c)


_DEADFILES = "SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY dead DESC, file_path) AS INTEGER) AS row_no FROM (SELECT repo_id, file_path, count(*) AS total, count(*) FILTER (caller_count = 0) AS dead FROM n WHERE kind IN ('function', 'method', 'class') AND file_path IS NOT NULL GROUP BY ALL) WHERE total >= 5 AND dead / total >= 0.6"


@query(f"{_DEADFILES} QUALIFY row_no <= 5")
def dead_files(c):
    return A.dead_files(c)


_LAYER = "CASE WHEN p > 0.6 THEN 0 WHEN p > 0.3 THEN 1 WHEN p > 0.1 THEN 2 WHEN p > 0.02 THEN 3 ELSE 4 END AS layer"
_BUILDING = f"""{_FANIN}, top AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY caller_count DESC NULLS LAST, hash) AS INTEGER) AS row_no FROM n QUALIFY row_no <= 120),
bn AS (SELECT b.repo_id, row_no, b.hash, name, module, file_path, caller_count, callee_count, complexity, risk, {_LAYER}, declaration, declaration <> 'none' AS is_load_bearing, coalesce(calling_module_count, 0) AS calling_module_count FROM (
SELECT *, {_declared('none')}, coalesce(caller_count / nullif(max(caller_count) OVER (PARTITION BY repo_id), 0), 0) AS p FROM top) b LEFT JOIN fan ON fan.repo_id = b.repo_id AND fan.hash = b.hash),
be AS (SELECT e.repo_id, caller_hash AS source, callee_hash AS target FROM e JOIN top a ON a.repo_id = e.repo_id AND a.hash = caller_hash JOIN top b ON b.repo_id = e.repo_id AND b.hash = callee_hash)"""


@query(f", {_BUILDING} SELECT * FROM bn")
def building(c):
    return A.building(c, modules=["engine"])[0]


@query(f", {_BUILDING} SELECT * FROM be")
def building_edges(c):
    return A.building(c)[1]


@query(f", {_BUILDING} SELECT repo_id, count(*) FILTER (is_load_bearing) AS load_bearing, count(*) FILTER (NOT is_load_bearing AND calling_module_count >= 3) AS undeclared, {', '.join(f'count(*) FILTER (layer = {i}) AS layer_{i}' for i in range(5))} FROM bn GROUP BY 1")
def layer_totals(c):
    return A.layer_totals(A.building(c, modules=["engine"])[0])


def _places() -> str:
    lane = "lanes AS (SELECT repo_id, m, CASE WHEN count(*) OVER (PARTITION BY repo_id) > 1 THEN (row_number() OVER (PARTITION BY repo_id ORDER BY m) - 1) / (count(*) OVER (PARTITION BY repo_id) - 1) ELSE 0.5 END AS lane FROM (SELECT DISTINCT repo_id, coalesce(module, '') AS m FROM bn))"
    parts, above = [lane], None
    for at in (4, 3, 2, 1, 0):
        pull = f"(SELECT avg(x) FROM (SELECT DISTINCT repo_id, source, target FROM be) q JOIN ({above}) u ON u.repo_id = q.repo_id AND u.hash = q.source WHERE q.repo_id = b.repo_id AND q.target = b.hash)" if above else "CAST(NULL AS DOUBLE)"
        parts.append(f"""l{at} AS (SELECT repo_id, hash, layer, place, round(40 + (place - 0.5) * 1000.0 / (count(*) OVER (PARTITION BY repo_id)), 6) AS x FROM (SELECT repo_id, hash, layer, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY round(coalesce(pull, 40 + lane * 1000)), is_load_bearing DESC, caller_count DESC NULLS LAST, hash) AS INTEGER) AS place FROM (
SELECT b.*, lane, {pull} AS pull FROM bn b JOIN lanes ON lanes.repo_id = b.repo_id AND lanes.m = coalesce(b.module, '') WHERE layer = {at})))""")
        above = " UNION ALL ".join(f"SELECT repo_id, hash, x FROM l{k}" for k in range(at, 5))
    return f"{', '.join(parts)} " + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(5))


@query(f", {_BUILDING}, {_places()}")
def building_places(c):
    return A.building_places(*A.building(c, modules=["engine"]))


# graph analyses

_SEEDS = "(SELECT repo_id, min(hash) AS h FROM n WHERE caller_count > 0 GROUP BY repo_id)"
_BLAST = f"bfs AS (SELECT repo_id, h AS node, 0 AS d FROM {_SEEDS} UNION SELECT ed.repo_id, ed.src, d + 1 FROM bfs JOIN ed ON ed.repo_id = bfs.repo_id AND ed.dst = bfs.node WHERE d < 5), hit AS (SELECT repo_id, node AS hash, min(d) AS depth FROM bfs GROUP BY ALL HAVING min(d) > 0)"


def _radius(c: Catalog) -> DataFrame:
    seeds = c.internal_nodes.where(C("caller_count") > 0).groupBy("repo_id").agg(F.min("hash").alias("hash"))
    return A.blast_radius(c, seeds, 5)


@query(f", {_BLAST} SELECT * FROM hit")
def blast_radius(c):
    return _radius(c)


@query(f", {_BLAST} SELECT repo_id, 'depth' AS grain, CAST(depth AS VARCHAR) AS key, count(*) AS n FROM hit GROUP BY ALL UNION ALL SELECT hit.repo_id, 'module', module, count(*) FROM hit JOIN n ON n.repo_id = hit.repo_id AND n.hash = hit.hash WHERE module IS NOT NULL GROUP BY ALL")
def blast_rollups(c):
    return A.blast_rollups(c, _radius(c))


_CYCLES = f"""{REACH}, cs AS (SELECT repo_id, scc, count(*) AS size, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, scc) AS INTEGER) AS row_no FROM part GROUP BY repo_id, scc HAVING count(*) > 1),
cyc AS (SELECT cs.repo_id, row_no, cs.scc, size, list_sort(list(DISTINCT module) FILTER (module <> '')) AS modules, list_sort(list(node)) AS nodes FROM cs JOIN part ON part.repo_id = cs.repo_id AND part.scc = cs.scc JOIN n ON n.repo_id = cs.repo_id AND n.hash = node WHERE row_no <= 20 GROUP BY ALL),
weak AS (SELECT e.repo_id, a.scc, min({{'n': coalesce(call_count, 1), 'a': caller_hash, 'b': callee_hash}}) AS w FROM e JOIN part a ON a.repo_id = e.repo_id AND a.node = caller_hash JOIN part b ON b.repo_id = e.repo_id AND b.node = callee_hash AND b.scc = a.scc WHERE caller_hash <> callee_hash GROUP BY ALL),
cycles AS (SELECT cyc.repo_id, row_no, cyc.scc, size, len(coalesce(modules, [])) > 1 AS cross_module, coalesce(modules, []) AS modules, nodes, w.a AS break_caller, w.b AS break_callee, w.n AS break_calls FROM cyc LEFT JOIN weak ON weak.repo_id = cyc.repo_id AND weak.scc = cyc.scc)"""


@query(f"{_CYCLES} SELECT * FROM cycles")
def cycles(c):
    return A.cycles(c)


@query(f"{_CYCLES} SELECT repo_id, count(*) AS cycles, CAST(sum(size) AS BIGINT) AS symbols, count(*) FILTER (size > 5) AS large, count(*) FILTER (cross_module) AS cross_module FROM cycles GROUP BY 1")
def cycle_totals(c):
    return A.cycle_totals(A.cycles(c))


@query(f"""{_CYCLES}, {_FANIN}, t1 AS (SELECT repo_id, 1 AS step, row_number() OVER (PARTITION BY repo_id ORDER BY row_no) AS place, 'unexpected_coupling' AS type, CASE WHEN calling_module_count >= 8 THEN 'high' ELSE 'medium' END AS severity, hash AS subject, calling_module_count AS n, module AS detail FROM ({_high(5, 100)}) WHERE coalesce(module, '') <> 'core' QUALIFY place <= 3),
tr AS (SELECT repo_id, module, sum(ca) AS ca, sum(ce) AS ce FROM (SELECT repo_id, callee_module AS module, edge_count AS ca, 0 AS ce FROM me UNION ALL SELECT repo_id, caller_module, 0, edge_count FROM me) GROUP BY ALL),
t2 AS (SELECT repo_id, 2, 1, 'unstable_module', 'medium', module, CAST(ca + ce AS BIGINT), CAST(round_even(ce / (ca + ce), 2) AS VARCHAR) FROM tr WHERE ca > 5 AND ce / (ca + ce) > 0.65 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY ca + ce DESC, module) = 1),
t3 AS (SELECT repo_id, 3, 1, 'cross_module_cycle', 'high', scc, size, array_to_string(modules, ', ') FROM cycles WHERE cross_module QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY size DESC, row_no) = 1),
t4 AS (SELECT repo_id, 4, 1, 'dead_code_concentration', 'low', file_path, dead, CAST(CAST(round_even(dead / total * 100, 0) AS INTEGER) AS VARCHAR) FROM ({_DEADFILES}) WHERE row_no = 1 AND dead >= 5)
SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, step, place) AS INTEGER) AS row_no, type, severity, subject, n, detail FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4) QUALIFY row_no <= 5""")
def triage(c):
    return details.triage(c, modules=["core"])


# symbols

_CHOSEN = "SELECT repo_id, hash AS of FROM n QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY caller_count DESC NULLS LAST, hash) <= 20 UNION SELECT repo_id, child_hash FROM (SELECT * FROM ih WHERE parent_hash IN (SELECT hash FROM n) QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY child_hash) <= 20) UNION SELECT repo_id, parent_hash FROM (SELECT * FROM ih WHERE parent_hash IN (SELECT hash FROM n) QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY child_hash) <= 20)"


def _part(name: str, source: str, order: str, limit: int, columns: str = "hash, name, module, file_path, line_start", calls: str = "call_count") -> str:
    return f"SELECT repo_id, of, '{name}' AS relation, CAST(row_number() OVER (PARTITION BY repo_id, of ORDER BY {order}hash, {calls} DESC NULLS LAST) AS INTEGER) AS row_no, {columns}, {calls} AS call_count FROM ({source}) QUALIFY row_no <= {limit}"


@query(f""", ch AS ({_CHOSEN}), rel AS ({_part('caller', 'SELECT e.repo_id, of, x.*, call_count FROM ch JOIN e ON e.repo_id = ch.repo_id AND e.callee_hash = of JOIN (SELECT repo_id AS r, * EXCLUDE (repo_id) FROM alln) x ON x.r = e.repo_id AND x.hash = e.caller_hash', 'caller_count DESC NULLS LAST, ', 50)}
UNION ALL {_part('callee', "SELECT e.repo_id, of, x.*, call_count FROM ch JOIN e ON e.repo_id = ch.repo_id AND e.caller_hash = of JOIN (SELECT repo_id AS r, * EXCLUDE (repo_id) FROM n) x ON x.r = e.repo_id AND x.hash = e.callee_hash", 'call_count DESC NULLS LAST, ', 50)}
UNION ALL {_part('external', "SELECT e.repo_id, of, x.*, call_count FROM ch JOIN e ON e.repo_id = ch.repo_id AND e.caller_hash = of JOIN (SELECT repo_id AS r, * EXCLUDE (repo_id) FROM alln WHERE hash LIKE 'ext:%') x ON x.r = e.repo_id AND x.hash = e.callee_hash", 'call_count DESC NULLS LAST, ', 20, 'hash, name, ext_package, file_path, line_start')}
UNION ALL {_part('parent', 'SELECT ih.repo_id, of, parent_hash AS hash, coalesce(parent_name, x.name) AS name, module, file_path, line_start FROM ch JOIN ih ON ih.repo_id = ch.repo_id AND ih.child_hash = of LEFT JOIN (SELECT repo_id AS r, * EXCLUDE (repo_id) FROM alln) x ON x.r = ih.repo_id AND x.hash = ih.parent_hash', '', 1000, calls='NULL')}
UNION ALL {_part('child', 'SELECT ih.repo_id, of, x.hash, x.name, module, file_path, line_start FROM ch JOIN ih ON ih.repo_id = ch.repo_id AND ih.parent_hash = of JOIN (SELECT repo_id AS r, * EXCLUDE (repo_id) FROM alln) x ON x.r = ih.repo_id AND x.hash = ih.child_hash', '', 30, calls='NULL')}) SELECT * FROM rel""")
def relations(c):
    called = c.scan([], None, [C("caller_count").desc_nulls_last()], 20).select("repo_id", "hash")
    known = c.inheritance.join(c.internal_nodes.select(C("hash").alias("parent_hash")).distinct(), "parent_hash", "left_semi")
    links = A.first_rows(known, 20, ["repo_id"], C("child_hash"))
    some = links.select("repo_id", F.explode(F.array("child_hash", "parent_hash")).alias("hash"))
    return details.relations(c, called.unionByName(some))


@query("SELECT repo_id, min(hash) AS hash FROM alln WHERE module = 'core' AND name = 'scan_header' GROUP BY 1")
def lookup(c):
    return details.lookup(c, *scalars.parse_symbol("core::scan_header"))


@query("""SELECT repo_id, module || '::' || name AS symbol, max(CAST(coalesce(is_async, 0) AS INTEGER)) AS async, max(CAST(coalesce(is_self_recursive, 0) AS INTEGER)) AS recursive, max(CAST(coalesce(is_exported, 0) AS INTEGER)) AS exported, max(CASE WHEN framework_entry_point = 'TestFunction' THEN 1 ELSE 0 END) AS test
FROM n WHERE (is_async = 1 OR is_self_recursive = 1 OR is_exported = 1 OR coalesce(framework_entry_point, '') <> '') AND module IS NOT NULL AND name IS NOT NULL GROUP BY ALL""")
def node_flags(c):
    return details.flags(c)


_REAL = "parent_hash IS NOT NULL AND parent_hash <> ''"
_IG = "links AS (SELECT * FROM ih WHERE child_hash <> '' AND child_hash NOT LIKE 'unresolved:%'), kids AS (SELECT repo_id, hash, name, module, file_path, kind FROM alln WHERE (repo_id, hash) IN (SELECT (repo_id, child_hash) FROM links) QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY hash) <= 500)"


@query(f", {_IG} SELECT *, false AS external FROM kids UNION ALL SELECT repo_id, parent_hash, min(parent_name), 'external', NULL, 'externalclass', true FROM links WHERE {_REAL} AND (repo_id, parent_hash) NOT IN (SELECT (repo_id, hash) FROM kids) GROUP BY 1, 2")
def inheritance_nodes(c):
    return details.inheritance_graph(c)[0]


@query(f", {_IG} SELECT repo_id, child_hash AS source, parent_hash AS target, parent_name FROM links")
def inheritance_edges(c):
    return details.inheritance_graph(c)[1]
