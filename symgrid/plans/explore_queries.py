"""Queries of scans, pivots, filters and induced graphs, with SQL to compare."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrid.functions import scalars
from symgrid.plans import filters
from symgrid.plans.explore import AGGREGATES, BUCKETS, FIELDS, MODES, Explore, search
from symgrid.plans.registry import ENRICHED, query
from symgrid.sources.catalog import NODE_COLUMNS, Catalog

C = F.col
_DEAD = "round(avg(CASE WHEN caller_count = 0 THEN 1.0 ELSE 0.0 END), 3) AS dead_ratio"
_RISKY = "round(avg(CASE WHEN risk IN ('high', 'critical') THEN 1.0 ELSE 0.0 END), 3) AS high_risk_ratio"

# scans


@query("""SELECT x.repo_id, split_part(x.repo_id, '@', 1) AS project, node_count, coalesce(edge_count, 0) AS edge_count, module_count,
x.repo_id IN (SELECT repo_id FROM node_features) AS enriched FROM (SELECT repo_id, count(*) AS node_count, count(DISTINCT CASE WHEN hash NOT LIKE 'ext:%' THEN module END) AS module_count FROM alln GROUP BY 1) x
LEFT JOIN (SELECT repo_id, count(*) AS edge_count FROM e GROUP BY 1) y ON x.repo_id = y.repo_id""")
def repos(c):
    return c.repos()


@query("""SELECT x.*, coalesce(ec, 0) AS edge_count, coalesce(cc, 0) AS cycle_candidates FROM (SELECT repo_id, count(*) AS node_count, count(DISTINCT CASE WHEN hash NOT LIKE 'ext:%' THEN module END) AS module_count,
count(*) FILTER (hash NOT LIKE 'ext:%' AND caller_count = 0) AS dead_count, count(*) FILTER (hash NOT LIKE 'ext:%' AND risk IN ('high', 'critical')) AS high_risk_count FROM alln GROUP BY 1) x
LEFT JOIN (SELECT repo_id, count(*) AS cc FROM (SELECT repo_id, caller_hash AS h FROM e INTERSECT SELECT repo_id, callee_hash FROM e) GROUP BY 1) y ON y.repo_id = x.repo_id
LEFT JOIN (SELECT repo_id, count(*) AS ec FROM e GROUP BY 1) z ON z.repo_id = x.repo_id""")
def overview(c):
    return c.overview()


@query("SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY symbol_count DESC, module) AS INTEGER) AS row_no FROM (SELECT repo_id, module, count(*) AS symbol_count FROM n WHERE module IS NOT NULL GROUP BY ALL) QUALIFY row_no <= 10")
def top_modules(c):
    return c.top_modules()


@query("SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY edge_count DESC NULLS LAST, caller_module, callee_module) AS INTEGER) AS row_no, caller_module, callee_module, edge_count FROM me QUALIFY row_no <= 200")
def top_module_edges(c):
    return c.top_module_edges()


@query("SELECT repo_id, risk, count(*) AS n FROM n GROUP BY ALL")
def risks(c):
    return c.risks()


@query("SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY complexity DESC NULLS LAST, name ASC NULLS FIRST, hash) AS INTEGER) AS row_no, hash, name, complexity FROM n WHERE kind = 'function' QUALIFY row_no <= 50")
def scan(c):
    return c.scan(["name", "complexity"], C("kind") == "function", [C("complexity").desc_nulls_last(), C("name").asc_nulls_first()], 50)


@query("SELECT repo_id, caller_hash, callee_hash, call_count FROM e WHERE caller_hash NOT LIKE 'ext:%' AND callee_hash NOT LIKE 'ext:%'")
def internal_edges(c):
    return c.internal_edges()


@query("SELECT e.repo_id, caller_hash, callee_hash, max(call_count) AS call_count FROM e JOIN alln a ON a.repo_id = e.repo_id AND a.hash = caller_hash JOIN alln b ON b.repo_id = e.repo_id AND b.hash = callee_hash GROUP BY ALL")
def graph_with_externals(c):
    return c.graph(external=True)[1]


_PAGE = "p AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY hash) AS INTEGER) AS row_no FROM n QUALIFY row_no > 100 AND row_no <= 400)"


@query(f", {_PAGE} SELECT repo_id, row_no, hash, name, kind, module, file_path, line_start, complexity, caller_count, callee_count, risk FROM p")
def graph_page(c):
    return c.graph_page(limit=300, offset=100)[0]


@query(f", {_PAGE} SELECT e.repo_id, caller_hash, callee_hash, call_count FROM e JOIN p a ON a.repo_id = e.repo_id AND a.hash = caller_hash JOIN p b ON b.repo_id = e.repo_id AND b.hash = callee_hash")
def graph_page_edges(c):
    return c.graph_page(limit=300, offset=100)[1]


@query("SELECT repo_id, caller_hash, callee_hash, count(*) AS weight FROM e WHERE callee_hash NOT LIKE 'ext:%' GROUP BY ALL")
def weighted_edges(c):
    return c.weighted_edges()


@query("SELECT repo_id, caller_hash, callee_hash FROM e WHERE callee_hash NOT LIKE 'ext:%' AND (repo_id, caller_hash) IN (SELECT (repo_id, hash) FROM n WHERE kind = 'class') AND (repo_id, callee_hash) IN (SELECT (repo_id, hash) FROM n WHERE kind = 'class')")
def edges_within(c):
    return c.edges_within(c.nodes.where(C("kind") == "class")).select("repo_id", "caller_hash", "callee_hash")


@query("SELECT repo_id, module, count(*) AS symbol_count, CAST(coalesce(sum(complexity), 0) AS BIGINT) AS total_complexity, coalesce(round(avg(complexity), 6), 0) AS avg_complexity FROM n WHERE module IS NOT NULL GROUP BY ALL")
def module_symbol_stats(c):
    return c.module_stats()


_DIRNAME = "CASE WHEN file_path IS NULL OR file_path = '' THEN NULL WHEN strpos(file_path, '/') = 0 THEN '.' ELSE coalesce(nullif(regexp_extract(file_path, '^(.*?)/+[^/]*$', 1), ''), '/') END"


@query(f"""SELECT repo_id, hash, {_DIRNAME} AS folder, regexp_replace({_DIRNAME}, '/+([^/]+)$', '/\\1') AS folder2, len(string_split(replace(module, '/', '.'), '.')) * CASE WHEN module LIKE '\\_\\_%' ESCAPE '\\' THEN NULL ELSE 1 END AS module_depth,
round(ln(1 + coalesce(transitive_callers, 0)) * ln(2 + coalesce(xmod_fan_in, 0)), 6) AS utility FROM (SELECT n.repo_id, n.hash, file_path, module, transitive_callers, xmod_fan_in FROM {ENRICHED})""")
def scalar_functions(c):
    zero = lambda x: F.coalesce(x, F.lit(0))
    return c.enriched.select("repo_id", "hash", scalars.dirname(C("file_path")).alias("folder"), scalars.dirdir(C("file_path")).alias("folder2"), scalars.module_depth(C("module")).cast("long").alias("module_depth"), F.round(scalars.utility(zero("transitive_callers"), zero("xmod_fan_in")), 6).alias("utility"))


# pivots


@query(f"SELECT repo_id, module, count(*) AS symbol_count, {_DEAD}, round(avg(CAST(caller_count AS DOUBLE)), 4) AS caller_count_avg FROM n GROUP BY repo_id, module")
def explore_default(c):
    return Explore(c).pivot()


def _digits(field: str) -> int:
    """Digits of means that are compared: the fourth of the greatest field depends on the order of addition."""
    return 3 if field == "utility" else 4


def _aggregate(field: str, agg: str) -> str:
    x = {"utility": "utility_score", "topo_depth": "topological_depth", "betweenness": "betweenness_centrality"}.get(field, field)
    whole = FIELDS[field][1] == "int"
    return {
        "avg": f"round(round(avg(CAST({x} AS DOUBLE)), 4), {_digits(field)})",
        "min": f"min({x})",
        "max": f"max({x})",
        "sum": f"CAST(sum({x}) AS BIGINT)" if whole else f"round(sum({x}), 6)",
        "count": f"count({x})",
        "stddev": f"round(round(coalesce(stddev_pop({x}), 0), 4), {_digits(field)})",
    }[agg] + f" AS {field}_{agg}"


# NaN has no order and no sum that two engines agree on, so measures of doubles are taken without it here
_MEASURES = [f"{f}:{a}" for f in FIELDS for a in AGGREGATES]
_CLEAN = "(SELECT * REPLACE (CASE WHEN NOT isnan(utility_score) THEN utility_score END AS utility_score, CASE WHEN NOT isnan(pagerank) THEN pagerank END AS pagerank, CASE WHEN NOT isnan(betweenness_centrality) THEN betweenness_centrality END AS betweenness_centrality) FROM nf)"


class _WithoutNaN(Catalog):
    @property
    def features(self) -> DataFrame:
        df = super().features
        return df.withColumns({x: F.when(~F.isnan(x), C(x)) for x in ("utility_score", "pagerank", "betweenness_centrality")})


@query(f"SELECT n.repo_id, kind, risk, count(*) AS symbol_count, {_RISKY}, {', '.join(_aggregate(*m.split(':')) for m in _MEASURES)} FROM n LEFT JOIN {_CLEAN} nf ON nf.repo_id = n.repo_id AND nf.hash = n.hash GROUP BY ALL")
def explore_aggregates(c):
    p = Explore(_WithoutNaN(c.spark, c.folder), ["kind", "risk"], ["symbol_count", "high_risk_ratio", *_MEASURES]).pivot()
    # the last digits of sums and deviations depend on the order of addition
    sums = {f"{f}_sum": F.round(f"{f}_sum", 6) for f, v in FIELDS.items() if v[1] == "float"}
    return p.withColumns(sums | {f"{f}_{a}": F.round(f"{f}_{a}", _digits(f)) for f in FIELDS for a in ("avg", "stddev")})


_TREE = f"""SELECT repo_id, CAST(3 - length(replace(bin(grouping(module, kind, risk)), '0', '')) AS INTEGER) AS depth, module, kind, risk, count(*) AS symbol_count, {_DEAD}, round(avg(CAST(complexity AS DOUBLE)), 4) AS complexity_avg
FROM n GROUP BY GROUPING SETS ((repo_id, module), (repo_id, module, kind), (repo_id, module, kind, risk))"""


@query(_TREE)
def explore_tree(c):
    return Explore(c, ["module", "kind", "risk"], ["symbol_count", "dead_ratio", "complexity:avg"]).tree()


@query(f"""SELECT *, CAST(row_number() OVER (PARTITION BY repo_id, depth, CASE WHEN depth > 1 THEN module END, CASE WHEN depth > 2 THEN kind END
ORDER BY symbol_count DESC, CASE depth WHEN 1 THEN module WHEN 2 THEN kind ELSE risk END ASC NULLS FIRST) AS INTEGER) AS place FROM ({_TREE})""")
def explore_ordered_tree(c):
    return Explore(c, ["module", "kind", "risk"], ["symbol_count", "dead_ratio", "complexity:avg"]).ordered_tree()


@query(f"""SELECT n.repo_id, CASE WHEN coalesce(scc_size, 1) > 1 THEN 'in-cycle' ELSE 'clean' END AS in_cycle, community_dominant_mod AS community, count(*) AS symbol_count,
round(avg(CASE WHEN coalesce(scc_size, 1) > 1 THEN 1.0 ELSE 0.0 END), 3) AS in_cycle_ratio, max(topological_depth) AS topo_depth_max FROM {ENRICHED} GROUP BY ALL""")
def explore_enriched(c):
    return Explore(c, ["in_cycle", "community"], ["symbol_count", "in_cycle_ratio", "topo_depth:max"]).pivot()


@query(f"""SELECT repo_id, {_DIRNAME} AS directory, CASE WHEN caller_count = 0 THEN 'dead' ELSE 'alive' END AS dead, CASE WHEN risk IN ('high', 'critical') THEN 'high-risk' ELSE 'normal' END AS high_risk,
coalesce(nullif(framework_entry_point, ''), 'none') AS framework, CASE WHEN is_async = 1 THEN 'async' ELSE 'sync' END AS async, CASE WHEN is_exported = 1 THEN 'exported' ELSE 'internal' END AS exported, count(*) AS symbol_count FROM n GROUP BY ALL""")
def explore_flags(c):
    return Explore(c, ["directory", "dead", "high_risk", "framework", "async", "exported"], ["symbol_count"]).pivot()


_CLASS = """cls AS (SELECT n.repo_id, n.hash, coalesce(first(c.name ORDER BY c.line_start DESC, c.line_end, c.hash), '(top-level)') AS class_name FROM n
LEFT JOIN n c ON c.repo_id = n.repo_id AND c.file_path = n.file_path AND c.kind = 'class' AND n.line_start >= c.line_start AND n.line_end <= c.line_end GROUP BY ALL)"""


@query(f", {_CLASS} SELECT n.repo_id, class_name AS class, file_path AS file, count(*) AS symbol_count FROM n JOIN cls ON cls.repo_id = n.repo_id AND cls.hash = n.hash GROUP BY ALL")
def explore_class(c):
    return Explore(c, ["class", "file"], ["symbol_count"]).pivot()


def _bucket_sql(value: str, labels: list[str], name: str, source: str) -> str:
    k = len(labels)
    cases = " ".join(f"WHEN v < c[{i + 1}] THEN '{x}'" for i, x in enumerate(labels[:-1]))
    at = ", ".join(f"l[CAST(floor(len(l) * {i} / {k}) AS INTEGER) + 1]" for i in range(1, k))
    return f""", v AS (SELECT n.repo_id, CAST({value} AS DOUBLE) AS v FROM {source}), cuts AS (SELECT repo_id, [{at}] AS c FROM (SELECT repo_id, list(v ORDER BY v) AS l FROM v WHERE v IS NOT NULL GROUP BY repo_id))
SELECT v.repo_id, CASE {cases} ELSE '{labels[-1]}' END AS {name}, count(*) AS symbol_count FROM v LEFT JOIN cuts ON cuts.repo_id = v.repo_id GROUP BY ALL"""


_VALUES = {
    "dead_ratio": "CASE WHEN caller_count = 0 THEN 0.0 ELSE 1.0 END",
    "high_risk_ratio": "CASE WHEN risk IN ('high', 'critical') THEN 1.0 ELSE 0.0 END",
    "in_cycle_ratio": "CASE WHEN coalesce(scc_size, 1) > 1 THEN 1.0 ELSE 0.0 END",
    "utility": "utility_score",
    "betweenness": "betweenness_centrality",
}
for _field in BUCKETS:
    for _mode, _labels in MODES.items():
        query(_bucket_sql(_VALUES.get(_field, _field), _labels, f"{_field}_{_mode}", ENRICHED), name=f"bucket_{_field}_{_mode}")(lambda c, t=f"{_field}:{_mode}": Explore(c, [t], ["symbol_count"]).pivot())


@query("""SELECT repo_id, CAST(r AS INTEGER) AS row_no, hash, module || '::' || name AS symbol, caller_count AS caller_count_avg, complexity AS complexity_max FROM (
SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY caller_count DESC NULLS LAST, name ASC NULLS FIRST, hash) AS r FROM n WHERE kind IN ('function', 'method')) WHERE r <= 500""")
def explore_symbols(c):
    return Explore(c, [], ["caller_count:avg", "complexity:max"], ["function", "method"]).envelope().rows


@query("SELECT repo_id, count(*) AS total_count, CAST(least(count(*), 500) AS BIGINT) AS shown_count, count(*) > 500 AS truncated FROM n GROUP BY 1")
def explore_symbol_totals(c):
    return Explore(c, []).envelope().totals.withColumn("shown_count", C("shown_count").cast("long"))


@query("""SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY weight DESC NULLS LAST, caller_hash, callee_hash) AS INTEGER) AS row_no, source, target, weight FROM (
SELECT e.repo_id, caller_hash, callee_hash, a.symbol AS source, b.symbol AS target, call_count AS weight FROM e
JOIN (SELECT repo_id, hash, module || '::' || name AS symbol FROM n QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY caller_count DESC NULLS LAST, name ASC NULLS FIRST, hash) <= 500) a ON a.repo_id = e.repo_id AND a.hash = caller_hash
JOIN (SELECT repo_id, hash, module || '::' || name AS symbol FROM n QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY caller_count DESC NULLS LAST, name ASC NULLS FIRST, hash) <= 500) b ON b.repo_id = e.repo_id AND b.hash = callee_hash) QUALIFY row_no <= 2000""")
def explore_symbol_edges(c):
    return Explore(c, ["symbol"]).envelope().edges


_SIDES = {
    "module": "module",
    "class": "class_name",
    "risk": "risk",
    "kind": "kind",
    "symbol": "module || '::' || name",
    "file": "file_path",
    "directory": _DIRNAME,
    "framework": "coalesce(nullif(framework_entry_point, ''), 'none')",
    "async": "CASE WHEN is_async = 1 THEN 'async' ELSE 'sync' END",
    "exported": "CASE WHEN is_exported = 1 THEN 'exported' ELSE 'internal' END",
    "community": "community_dominant_mod",
}


def _induced(dimension: str) -> str:
    more = f", {_CLASS}" if dimension == "class" else ""
    source = "n JOIN cls ON cls.repo_id = n.repo_id AND cls.hash = n.hash" if dimension == "class" else ENRICHED
    return f"""{more}, d AS (SELECT n.repo_id, n.hash, {_SIDES[dimension]} AS d FROM {source}) SELECT e.repo_id, a.d AS source, b.d AS target, count(*) AS weight FROM e
JOIN d a ON a.repo_id = e.repo_id AND a.hash = caller_hash JOIN d b ON b.repo_id = e.repo_id AND b.hash = callee_hash WHERE a.d <> b.d GROUP BY ALL"""


for _dimension in _SIDES:
    query(_induced(_dimension), name=f"induced_{_dimension}")(lambda c, d=_dimension: Explore(c).induced_edges(d))


_WEIGHTS = "SELECT repo_id, s_module AS source, t_module AS target, count(*) AS weight FROM calls WHERE s_module <> t_module GROUP BY ALL"


@query(f"SELECT repo_id, source, target, weight FROM ({_WEIGHTS}) WHERE weight >= 2 QUALIFY row_number() OVER (PARTITION BY repo_id, source ORDER BY weight DESC, target) <= 3")
def induced_thinned(c):
    return filters.thin_edges(Explore(c).induced_edges("module"), 2, 3)


_PICK = {"module": "module", "risk": "risk", "kind": "kind", "directory": _DIRNAME, "dead": "CASE WHEN caller_count = 0 THEN 'dead' ELSE 'alive' END", "high_risk": "CASE WHEN risk IN ('high', 'critical') THEN 'high-risk' ELSE 'normal' END", "framework": _SIDES["framework"], "async": _SIDES["async"], "exported": _SIDES["exported"], "community": "community_dominant_mod"}
_PICKED = " UNION ALL ".join(f"SELECT DISTINCT n.repo_id, '{d}' AS dimension, {x} AS value FROM {ENRICHED} WHERE ({x}) IS NOT NULL" for d, x in _PICK.items())



@query(_PICKED)
def picker_values(c):
    return Explore(c).picker_values()


@query(f"""{_bucket_sql("complexity", MODES["quartile"], "bucket", "n").split("SELECT v.repo_id")[0]} SELECT * FROM ({_PICKED})
UNION SELECT v.repo_id, 'complexity:quartile', CASE WHEN v < c[1] THEN 'Q1' WHEN v < c[2] THEN 'Q2' WHEN v < c[3] THEN 'Q3' ELSE 'Q4' END FROM v LEFT JOIN cuts ON cuts.repo_id = v.repo_id""")
def merged_picker_values(c):
    return Explore(c, ["complexity:quartile"], ["symbol_count"]).merged_picker_values()


def _table_sql(sort: str) -> str:
    return f"""SELECT repo_id, row_no, hash, name, module, caller_count, {sort} AS sorted, outbound FROM (SELECT n.*, nf.utility_score, nf.pagerank, nf.xmod_fan_in, CAST(row_number() OVER (PARTITION BY n.repo_id ORDER BY {sort} DESC NULLS LAST, n.hash) AS INTEGER) AS row_no FROM {ENRICHED}) x LEFT JOIN (
SELECT repo_id, caller_hash AS hash, list(concat_ws(' ', callee_hash, coalesce(t_name, ''), coalesce(t_module, ''), coalesce(CAST(call_count AS VARCHAR), '')) ORDER BY r) AS outbound FROM (
SELECT *, row_number() OVER (PARTITION BY repo_id, caller_hash ORDER BY call_count DESC NULLS LAST, callee_hash) AS r FROM (SELECT e.*, n.name AS t_name, n.module AS t_module FROM e JOIN n ON n.repo_id = e.repo_id AND n.hash = e.callee_hash)) WHERE r <= 8 GROUP BY ALL) y USING (repo_id, hash) WHERE row_no <= 300"""


def _listed(table: DataFrame, sort: str) -> DataFrame:
    """Calls as text, so that rows can be compared."""
    parts = lambda x: F.concat_ws(" ", *[F.coalesce(x[k].cast("string"), F.lit("")) for k in ("hash", "name", "module", "call_count")])
    return table.select("repo_id", "row_no", "hash", "name", "module", "caller_count", C(sort).alias("sorted"), F.transform("outbound", parts).alias("outbound"))


for _sort in ("caller_count", "callee_count", "complexity", "name", "module", "utility_score", "pagerank", "xmod_fan_in"):
    query(_table_sql(_sort), name=f"node_table_{_sort}")(lambda c, s=_sort: _listed(Explore(c).node_table(s), s))


@query("SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY caller_count DESC NULLS LAST, hash) AS INTEGER) AS row_no, hash, name, kind, module, file_path, line_start, caller_count, callee_count, risk FROM n WHERE name ILIKE '%scan%' QUALIFY row_no <= 20")
def search_names(c):
    return search(c, "scan")


# filters


@query(f"""SELECT repo_id, module, symbol_count, dead_ratio FROM (SELECT repo_id, module, count(*) AS symbol_count, {_DEAD} FROM n GROUP BY ALL) WHERE symbol_count >= 10 AND (dead_ratio IS NULL OR NOT dead_ratio BETWEEN 0.4 AND 0.6) AND symbol_count <> 12 AND NOT regexp_matches(coalesce(module, ''), '(?i)test')""")
def explore_filtered(c):
    p = Explore(c, ["module"], ["symbol_count", "dead_ratio"]).pivot()
    tests = [filters.match_expression(C("symbol_count"), ">= 10"), filters.match_expression(C("dead_ratio"), "!0.4..0.6"), filters.match_expression(C("symbol_count"), "! 12"), filters.match_regex(C("module"), "!test")]
    return p.where(reduce(lambda a, b: a & b, tests))


_FILTERS = [{"kind": "measure", "mkey": "symbol_count", "expr": ">= 2"}, {"kind": "dim", "field": "kind", "mode": "exclude", "values": ["class"]}, {"kind": "dim", "field": "risk", "mode": "include", "values": ["low", "high"]}]


@query(f""", t AS ({_TREE}), ok AS (SELECT *, symbol_count >= 2 AND (depth < 2 OR coalesce(kind, '') <> 'class') AND (depth < 3 OR coalesce(risk, '') IN ('low', 'high')) AS pass FROM t),
l3 AS (SELECT * FROM ok WHERE depth = 3 AND pass), l2 AS (SELECT * FROM ok WHERE depth = 2 AND pass AND EXISTS (SELECT 1 FROM l3 WHERE l3.repo_id = ok.repo_id AND l3.module IS NOT DISTINCT FROM ok.module AND l3.kind IS NOT DISTINCT FROM ok.kind)),
l1 AS (SELECT * FROM ok WHERE depth = 1 AND pass AND EXISTS (SELECT 1 FROM l2 WHERE l2.repo_id = ok.repo_id AND l2.module IS NOT DISTINCT FROM ok.module))
SELECT * EXCLUDE (pass) FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)""")
def explore_filtered_tree(c):
    x = Explore(c, ["module", "kind", "risk"], ["symbol_count", "dead_ratio", "complexity:avg"])
    return filters.filter_pivot(x.tree(), x.dimensions, _FILTERS)


@query("SELECT repo_id, CAST(1 AS INTEGER) AS depth, file_path AS file, count(*) AS symbol_count FROM n WHERE NOT regexp_matches(lower(coalesce(file_path, '')), '\\b(tests?|spec[s.]|e2e|mocks?|stubs?|fixtures?)\\b|__tests__|[._/-]test[._/-]|[._/-]spec[._/-]') GROUP BY ALL")
def explore_without_tests(c):
    x = Explore(c, ["file"], ["symbol_count"])
    return filters.filter_pivot(x.tree(), x.dimensions, [], without_tests=True)


# graphs of pivots


_GRAPH = """g AS (SELECT repo_id, kind, module, count(*) AS size, round(avg(CAST(complexity AS DOUBLE)), 4) AS shown FROM n GROUP BY ALL),
s AS (SELECT repo_id, greatest(1.0, max(size)) AS most, min(shown) AS lo, CASE WHEN max(shown) = min(shown) THEN min(shown) + 1 ELSE max(shown) END AS hi FROM g WHERE module IS NOT NULL GROUP BY 1),
b AS (SELECT repo_id, module AS id, kind, size, shown FROM g WHERE module IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo_id, module ORDER BY size DESC, kind NULLS FIRST) = 1)"""


@query(f", {_GRAPH} SELECT b.repo_id, id, [kind] AS group_path, round(sqrt(size / most) * 18 + 4, 6) AS radius, round(coalesce(least(1.0, greatest(0.0, (shown - lo) / (hi - lo))), 0.5), 6) AS shade FROM b JOIN s ON s.repo_id = b.repo_id")
def graph_nodes(c):
    return Explore(c, ["kind", "module"], ["symbol_count", "complexity:avg"]).graph_nodes("symbol_count", "complexity:avg").drop("colour")


@query(f"SELECT repo_id, source, target, weight FROM ({_WEIGHTS}) WHERE weight >= 2 QUALIFY row_number() OVER (PARTITION BY repo_id, source ORDER BY weight DESC, target) <= 4")
def graph_edges(c):
    return Explore(c, ["kind", "module"], ["symbol_count"]).graph_data(least_weight=2, top=4, connected=True)[1]


def _modules(c: Catalog) -> DataFrame:
    """Modules as nodes, grouped by their first part."""
    return c.internal_nodes.where(C("module").isNotNull()).select("repo_id", C("module").alias("id"), F.array(F.split("module", r"\.")[0]).alias("group_path")).distinct()


@query(f"SELECT repo_id, source, target, weight FROM ({_WEIGHTS}) WHERE split_part(source, '.', 1) <> split_part(target, '.', 1)")
def crossing_view(c):
    return filters.crossing_view(_modules(c), Explore(c).induced_edges("module"))[1]


@query(f"SELECT repo_id, source, target, weight FROM ({_WEIGHTS}) WHERE (split_part(source, '.', 1) = 'core') <> (split_part(target, '.', 1) = 'core')")
def blob_selection(c):
    return filters.blob_selection(_modules(c), Explore(c).induced_edges("module"), ["core"])[1]
