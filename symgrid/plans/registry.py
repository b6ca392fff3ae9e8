"""Where queries over the code graph register, and the SQL they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symgrid.sources.catalog import NODE_COLUMNS, SCHEMA_COLUMNS, Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_COLS = [*NODE_COLUMNS, *SCHEMA_COLUMNS]
FEATURE_COLUMNS = [
    "scc_id", "scc_size", "scc_cross_module", "topological_depth", "reverse_topological_depth", "transitive_callers",
    "transitive_callees", "betweenness_centrality", "pagerank", "hub_score", "authority_score", "clustering_coeff",
    "xmod_fan_in", "xmod_fan_out", "xmod_call_ratio", "dominant_callee_mod", "dominant_callee_frac", "utility_score",
    "stability_rank", "complexity_pct", "middleman_score", "community_id", "community_dominant_mod", "community_alignment",
]


def _down(columns: list[str]) -> str:
    return ", ".join(f"{c} DESC NULLS LAST" for c in columns)


#: alln: counting rows of nodes; n: internal ones; nf: of features; e: edges with two ends; me: of module edges; ih: of
#: inheritance; calls: edges between known internal symbols; ed: the distinct ones.
TABLES = f"""WITH RECURSIVE alln AS (SELECT * REPLACE (lower(kind) AS kind, lower(risk) AS risk, CASE WHEN complexity >= 0 THEN complexity END AS complexity) FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id, hash ORDER BY loaded_at DESC NULLS LAST, {_down(_COLS)}) AS k FROM nodes WHERE hash IS NOT NULL) WHERE k = 1),
n AS (SELECT * FROM alln WHERE hash NOT LIKE 'ext:%'),
nf AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, hash ORDER BY computed_at DESC NULLS LAST, {_down(FEATURE_COLUMNS)}) AS k FROM node_features) WHERE k = 1),
e AS (SELECT repo_id, caller_hash, callee_hash, call_count FROM edges WHERE caller_hash <> '' AND callee_hash <> ''),
me AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, caller_module, callee_module ORDER BY loaded_at DESC NULLS LAST, edge_count DESC NULLS LAST) AS k FROM module_edges
  WHERE caller_module IS NOT NULL AND callee_module IS NOT NULL) WHERE k = 1 AND caller_module <> '__external__' AND callee_module <> '__external__'),
ih AS (SELECT repo_id, child_hash, parent_hash, least_name AS parent_name FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, child_hash ORDER BY loaded_at DESC NULLS LAST, parent_hash ASC NULLS LAST) AS k,
  min(parent_name) OVER (PARTITION BY repo_id, child_hash, parent_hash) AS least_name FROM inheritance WHERE child_hash IS NOT NULL) WHERE k = 1),
calls AS (SELECT e.*, s.name AS s_name, s.module AS s_module, t.name AS t_name, t.module AS t_module, t.caller_count AS t_callers FROM e JOIN n s ON s.repo_id = e.repo_id AND s.hash = e.caller_hash JOIN n t ON t.repo_id = e.repo_id AND t.hash = e.callee_hash),
ed AS (SELECT DISTINCT repo_id, caller_hash AS src, callee_hash AS dst FROM calls)
"""
#: Internal symbols with their features.
ENRICHED = "n LEFT JOIN nf ON nf.repo_id = n.repo_id AND nf.hash = n.hash"
#: reach: (repo_id, src, dst) of all symbols that a symbol reaches by calls; part: (repo_id, node, scc) of the symbols
#: with calls, scc the least symbol of those that reach each other.
REACH = """, reach AS (SELECT repo_id, src, dst FROM ed UNION SELECT r.repo_id, r.src, ed.dst FROM reach r JOIN ed ON ed.repo_id = r.repo_id AND ed.src = r.dst),
ends AS (SELECT repo_id, src AS node FROM ed UNION SELECT repo_id, dst FROM ed),
mutual AS (SELECT a.repo_id, a.src AS node, min(a.dst) AS other FROM reach a JOIN reach b ON b.repo_id = a.repo_id AND b.src = a.dst AND b.dst = a.src GROUP BY ALL),
part AS (SELECT ends.repo_id, ends.node, least(ends.node, coalesce(other, ends.node)) AS scc FROM ends LEFT JOIN mutual ON mutual.repo_id = ends.repo_id AND mutual.node = ends.node)
"""


def query(sql: str | None = None, shared: bool = True, name: str | None = None) -> Callable:
    """Registers a query of a catalog, with the SQL that must give the same rows."""

    def register(f: Callable[[Catalog], DataFrame]) -> Callable:
        key = name or f.__name__
        QUERIES[key] = lambda spark, d: f(Catalog(spark, d))
        if sql:
            ORACLE[key] = (TABLES if shared else "") + sql
        return f

    return register
