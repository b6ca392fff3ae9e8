"""Queries of problems 3, 4, 5, 8, 9 and 10, with SQL to compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrid.llm import clusters, garbled, mixing, percentiles, tokens, topn
from symgrid.operators.rows import latest
from symgrid.sources.tables import keep, table

TOP = 5
QUANTILES = [0.25, 0.5, 0.9]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    scores = latest(table(spark, d, "node_features"), ["repo_id", "hash"], "computed_at", ["betweenness_centrality"])
    modules = latest(table(spark, d, "nodes"), ["repo_id", "hash"], "loaded_at", ["module"])
    return topn.top_n(scores.join(modules, ["repo_id", "hash"]), ["repo_id", "module"], "betweenness_centrality", "hash", TOP)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.probes_together(table(spark, d, "node_features"), table(spark, d, "probe_nodes"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return clusters.summary(table(spark, d, "node_features"))


def _modules(spark: SparkSession, d: str) -> DataFrame:
    """Counting rows of nodes with their snapshot's project."""
    rows = latest(table(spark, d, "nodes"), ["repo_id", "hash"], "loaded_at", ["module", "complexity"])
    return rows.withColumn("project", F.split("repo_id", "@")[0])


def _by_levels(state: DataFrame) -> DataFrame:
    """Percentiles by project, snapshot and module, and merged from the same state by snapshot, project and over all."""
    fine = keep(state, "state")
    none = F.lit(None).cast("string")
    out = None
    for level, group in (("module", ["project", "repo_id", "module"]), ("snapshot", ["project", "repo_id"]), ("project", ["project"]), ("all", [])):
        part = percentiles.percentiles(fine if level == "module" else percentiles.merge(fine, group), group, QUANTILES)
        part = part.select(F.lit(level).alias("level"), *[F.col(c) if c in group else none.alias(c) for c in ("project", "repo_id", "module")], "n", "q", F.round("value", 9).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def p5_complexity(spark: SparkSession, d: str) -> DataFrame:
    return _by_levels(percentiles.counts(_modules(spark, d), ["project", "repo_id", "module"], "complexity"))


def p5_complexity_pct(spark: SparkSession, d: str) -> DataFrame:
    scores = latest(table(spark, d, "node_features"), ["repo_id", "hash"], "computed_at", ["complexity_pct"])
    # a value without a row in nodes has no module and counts in its snapshot all the same
    rows = scores.join(_modules(spark, d).drop("complexity", "project").hint("merge"), ["repo_id", "hash"], "left").withColumn("project", F.split("repo_id", "@")[0])
    return _by_levels(percentiles.counts(rows, ["project", "repo_id", "module"], "complexity_pct"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return keep(tokens.count(table(spark, d, "documents"), ["doc_id", "source"]), "tokens")


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_counted(spark, d), table(spark, d, "source_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_counted(spark, d), table(spark, d, "source_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.find(table(spark, d, "documents"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.find(table(spark, d, "documents"), restored=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p4_found, p4_groups, p5_complexity, p5_complexity_pct, p8_ids, p9_selection, p9_shares, p10_found, p10_restored)}

_NODES = "nd AS (SELECT *, split_part(repo_id, '@', 1) AS project FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, hash ORDER BY loaded_at DESC NULLS LAST, module DESC NULLS LAST, complexity DESC NULLS LAST) AS k FROM nodes) WHERE k = 1)"
_FEATURES = "nf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, hash ORDER BY computed_at DESC NULLS LAST) AS k FROM node_features) WHERE k = 1)"
_LEVELS = """l AS (SELECT 'module' AS level, project, repo_id, module, v FROM x UNION ALL SELECT 'snapshot', project, repo_id, NULL, v FROM x
UNION ALL SELECT 'project', project, NULL, NULL, v FROM x UNION ALL SELECT 'all', NULL, NULL, NULL, v FROM x),
g AS (SELECT level, project, repo_id, module, count(*) AS n, quantile_cont(v, [0.25, 0.5, 0.9]) AS qs FROM l GROUP BY ALL)
SELECT level, project, repo_id, module, n, CAST([0.25, 0.5, 0.9][i] AS DOUBLE) AS q, round(qs[i], 9) AS value FROM g, (SELECT unnest([1, 2, 3]) AS i)"""

ORACLE: dict[str, str] = {
    "p3_found": f"""WITH {_NODES}, {_FEATURES},
r AS (SELECT nf.repo_id, nd.module, nf.hash, row_number() OVER (PARTITION BY nf.repo_id, nd.module ORDER BY nf.betweenness_centrality DESC, nf.hash) AS i
FROM nf JOIN nd ON nd.repo_id = nf.repo_id AND nd.hash = nf.hash WHERE nd.module IS NOT NULL AND nf.betweenness_centrality IS NOT NULL AND NOT isnan(nf.betweenness_centrality))
SELECT repo_id, module, CAST(i AS INTEGER) AS rank_no, hash FROM r WHERE i <= 5""",
    "p5_complexity": f"WITH {_NODES}, x AS (SELECT project, repo_id, module, CAST(complexity AS DOUBLE) AS v FROM nd WHERE complexity IS NOT NULL AND complexity <> -1), {_LEVELS}",
    "p5_complexity_pct": f"WITH {_NODES}, {_FEATURES}, x AS (SELECT split_part(nf.repo_id, '@', 1) AS project, nf.repo_id, nd.module, nf.complexity_pct AS v FROM nf LEFT JOIN nd ON nd.repo_id = nf.repo_id AND nd.hash = nf.hash WHERE complexity_pct IS NOT NULL AND NOT isnan(complexity_pct) AND complexity_pct <> -1), {_LEVELS}",
}
