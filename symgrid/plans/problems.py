"""Queries of problems 1, 2, 6 and 7, with SQL to compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrid.operators import frequency, hierarchy, orphans, snapdiff
from symgrid.sources.tables import small, table

HEAVY_SHARE = 0.04
KEYS = [("edges", "callee_hash", "caller_hash"), ("nodes", "module", "complexity")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [frequency.heavy_keys(table(spark, d, t), k, v, HEAVY_SHARE).select(F.lit(t).alias("table_name"), F.col("key").alias("key_value")) for t, k, v in KEYS]
    return parts[0].unionByName(parts[1])


def p1_profiles(spark: SparkSession, d: str) -> DataFrame:
    parts = [frequency.profile(frequency.compress(table(spark, d, t), k, v)).select(F.lit(t).alias("table_name"), F.col("key").alias("key_value"), "n_rows", "n_distinct", F.col("mode_value").cast("string").alias("mode_value"), "mode_rows") for t, k, v in KEYS]
    return parts[0].unionByName(parts[1])


def p1_complexity_percentiles(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes").where(F.col("complexity") >= 0)
    return frequency.percentiles(frequency.compress(nodes, "module", "complexity"), [0.5, 0.9]).withColumnRenamed("key", "module")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(*[table(spark, d, t) for t in ("edges", "inheritance", "nodes", "snapshots")])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "column_name", "repo_id", "ref_hash")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per table, column and snapshot time (null for snapshots that are not listed)."""
    at = table(spark, d, "snapshots").groupBy("repo_id").agg(F.max("exported_at").alias("exported_at"))
    lost = _orphans(spark, d).groupBy("table_name", "column_name", "repo_id").agg(F.count(F.lit(1)).alias("n_refs"), F.sum("n_rows").alias("n_rows"))
    return lost.join(small(at), "repo_id", "left").groupBy("table_name", "column_name", "exported_at").agg(F.sum("n_refs").alias("n_refs"), F.sum("n_rows").alias("n_rows"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchies(table(spark, d, "inheritance"), columns=["hash", "root_hash", "depth"])


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each class with its path, which is null on a circle, its number of descendants and the circle it is on or below."""
    found = hierarchy.hierarchies(table(spark, d, "inheritance"))
    return found.select("repo_id", "hash", F.array_join("path", " > ").alias("path"), "n_descendants", "circle", "closes")


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Each ancestor outside circles with each of its descendants and their distance; p6_all_descendants has the rest too."""
    tree = hierarchy.hierarchies(table(spark, d, "inheritance"), columns=["hash", "depth", "path"]).where(F.col("depth") > 0)
    return tree.select("repo_id", F.posexplode("path").alias("at", "hash"), F.col("hash").alias("descendant_hash"), "depth").where(F.col("at") < F.col("depth")).select("repo_id", "hash", "descendant_hash", (F.col("depth") - F.col("at")).alias("distance"))


def p6_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Each class, on or below circles too, with each of its descendants and their distance."""
    return hierarchy.descendants(table(spark, d, "inheritance"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    entries = snapdiff.node_entries(table(spark, d, "nodes")).unionByName(snapdiff.module_edge_entries(table(spark, d, "module_edges")))
    return snapdiff.changes(entries, snapdiff.complete_exports(table(spark, d, "snapshots")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_profiles, p1_complexity_percentiles, p2_found, p2_counts, p6_found, p6_paths, p6_descendants, p6_all_descendants, p7_found)}

_REF = "x IS NOT NULL AND x <> '' AND x NOT LIKE 'unresolved:%'"
_ORPHANS = f"""refs AS (
  SELECT 'edges' AS table_name, 'caller_hash' AS column_name, repo_id, caller_hash AS x FROM edges
  UNION ALL SELECT 'edges', 'callee_hash', repo_id, callee_hash FROM edges
  UNION ALL SELECT 'inheritance', 'parent_hash', repo_id, parent_hash FROM inheritance),
lost AS (SELECT * FROM refs r WHERE {_REF} AND NOT EXISTS (
  SELECT 1 FROM nodes n JOIN snapshots s ON s.repo_id = n.repo_id
  WHERE n.repo_id = r.repo_id AND n.hash = r.x AND n.loaded_at <= s.closed_at))"""
_TREES = """counting AS (
  SELECT repo_id, child_hash AS c, parent_hash AS p FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, child_hash ORDER BY loaded_at DESC, parent_hash ASC NULLS LAST) AS k
    FROM inheritance WHERE child_hash IS NOT NULL) WHERE k = 1),
par AS (SELECT repo_id, c, CASE WHEN p IS NULL OR p = '' OR p LIKE 'unresolved:%' THEN NULL ELSE p END AS p FROM counting),
everyone AS (SELECT repo_id, c AS h FROM par UNION SELECT repo_id, p FROM par WHERE p IS NOT NULL),
roots AS (SELECT e.repo_id, e.h FROM everyone e LEFT JOIN par ON par.repo_id = e.repo_id AND par.c = e.h WHERE par.p IS NULL),
tree AS (
  SELECT repo_id, h, h AS root, 0 AS depth, [h] AS way FROM roots
  UNION ALL SELECT par.repo_id, par.c, tree.root, tree.depth + 1, list_append(tree.way, par.c) FROM tree JOIN par ON par.repo_id = tree.repo_id AND par.p = tree.h),
lost AS (SELECT e.* FROM everyone e ANTI JOIN tree t ON t.repo_id = e.repo_id AND t.h = e.h),
walk AS (
  SELECT l.repo_id, l.h, par.p AS a FROM lost l JOIN par ON par.repo_id = l.repo_id AND par.c = l.h
  UNION SELECT walk.repo_id, walk.h, par.p FROM walk JOIN par ON par.repo_id = walk.repo_id AND par.c = walk.a)"""

_UP = """up AS (
  SELECT repo_id, c AS h, p AS a, 1 AS distance, [p] AS seen FROM par WHERE p IS NOT NULL
  UNION ALL SELECT up.repo_id, up.h, par.p, up.distance + 1, list_append(up.seen, par.p) FROM up JOIN par ON par.repo_id IS NOT DISTINCT FROM up.repo_id AND par.c = up.a
  WHERE par.p IS NOT NULL AND NOT list_contains(up.seen, par.p))"""

ORACLE: dict[str, str] = {
    "p1_found": """SELECT 'edges' AS table_name, callee_hash AS key_value FROM edges WHERE callee_hash IS NOT NULL GROUP BY callee_hash HAVING count(*) >= 0.04 * (SELECT count(*) FROM edges)
UNION ALL SELECT 'nodes', module FROM nodes WHERE module IS NOT NULL GROUP BY module HAVING count(*) >= 0.04 * (SELECT count(*) FROM nodes)""",
    "p1_profiles": """WITH f AS (SELECT 'edges' AS t, callee_hash AS k, caller_hash AS v, NULL AS num, count(*) AS n FROM edges WHERE callee_hash IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'nodes', module, CAST(complexity AS VARCHAR), complexity, count(*) FROM nodes WHERE module IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY t, k ORDER BY v IS NULL, n DESC, num, v) AS i FROM f)
SELECT t AS table_name, k AS key_value, CAST(sum(n) AS BIGINT) AS n_rows, count(v) AS n_distinct, max(CASE WHEN i = 1 THEN v END) AS mode_value,
CAST(max(CASE WHEN i = 1 AND v IS NOT NULL THEN n END) AS BIGINT) AS mode_rows FROM r GROUP BY t, k""",
    "p1_complexity_percentiles": "SELECT module, count(*) AS n, quantile_cont(CAST(complexity AS DOUBLE), 0.5) AS p_50, quantile_cont(CAST(complexity AS DOUBLE), 0.9) AS p_90 FROM nodes WHERE complexity >= 0 AND module IS NOT NULL GROUP BY module",
    "p2_found": f"WITH {_ORPHANS} SELECT DISTINCT table_name, column_name, repo_id, x AS ref_hash FROM lost",
    "p2_counts": f"WITH {_ORPHANS} SELECT table_name, column_name, exported_at, count(DISTINCT (lost.repo_id, x)) AS n_refs, count(*) AS n_rows FROM lost LEFT JOIN snapshots s ON s.repo_id = lost.repo_id GROUP BY ALL",
    "p6_found": f"""WITH RECURSIVE {_TREES}
SELECT repo_id, h AS hash, root AS root_hash, depth FROM tree
UNION ALL SELECT repo_id, h, '', CASE WHEN bool_or(a = h) THEN -1 ELSE -2 END FROM walk GROUP BY repo_id, h""",
    "p6_descendants": f"""WITH RECURSIVE {_TREES}
SELECT repo_id, way[i] AS hash, h AS descendant_hash, CAST(depth + 1 - i AS INTEGER) AS distance FROM (SELECT *, unnest(range(1, depth + 1)) AS i FROM tree)""",
    "p6_paths": f"""WITH RECURSIVE {_TREES}, {_UP},
round AS (SELECT repo_id, h, a FROM up WHERE (repo_id, a, h) IN (SELECT (repo_id, h, a) FROM up)),
circle AS (SELECT repo_id, h, min(a) AS circle FROM round GROUP BY ALL),
hung AS (
  SELECT repo_id, c AS h, p AS a, [c] AS way FROM par WHERE (repo_id, c) IN (SELECT (repo_id, h) FROM lost) AND (repo_id, c) NOT IN (SELECT (repo_id, h) FROM circle)
  UNION ALL SELECT hung.repo_id, hung.h, par.p, list_prepend(hung.a, hung.way) FROM hung JOIN par ON par.repo_id = hung.repo_id AND par.c = hung.a WHERE (hung.repo_id, hung.a) NOT IN (SELECT (repo_id, h) FROM circle)),
ways AS (
  SELECT repo_id, h, way, NULL AS circle FROM tree
  UNION ALL SELECT hung.repo_id, hung.h, list_prepend(hung.a, hung.way), circle.circle FROM hung JOIN circle ON circle.repo_id = hung.repo_id AND circle.h = hung.a
  UNION ALL SELECT repo_id, h, NULL, circle FROM circle)
SELECT w.repo_id, w.h AS hash, array_to_string(w.way, ' > ') AS path, count(up.h) AS n_descendants, w.circle, w.way IS NULL AND w.circle = w.h AS closes
FROM ways w LEFT JOIN up ON up.repo_id = w.repo_id AND up.a = w.h GROUP BY w.repo_id, w.h, w.way, w.circle""",
    "p6_all_descendants": f"""WITH RECURSIVE {_TREES}, {_UP}
SELECT repo_id, a AS hash, h AS descendant_hash, distance FROM up""",
    "p7_found": """WITH ex AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY exported_at, repo_id) AS o FROM snapshots WHERE export_state = 'complete'),
ent AS (
  SELECT 'node' AS entity, repo_id, module AS key_1, name AS key_2, CASE WHEN hash LIKE 'ext:%' OR strpos(hash, ':') = 0 THEN hash ELSE substr(hash, strpos(hash, ':') + 1) END AS v FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, module, name ORDER BY loaded_at DESC NULLS LAST, hash DESC NULLS LAST) AS k FROM nodes WHERE module IS NOT NULL AND name IS NOT NULL) WHERE k = 1
  UNION ALL SELECT 'module_edge', repo_id, caller_module, callee_module, CAST(edge_count AS VARCHAR) FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, caller_module, callee_module ORDER BY loaded_at DESC NULLS LAST, edge_count DESC NULLS LAST) AS k FROM module_edges WHERE caller_module IS NOT NULL AND callee_module IS NOT NULL) WHERE k = 1),
x AS (SELECT ent.*, ex.project, ex.o FROM ent JOIN ex ON ex.repo_id = ent.repo_id),
pairs AS (SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.project, b.project) AS project, coalesce(a.o, b.o + 1) AS o, coalesce(a.key_1, b.key_1) AS key_1, coalesce(a.key_2, b.key_2) AS key_2,
  CASE WHEN b.entity IS NULL THEN 'added' WHEN a.entity IS NULL THEN 'removed' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' END AS change
  FROM x a FULL OUTER JOIN x b ON a.entity = b.entity AND a.project = b.project AND a.o = b.o + 1 AND a.key_1 = b.key_1 AND a.key_2 = b.key_2)
SELECT p.entity, ex.repo_id, p.key_1, p.key_2, p.change FROM pairs p JOIN ex ON ex.project = p.project AND ex.o = p.o WHERE p.o > 1 AND p.change IS NOT NULL""",
}
