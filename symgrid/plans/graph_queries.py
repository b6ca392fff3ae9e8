"""Queries of graph algorithms, signals, communities, patterns and statistics, with SQL to compare."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrid.operators import analyses as A
from symgrid.operators import communities as K
from symgrid.operators import graph, statistics
from symgrid.operators.patterns import REGISTRY, Detector, one_way
from symgrid.plans.registry import REACH, query
from symgrid.sources.catalog import Catalog
from symgrid.sources.tables import keep

C = F.col


def _graph(c: Catalog) -> tuple[DataFrame, DataFrame]:
    return keep(c.edges_distinct, "edges"), keep(c.internal_nodes.select("repo_id", C("hash").alias("node")), "nodes")


def _condensed(c: Catalog) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components, calls between them, and their sizes."""
    e = keep(c.edges_distinct, "edges")
    parts = keep(graph.scc(e), "scc")
    sizes = parts.groupBy("repo_id", C("scc").alias("node")).agg(F.count(F.lit(1)).alias("size"))
    return parts, keep(graph.condense(e, parts), "dag"), keep(sizes, "sizes")


# ways through the graph


@query("SELECT repo_id, node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT repo_id, caller_hash AS node, 0 AS i, 1 AS o FROM calls UNION ALL SELECT repo_id, callee_hash, 1, 0 FROM calls) GROUP BY ALL")
def degrees(c):
    return graph.degrees(c.calls.select("repo_id", C("caller_hash").alias("src"), C("callee_hash").alias("dst")))


@query(f"{REACH} SELECT * FROM part")
def scc(c):
    return graph.scc(c.edges_distinct)


_DAG = f"{REACH}, dag AS (SELECT DISTINCT ed.repo_id, a.scc AS src, b.scc AS dst FROM ed JOIN part a ON a.repo_id = ed.repo_id AND a.node = ed.src JOIN part b ON b.repo_id = ed.repo_id AND b.node = ed.dst WHERE a.scc <> b.scc), sup AS (SELECT repo_id, scc AS node, count(*) AS size FROM part GROUP BY ALL)"


@query(f"{_DAG} SELECT * FROM dag")
def condensation(c):
    return _condensed(c)[1]


_DEPTH = "{name} AS (SELECT repo_id, node, 0 AS d FROM sup UNION SELECT {name}.repo_id, dag.{to}, d + 1 FROM {name} JOIN dag ON dag.repo_id = {name}.repo_id AND dag.{at} = {name}.node)"


@query(f"{_DAG}, {_DEPTH.format(name='down', at='src', to='dst')}, {_DEPTH.format(name='up', at='dst', to='src')} SELECT a.repo_id, a.node, a.d AS topological_depth, b.d AS reverse_topological_depth FROM (SELECT repo_id, node, max(d) AS d FROM down GROUP BY ALL) a JOIN (SELECT repo_id, node, max(d) AS d FROM up GROUP BY ALL) b ON a.repo_id = b.repo_id AND a.node = b.node")
def depths(c):
    _, dag, sizes = _condensed(c)
    down = graph.longest_depth(dag, sizes.select("repo_id", "node")).withColumnRenamed("depth", "topological_depth")
    return down.join(graph.longest_depth(graph.reverse(dag), sizes.select("repo_id", "node")).withColumnRenamed("depth", "reverse_topological_depth"), ["repo_id", "node"])


@query(f"{_DAG}, ways AS (SELECT repo_id, node, CAST(size AS DOUBLE) AS k, 0 AS i FROM sup UNION ALL SELECT ways.repo_id, dag.src, sum(k), max(i) + 1 FROM ways JOIN dag ON dag.repo_id = ways.repo_id AND dag.dst = ways.node GROUP BY ways.repo_id, dag.src) SELECT repo_id, node, sum(k) AS n FROM ways GROUP BY ALL")
def path_counts(c):
    _, dag, sizes = _condensed(c)
    return graph.path_counts(dag, sizes)


@query(f"{REACH} SELECT part.repo_id, node, CAST((SELECT count(*) FROM reach r WHERE r.repo_id = part.repo_id AND r.src = part.node AND r.dst <> part.node) + 1 AS DOUBLE) AS n FROM part")
def reach_counts(c):
    parts, dag, sizes = _condensed(c)
    of = graph.reach_counts(dag, sizes).withColumnRenamed("node", "scc")
    return parts.join(of, ["repo_id", "scc"]).select("repo_id", "node", "n")


_SEEDS = "(SELECT repo_id, min(hash) AS h FROM n WHERE caller_count > 0 GROUP BY repo_id)"


@query(f"""{REACH}, f AS (SELECT repo_id, h AS node, 0 AS d FROM {_SEEDS} UNION SELECT ed.repo_id, ed.dst, d + 1 FROM f JOIN ed ON ed.repo_id = f.repo_id AND ed.src = f.node WHERE d < 3),
b AS (SELECT repo_id, h AS node, 0 AS d FROM {_SEEDS} UNION SELECT ed.repo_id, ed.src, d + 1 FROM b JOIN ed ON ed.repo_id = b.repo_id AND ed.dst = b.node WHERE d < 3)
SELECT repo_id, node, min(d) AS depth FROM (SELECT * FROM f UNION ALL SELECT * FROM b) GROUP BY ALL""")
def neighbourhood(c):
    seeds = c.internal_nodes.where(C("caller_count") > 0).groupBy("repo_id").agg(F.min("hash").alias("node"))
    return graph.bfs_both(c.edges_distinct, seeds, 3)


_CHOSEN = "ch AS (SELECT repo_id, hash AS node FROM n QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY caller_count + callee_count DESC NULLS LAST, hash) <= 3)"


@query(f""", {_CHOSEN}, f AS (SELECT repo_id, node AS s, node, 0 AS d FROM ch UNION SELECT ed.repo_id, s, ed.dst, d + 1 FROM f JOIN ed ON ed.repo_id = f.repo_id AND ed.src = f.node WHERE d < 4),
b AS (SELECT repo_id, node AS t, node, 0 AS d FROM ch UNION SELECT ed.repo_id, t, ed.src, d + 1 FROM b JOIN ed ON ed.repo_id = b.repo_id AND ed.dst = b.node WHERE d < 4),
fd AS (SELECT repo_id, s, node, min(d) AS d FROM f GROUP BY ALL), bd AS (SELECT repo_id, t, node, min(d) AS d FROM b GROUP BY ALL),
st AS (SELECT ed.repo_id, su.s, tv.t, ed.src, ed.dst, su.d + 1 + tv.d AS len FROM ed JOIN fd su ON su.repo_id = ed.repo_id AND su.node = ed.src JOIN fd sv ON sv.repo_id = ed.repo_id AND sv.node = ed.dst AND sv.s = su.s AND sv.d > su.d
  JOIN bd tv ON tv.repo_id = ed.repo_id AND tv.node = ed.dst AND tv.t <> su.s JOIN bd tu ON tu.repo_id = ed.repo_id AND tu.node = ed.src AND tu.t = tv.t AND tu.d > tv.d WHERE su.d + 1 + tv.d <= 4),
fr AS (SELECT DISTINCT repo_id, s, t, s AS node FROM st UNION SELECT st.repo_id, st.s, st.t, st.dst FROM fr JOIN st ON st.repo_id = fr.repo_id AND st.s = fr.s AND st.t = fr.t AND st.src = fr.node),
br AS (SELECT DISTINCT repo_id, s, t, t AS node FROM st UNION SELECT st.repo_id, st.s, st.t, st.src FROM br JOIN st ON st.repo_id = br.repo_id AND st.s = br.s AND st.t = br.t AND st.dst = br.node)
SELECT st.repo_id, st.src, st.dst, min(len) AS length FROM st WHERE EXISTS (SELECT 1 FROM fr WHERE fr.repo_id = st.repo_id AND fr.s = st.s AND fr.t = st.t AND fr.node = st.t) AND EXISTS (SELECT 1 FROM fr WHERE fr.repo_id = st.repo_id AND fr.s = st.s AND fr.t = st.t AND fr.node = st.src)
AND EXISTS (SELECT 1 FROM br WHERE br.repo_id = st.repo_id AND br.s = st.s AND br.t = st.t AND br.node = st.dst) GROUP BY ALL""")
def chain_edges(c):
    busiest = [(C("caller_count") + C("callee_count")).desc_nulls_last()]
    chosen = c.scan([], None, busiest, 3).select("repo_id", C("hash").alias("node"))
    return graph.chain_edges(c.edges_distinct, chosen, 4)


# scores

_PR = """out_ AS (SELECT repo_id, src, count(*) AS o FROM ed GROUP BY ALL), sz AS (SELECT repo_id, count(*) AS k FROM n GROUP BY 1),
pr AS (SELECT n.repo_id, n.hash AS node, 1.0::DOUBLE / sz.k AS rank, o, sz.k AS k, 0 AS i, false AS ended FROM n JOIN sz ON sz.repo_id = n.repo_id LEFT JOIN out_ ON out_.repo_id = n.repo_id AND out_.src = n.hash
UNION ALL SELECT repo_id, node, new, o, k, i + 1, sum(abs(new - rank)) OVER (PARTITION BY repo_id) < k * 1e-8 FROM (
  SELECT p.repo_id, p.node, p.rank, p.o, p.k, p.i, 0.15 / p.k + 0.85 * (coalesce(g.got, 0) + l.loose / p.k) AS new FROM pr p
  LEFT JOIN (SELECT ed.repo_id, ed.dst, sum(q.rank / q.o) AS got FROM pr q JOIN ed ON ed.repo_id = q.repo_id AND ed.src = q.node GROUP BY ALL) g ON g.repo_id = p.repo_id AND g.dst = p.node
  JOIN (SELECT repo_id, coalesce(sum(CASE WHEN o IS NULL THEN rank END), 0) AS loose FROM pr GROUP BY ALL) l ON l.repo_id = p.repo_id WHERE NOT p.ended AND p.i < 200))"""


@query(f", {_PR} SELECT repo_id, node, round(rank, 8) AS rank FROM pr QUALIFY i = max(i) OVER (PARTITION BY repo_id)")
def pagerank(c):
    return graph.pagerank(*_graph(c)).select("repo_id", "node", F.round("rank", 8).alias("rank"))


_HITS = """ht AS (SELECT repo_id, hash AS node, 1.0::DOUBLE / count(*) OVER (PARTITION BY repo_id) AS hub, 0.0::DOUBLE AS auth, 0 AS i, false AS ended FROM n
UNION ALL SELECT repo_id, node, new, a, i + 1, max(abs(new - hub)) OVER (PARTITION BY repo_id) < 1e-8 FROM (
  SELECT p.repo_id, p.node, p.hub, p.i, coalesce(x.a, 0) AS a, coalesce(y.h / nullif(sum(y.h) OVER (PARTITION BY p.repo_id), 0), 0) AS new FROM ht p
  LEFT JOIN (SELECT repo_id, node, a / nullif(sum(a) OVER (PARTITION BY repo_id), 0) AS a FROM (SELECT ed.repo_id, ed.dst AS node, sum(q.hub) AS a FROM ht q JOIN ed ON ed.repo_id = q.repo_id AND ed.src = q.node GROUP BY ALL)) x ON x.repo_id = p.repo_id AND x.node = p.node
  LEFT JOIN (SELECT ed.repo_id, ed.src AS node, sum(z.a) AS h FROM (SELECT e2.repo_id, e2.dst AS node, sum(q2.hub) AS a FROM ht q2 JOIN ed e2 ON e2.repo_id = q2.repo_id AND e2.src = q2.node GROUP BY ALL) z JOIN ed ON ed.repo_id = z.repo_id AND ed.dst = z.node GROUP BY ALL) y ON y.repo_id = p.repo_id AND y.node = p.node
  WHERE NOT p.ended AND p.i < 200))"""


@query(f", {_HITS} SELECT repo_id, node, round(hub, 6) AS hub, round(auth, 6) AS authority FROM ht QUALIFY i = max(i) OVER (PARTITION BY repo_id)")
def hits(c):
    return graph.hits(*_graph(c)).select("repo_id", "node", F.round("hub", 6).alias("hub"), F.round("authority", 6).alias("authority"))


#: Distances from each symbol, shortest ways by level, and what they give back from the farthest level on.
_BC = """dist(repo_id, s, node, d) USING KEY (repo_id, s, node) AS (SELECT repo_id, hash, hash, 0 FROM n
  UNION SELECT x.repo_id, x.s, ed.dst, min(x.d) + 1 FROM dist x JOIN ed ON ed.repo_id = x.repo_id AND ed.src = x.node WHERE NOT EXISTS (SELECT 1 FROM recurring.dist r WHERE r.repo_id = x.repo_id AND r.s = x.s AND r.node = ed.dst) GROUP BY x.repo_id, x.s, ed.dst),
down AS (SELECT a.repo_id, a.s, a.node AS v, b.node AS w, b.d FROM dist a JOIN ed ON ed.repo_id = a.repo_id AND ed.src = a.node JOIN dist b ON b.repo_id = a.repo_id AND b.s = a.s AND b.node = ed.dst AND b.d = a.d + 1),
sig AS (SELECT repo_id, s, node, d, 1.0::DOUBLE AS p FROM dist WHERE d = 0 UNION ALL SELECT x.repo_id, x.s, down.w, max(down.d), sum(x.p) FROM sig x JOIN down ON down.repo_id = x.repo_id AND down.s = x.s AND down.v = x.node GROUP BY x.repo_id, x.s, down.w),
far AS (SELECT max(d) AS most FROM sig),
bk AS (SELECT repo_id, s, node, d, p, 0.0::DOUBLE AS delta FROM sig, far WHERE d = most
  UNION ALL SELECT g.repo_id, g.s, g.node, g.d, g.p, coalesce(g.p * c.share, 0) FROM sig g JOIN (SELECT max(d) - 1 AS d FROM bk) l ON l.d = g.d LEFT JOIN (SELECT down.repo_id, down.s, down.v, sum((1 + x.delta) / x.p) AS share FROM bk x JOIN down ON down.repo_id = x.repo_id AND down.s = x.s AND down.w = x.node GROUP BY ALL) c ON c.repo_id = g.repo_id AND c.s = g.s AND c.v = g.node WHERE g.d > 0),
bc AS (SELECT n.repo_id, n.hash AS node, round(CASE WHEN z.k > 2 THEN coalesce(b, 0) / ((z.k - 1) * (z.k - 2)) ELSE 0 END, 6) AS score FROM n JOIN (SELECT repo_id, count(*) AS k FROM n GROUP BY 1) z ON z.repo_id = n.repo_id
  LEFT JOIN (SELECT repo_id, node, sum(delta) AS b FROM bk WHERE node <> s GROUP BY ALL) q ON q.repo_id = n.repo_id AND q.node = n.hash)"""


@query(f", {_BC} SELECT repo_id, node, score FROM bc")
def betweenness(c):
    return graph.betweenness(*_graph(c))


_TRIANGLES = """tr AS (SELECT d.repo_id, d.node, coalesce(t, 0) AS triangles, degree, round(CASE WHEN degree > 1 THEN 2 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END, 4) AS coefficient FROM (
SELECT repo_id, node, count(*) AS degree FROM (SELECT DISTINCT repo_id, src AS node, dst AS other FROM ed WHERE src <> dst UNION SELECT DISTINCT repo_id, dst, src FROM ed WHERE src <> dst) GROUP BY ALL) d LEFT JOIN (
SELECT repo_id, node, CAST(count(*) AS BIGINT) AS t FROM (WITH u AS (SELECT DISTINCT repo_id, least(src, dst) AS a, greatest(src, dst) AS b FROM ed WHERE src <> dst)
SELECT x.repo_id, unnest([x.a, x.b, y.b]) AS node FROM u x JOIN u y ON y.repo_id = x.repo_id AND y.a = x.b JOIN u z ON z.repo_id = x.repo_id AND z.a = x.a AND z.b = y.b) GROUP BY ALL) t ON t.repo_id = d.repo_id AND t.node = d.node)"""


@query(f", {_TRIANGLES} SELECT * FROM tr")
def clustering(c):
    return graph.clustering(c.edges_distinct)


@query("""SELECT n.repo_id, n.hash, coalesce(fi, 0) AS xmod_fan_in, coalesce(fo, 0) AS xmod_fan_out, coalesce(ratio, 0) AS xmod_call_ratio, mod AS dominant_callee_mod, coalesce(frac, 0) AS dominant_callee_frac,
round(CASE WHEN coalesce(fi, 0) + coalesce(fo, 0) > 0 THEN coalesce(fo, 0) / (coalesce(fi, 0) + coalesce(fo, 0)) ELSE 0.5 END, 4) AS stability_rank FROM n
LEFT JOIN (SELECT t.repo_id, t.hash, count(DISTINCT s.module) AS fi FROM n t JOIN e ON e.repo_id = t.repo_id AND e.callee_hash = t.hash JOIN alln s ON s.repo_id = e.repo_id AND s.hash = e.caller_hash WHERE s.module IS NOT NULL AND s.module <> t.module AND s.module <> '__external__' GROUP BY ALL) a ON a.repo_id = n.repo_id AND a.hash = n.hash
LEFT JOIN (SELECT s.repo_id, s.hash, count(DISTINCT CASE WHEN t.module <> s.module AND t.module <> '__external__' THEN t.module END) AS fo, round(sum(CASE WHEN t.module <> s.module AND t.module <> '__external__' THEN 1 ELSE 0 END) / count(*), 4) AS ratio
FROM n s JOIN e ON e.repo_id = s.repo_id AND e.caller_hash = s.hash JOIN n t ON t.repo_id = e.repo_id AND t.hash = e.callee_hash GROUP BY ALL) b ON b.repo_id = n.repo_id AND b.hash = n.hash
LEFT JOIN (SELECT repo_id, hash, first(module ORDER BY k DESC, module) AS mod, round(max(k) / sum(k), 4) AS frac FROM (SELECT s.repo_id, s.hash, t.module, count(*) AS k FROM n s JOIN e ON e.repo_id = s.repo_id AND e.caller_hash = s.hash JOIN n t ON t.repo_id = e.repo_id AND t.hash = e.callee_hash
WHERE t.module <> '__external__' GROUP BY ALL) GROUP BY ALL) d ON d.repo_id = n.repo_id AND d.hash = n.hash""")
def boundary_signals(c):
    return A.boundary_signals(c)


@query("SELECT repo_id, hash, round(rank() OVER (PARTITION BY repo_id ORDER BY coalesce(complexity, 0)) / count(*) OVER (PARTITION BY repo_id), 4) AS complexity_pct FROM n")
def complexity_rank(c):
    return A.complexity_rank(c)


@query("""SELECT repo_id, hash, round(CASE WHEN coalesce(caller_count, 0) = 0 OR coalesce(callee_count, 0) = 0 THEN 0 ELSE least(ln(1 + caller_count) * ln(1 + callee_count) / (1 + coalesce(complexity, 0)) / 10, 1) END, 4) AS middleman_score FROM n""")
def simple_signals(c):
    return A.simple_signals(c)


@query()
def enrich(c):
    return A.enrich(c)


@query(f"""{_DAG}, {_DEPTH.format(name='down_', at='src', to='dst')}, {_DEPTH.format(name='up_', at='dst', to='src')},
ce AS (SELECT repo_id, node, CAST(size AS DOUBLE) AS k FROM sup UNION ALL SELECT ce.repo_id, dag.src, sum(k) FROM ce JOIN dag ON dag.repo_id = ce.repo_id AND dag.dst = ce.node GROUP BY ce.repo_id, dag.src),
cr AS (SELECT repo_id, node, CAST(size AS DOUBLE) AS k FROM sup UNION ALL SELECT cr.repo_id, dag.dst, sum(k) FROM cr JOIN dag ON dag.repo_id = cr.repo_id AND dag.src = cr.node GROUP BY cr.repo_id, dag.dst),
ps AS (SELECT part.repo_id, scc, count(*) AS size, CAST(count(DISTINCT coalesce('m' || module, '')) > 1 AS INTEGER) AS several FROM part JOIN n ON n.repo_id = part.repo_id AND n.hash = part.node GROUP BY ALL)
SELECT n.repo_id, n.hash, coalesce(ps.scc, n.hash) AS scc, coalesce(ps.size, 1) AS scc_size, coalesce(several, 0) AS scc_cross_module, coalesce((SELECT max(d) FROM down_ WHERE down_.repo_id = n.repo_id AND down_.node = ps.scc), 0) AS topological_depth, coalesce((SELECT max(d) FROM up_ WHERE up_.repo_id = n.repo_id AND up_.node = ps.scc), 0) AS reverse_topological_depth,
coalesce((SELECT sum(k) - 1 FROM cr WHERE cr.repo_id = n.repo_id AND cr.node = ps.scc), 0) AS transitive_callers, coalesce((SELECT sum(k) - 1 FROM ce WHERE ce.repo_id = n.repo_id AND ce.node = ps.scc), 0) AS transitive_callees
FROM n LEFT JOIN part ON part.repo_id = n.repo_id AND part.node = n.hash LEFT JOIN ps ON ps.repo_id = n.repo_id AND ps.scc = part.scc""")
def reach_signals(c):
    names = ["repo_id", "hash", "scc", "scc_size", "scc_cross_module", "topological_depth", "reverse_topological_depth", "transitive_callers", "transitive_callees"]
    return A.enrich(c).select(*names)


@query(f""", {_PR}, {_HITS}, {_TRIANGLES}, {_BC} SELECT n.repo_id, n.hash, bc.score AS betweenness_centrality, round(pr.rank, 6) AS pagerank, round(ht.hub, 6) AS hub_score, round(ht.auth, 6) AS authority_score, coalesce(tr.coefficient, 0) AS clustering_coeff
FROM n JOIN bc ON bc.repo_id = n.repo_id AND bc.node = n.hash JOIN (SELECT * FROM pr QUALIFY i = max(i) OVER (PARTITION BY repo_id)) pr ON pr.repo_id = n.repo_id AND pr.node = n.hash JOIN (SELECT * FROM ht QUALIFY i = max(i) OVER (PARTITION BY repo_id)) ht ON ht.repo_id = n.repo_id AND ht.node = n.hash
LEFT JOIN tr ON tr.repo_id = n.repo_id AND tr.node = n.hash""")
def score_signals(c):
    return A.enrich(c).select("repo_id", "hash", "betweenness_centrality", "pagerank", "hub_score", "authority_score", "clustering_coeff")


@query(f""", {_BC}, zn AS (SELECT repo_id, count(*) AS k FROM n GROUP BY 1), dg AS (SELECT repo_id, dst AS node, count(*) AS i FROM ed GROUP BY ALL), cs AS (SELECT bc.repo_id, bc.node, CASE WHEN zn.k > 2000 THEN round(coalesce(i / max(i) OVER (PARTITION BY bc.repo_id), 0), 6) ELSE score END AS score
FROM bc JOIN zn ON zn.repo_id = bc.repo_id LEFT JOIN dg ON dg.repo_id = bc.repo_id AND dg.node = bc.node) SELECT cs.repo_id, CAST(row_number() OVER (PARTITION BY cs.repo_id ORDER BY score DESC, cs.node) AS INTEGER) AS row_no, hash, name, module, file_path, caller_count, callee_count, risk, round_even(score, 4) AS centrality
FROM cs JOIN n ON n.repo_id = cs.repo_id AND n.hash = cs.node QUALIFY row_no <= 30""")
def centrality(c):
    return A.centrality(c)


# communities


@query()
def louvain(c):
    """The report on the communities that are found here."""
    return K.Report(c).communities()


_LABELS = """lb AS (SELECT n.repo_id, n.hash AS node, CAST(community_id AS VARCHAR) AS c, name, module, file_path FROM n JOIN nf ON nf.repo_id = n.repo_id AND nf.hash = n.hash WHERE community_id >= 0),
ck AS (SELECT repo_id, c, module, count(*) AS k FROM lb GROUP BY ALL), cz AS (SELECT repo_id, c, CAST(sum(k) AS BIGINT) AS size, first(module ORDER BY k DESC, module NULLS LAST) AS dom, max(k) AS top FROM ck GROUP BY ALL HAVING sum(k) > 1)"""


def _report(c: Catalog) -> K.Report:
    """The report on the communities that came with the features."""
    given = c.features.where(C("community_id") >= 0).join(c.internal_nodes.select("repo_id", "hash"), ["repo_id", "hash"])
    return K.Report(c, label=given.select("repo_id", C("hash").alias("node"), C("community_id").cast("string").alias("community")))


@query(f""", {_LABELS} SELECT cz.repo_id, CAST(row_number() OVER (PARTITION BY cz.repo_id ORDER BY size DESC, cz.c) AS INTEGER) AS row_no, cz.c AS community, size, dom AS dominant, round_even(top / size, 3) AS purity,
(SELECT list(coalesce(module, '') || '=' || CAST(k AS VARCHAR) ORDER BY k DESC, module NULLS LAST)[:6] FROM ck WHERE ck.repo_id = cz.repo_id AND ck.c = cz.c) AS top_modules FROM cz""")
def communities(c):
    return _report(c).communities()


@query(f""", {_LABELS}, cv AS (SELECT lb.* FROM lb JOIN cz ON cz.repo_id = lb.repo_id AND cz.c = lb.c), lc AS (SELECT calls.repo_id, least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, count(*) AS count FROM calls JOIN cv x ON x.repo_id = calls.repo_id AND x.node = caller_hash JOIN cv y ON y.repo_id = calls.repo_id AND y.node = callee_hash WHERE x.c <> y.c GROUP BY ALL)
SELECT repo_id, a, b, count, round_even(count / max(count) OVER (PARTITION BY repo_id), 3) AS weight FROM lc""")
def community_links(c):
    return _report(c).links()


@query(f""", {_LABELS} SELECT lb.repo_id, CAST(row_number() OVER (PARTITION BY lb.repo_id ORDER BY coalesce(module, ''), coalesce(name, ''), node) AS INTEGER) AS row_no, node AS hash, name, module AS declared_module, dom AS inferred_module, lb.c AS community, file_path FROM lb JOIN cz ON cz.repo_id = lb.repo_id AND cz.c = lb.c WHERE module IS DISTINCT FROM dom AND 2 * top >= size QUALIFY row_no <= 200""")
def misaligned_symbols(c):
    return _report(c).misaligned()


@query(f", {_LABELS} SELECT repo_id, count(*) AS community_count, CAST(sum(size) AS BIGINT) AS total_nodes, round_even(sum(top) / sum(size), 3) AS alignment_score FROM cz GROUP BY 1")
def community_totals(c):
    return _report(c).totals()


# patterns

_DEG = """d AS (SELECT repo_id, node, CAST(sum(i) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o FROM (SELECT repo_id, caller_hash AS node, 0 AS i, 1 AS o FROM calls UNION ALL SELECT repo_id, callee_hash, 1, 0 FROM calls) GROUP BY ALL),
cd AS (SELECT c.repo_id, caller_hash AS src, callee_hash AS dst, s_module, t_module, d.i AS din, c.s_module IS NOT DISTINCT FROM c.t_module AS same FROM calls c JOIN d ON d.repo_id = c.repo_id AND d.node = c.callee_hash)"""


def _conf(base: str, cap: float) -> str:
    """A confidence in doubles, as literals with a point are decimals."""
    return f"round_even({re.sub(r'(\d+\.\d+)', r'CAST(\1 AS DOUBLE)', f'least({cap}, {base})')}, 2)"


def _listed(where: str, most: int) -> str:
    """The first callees of a symbol that fit, by hash, repeated as often as there are edge rows."""
    return f"coalesce((SELECT list(dst ORDER BY dst) FROM cd WHERE cd.repo_id = p.repo_id AND cd.src = p.node AND {where})[:{most}], [])"


_SHAPES = f"""p AS (SELECT d.repo_id, d.node, d.i, d.o, count(*) FILTER (same AND din <= 2) AS sn, count(*) FILTER (same AND din <= 2 AND src <> dst) AS sib, count(*) FILTER (din <= 2) AS narrow, count(*) FILTER (din = 1) AS single,
count(DISTINCT CASE WHEN NOT same THEN t_module END) AS mods, coalesce(bool_or(src = dst), false) AS loop, count(*) FILTER (same AND din <= 1) AS subj, min(dst) FILTER (same AND din <= 1) AS subject FROM d LEFT JOIN cd ON cd.repo_id = d.repo_id AND cd.src = d.node GROUP BY ALL),
sh AS (SELECT repo_id, 'singleton' AS pattern, node AS hash, {_conf("least(0.95, 0.55 + 0.04 * i) + CASE WHEN single > 0 THEN 0.1 ELSE 0 END", 0.95)} AS confidence, list_prepend(node, {_listed("din = 1", 1)}) AS nodes FROM p WHERE i >= 4 AND o <= 3
UNION ALL SELECT repo_id, 'factory_method', node, {_conf("0.50 + 0.06 * sn", 0.90)}, list_prepend(node, {_listed("same AND din <= 2", 6)}) FROM p WHERE sn >= 3
UNION ALL SELECT repo_id, 'observer', node, {_conf("0.55 + 0.05 * narrow", 0.92)}, list_prepend(node, {_listed("din <= 2", 8)}) FROM p WHERE o >= 5 AND narrow >= 4
UNION ALL SELECT repo_id, 'facade', node, {_conf("0.50 + 0.08 * mods", 0.90)}, list_prepend(node, {_listed("NOT same", 8)}) FROM p WHERE mods >= 3
UNION ALL SELECT repo_id, 'composite_recursive', node, 0.85, [node] FROM p WHERE loop
UNION ALL SELECT repo_id, 'strategy', node, {_conf("0.48 + 0.07 * sib", 0.85)}, list_prepend(node, {_listed("same AND din <= 2 AND src <> dst", 8)}) FROM p WHERE sib BETWEEN 3 AND 8
UNION ALL SELECT repo_id, 'template_method', node, {_conf("0.48 + 0.05 * narrow", 0.87)}, list_prepend(node, {_listed("din <= 2", 8)}) FROM p WHERE narrow >= 5
UNION ALL SELECT repo_id, 'command', node, {_conf("0.50 + 0.05 * single", 0.88)}, list_prepend(node, {_listed("din = 1", 8)}) FROM p WHERE single >= 5
UNION ALL SELECT repo_id, 'mediator', node, {_conf("0.45 + 0.025 * (i + o)", 0.90)}, list_prepend(node, list_concat(coalesce((SELECT list(caller_hash ORDER BY caller_hash) FROM calls c WHERE c.repo_id = p.repo_id AND c.callee_hash = p.node)[:4], []), {_listed("true", 4)})) FROM p WHERE i >= 4 AND o >= 4
UNION ALL SELECT repo_id, 'proxy', node, {_conf("0.52 + 0.04 * i + 0.03 * (narrow - 1)", 0.88)}, list_concat([node, subject], {_listed("din <= 2 AND dst <> p.subject", 4)}) FROM p WHERE i >= 3 AND subj >= 1 AND narrow >= 3)"""
_MR = f"""mr AS (SELECT repo_id, hub, first(tgt ORDER BY k DESC, tgt) AS reducer FROM (SELECT a.repo_id, a.src AS hub, b.dst AS tgt, count(*) AS k FROM cd a JOIN d ON d.repo_id = a.repo_id AND d.node = a.src AND d.o >= 4 JOIN cd b ON b.repo_id = a.repo_id AND b.src = a.dst WHERE b.dst <> a.src GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL),
mp AS (SELECT p.repo_id, 'map_reduce' AS pattern, p.node AS hash, {_conf("0.50 + 0.06 * o", 0.86)} AS confidence, list_append(list_prepend(p.node, {_listed("true", 6)}), reducer) AS nodes FROM mr JOIN d p ON p.repo_id = mr.repo_id AND p.node = mr.hub)"""
_RUNS = f"""lk AS (SELECT cd.repo_id, src, dst FROM cd JOIN d ON d.repo_id = cd.repo_id AND d.node = src WHERE d.o = 1 AND din = 1 AND src <> dst),
loopy AS (SELECT repo_id, src AS start, dst AS node, 1 AS k FROM lk UNION SELECT l.repo_id, l.start, lk.dst, k + 1 FROM loopy l JOIN lk ON lk.repo_id = l.repo_id AND lk.src = l.node WHERE l.node <> l.start),
circ AS (SELECT repo_id, start AS node FROM loopy WHERE node = start), heads AS (SELECT repo_id, src AS head FROM lk WHERE (repo_id, src) NOT IN (SELECT (repo_id, dst) FROM lk)
UNION SELECT c.repo_id, min(least(c.node, l.node)) FROM circ c JOIN loopy l ON l.repo_id = c.repo_id AND l.start = c.node GROUP BY c.repo_id, c.node),
wk AS (SELECT repo_id, head, head AS at, [head] AS way FROM heads UNION ALL SELECT wk.repo_id, head, dst, list_append(way, dst) FROM wk JOIN lk ON lk.repo_id = wk.repo_id AND lk.src = wk.at WHERE NOT list_contains(way, dst)),
run AS (SELECT wk.repo_id, head, way, len(way) AS len, d.i FROM (SELECT * FROM wk QUALIFY row_number() OVER (PARTITION BY repo_id, head ORDER BY len(way) DESC) = 1) wk JOIN d ON d.repo_id = wk.repo_id AND d.node = head WHERE len(way) > 1),
rn AS (SELECT repo_id, pattern, way[1] AS hash, CASE pattern WHEN 'decorator_chain' THEN {_conf("0.45 + 0.07 * len(way)", 0.88)} WHEN 'pipeline' THEN {_conf("0.38 + 0.07 * len(way)", 0.80)} ELSE {_conf("0.40 + 0.07 * len(way)", 0.82)} END AS confidence, way[:8] AS nodes FROM (
SELECT repo_id, 'decorator_chain' AS pattern, way FROM run WHERE i >= 2 AND len >= 4 UNION ALL SELECT repo_id, 'chain_of_responsibility', CASE WHEN i <= 1 THEN way ELSE way[2:] END FROM run WHERE CASE WHEN i <= 1 THEN len ELSE len - 1 END >= 5
UNION ALL SELECT repo_id, 'pipeline', CASE WHEN i >= 1 THEN way ELSE way[2:] END FROM run WHERE CASE WHEN i >= 1 THEN len ELSE len - 1 END >= 4))"""
_CIRCLES = f"mt AS (SELECT repo_id, 'mutual_recursion' AS pattern, scc AS hash, {_conf('0.70 + 0.04 * count(*)', 0.95)} AS confidence, list(node ORDER BY node)[:8] AS nodes FROM part GROUP BY repo_id, scc HAVING count(*) > 1)"
_LAYERS = f"""ow AS (SELECT DISTINCT repo_id, s_module AS a, t_module AS b FROM calls x WHERE s_module <> t_module AND NOT EXISTS (SELECT 1 FROM calls y WHERE y.repo_id = x.repo_id AND y.s_module = x.t_module AND y.t_module = x.s_module)),
ly AS (SELECT o.repo_id, 'layered_architecture' AS pattern, nodes[1] AS hash, {_conf("0.50 + 0.06 * pairs", 0.85)} AS confidence, nodes FROM (SELECT repo_id, count(*) AS pairs FROM ow GROUP BY 1 HAVING count(*) >= 3) o JOIN (SELECT repo_id FROM calls WHERE s_module <> t_module GROUP BY 1 HAVING count(DISTINCT s_module) >= 3) m ON m.repo_id = o.repo_id
JOIN (SELECT repo_id, list(hash ORDER BY hash)[:12] AS nodes FROM n WHERE (repo_id, module) IN (SELECT (repo_id, unnest([a, b])) FROM (SELECT * FROM ow QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY a, b) <= 3)) GROUP BY 1) q ON q.repo_id = o.repo_id)"""
_PATTERNS = f"{REACH}, {_DEG}, {_SHAPES}, {_MR}, {_RUNS}, {_CIRCLES}, {_LAYERS}, pt AS (SELECT * FROM (SELECT * FROM sh UNION ALL SELECT * FROM mp UNION ALL SELECT * FROM rn UNION ALL SELECT * FROM mt UNION ALL SELECT * FROM ly) WHERE confidence >= 0.5)"


@query(f"{_PATTERNS} SELECT * FROM pt")
def patterns(c):
    return Detector(c).every()


@query(f"""{_PATTERNS} SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY count DESC, list_position([{', '.join(f"'{k}'" for k in REGISTRY)}], pattern)) AS INTEGER) AS row_no, pattern, {'{'}{', '.join(f"'{k}': '{v}'" for k, v in REGISTRY.items())}{'}'}[pattern] AS display_name, count FROM (SELECT repo_id, pattern, count(*) AS count FROM pt GROUP BY ALL)""".replace("{'singleton'", "MAP {'singleton'"))
def pattern_summary(c):
    d = Detector(c)
    return d.summary(d.every())


@query(f", {_DEG}, {_RUNS} SELECT repo_id, head, len AS length, way[:9] AS members, (repo_id, head) IN (SELECT (repo_id, node) FROM circ) AS circle FROM run")
def chains(c):
    return graph.chains(c.calls.select("repo_id", C("caller_hash").alias("src"), C("callee_hash").alias("dst"))).withColumn("length", C("length").cast("long"))


@query("SELECT DISTINCT repo_id, s_module AS caller_module, t_module AS callee_module FROM calls a WHERE s_module <> t_module AND NOT EXISTS (SELECT 1 FROM calls b WHERE b.repo_id = a.repo_id AND b.s_module = a.t_module AND b.t_module = a.s_module)")
def one_way_modules(c):
    return one_way(c.call_rows)


# statistics

_CLEAN = ", ".join(f"CASE WHEN {x} IS NULL OR isnan(CAST({x} AS DOUBLE)) THEN 0 ELSE CAST({x} AS DOUBLE) END AS {x}" for x in statistics.FEATURES)
_MATRIX = f"mx AS (SELECT split_part(n.repo_id, '@', 1) AS project, {_CLEAN} FROM n JOIN nf ON nf.repo_id = n.repo_id AND nf.hash = n.hash)"
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM mx" for i, a in enumerate(statistics.FEATURES) for b in statistics.FEATURES[i + 1 :])


@query(f", {_MATRIX} {_CORR}")
def feature_correlations(c):
    return statistics.correlations(statistics.symbols(c))


@query(f", {_MATRIX} SELECT a, b, r, CAST(row_number() OVER (ORDER BY abs(r) DESC, a, b) AS INTEGER) AS row_no FROM ({_CORR}) WHERE abs(r) >= 0.3")
def redundant_features(c):
    return statistics.redundant(statistics.correlations(statistics.symbols(c)), 0.3)


_EFFECT = f"""ref AS (SELECT min(project) AS p FROM mx), long AS (UNPIVOT (SELECT project, {', '.join(statistics.FEATURES)} FROM mx) ON {', '.join(statistics.FEATURES)} INTO NAME feature VALUE v),
st AS (SELECT project, feature, avg(v) AS m, stddev_pop(v) AS s FROM long GROUP BY ALL), ef AS (SELECT a.project AS grp, a.feature, round(a.m, 4) AS mean, round(abs(a.m - b.m) / (b.s + 1e-9), 4) AS d FROM st a JOIN st b ON b.feature = a.feature AND b.project = (SELECT p FROM ref) WHERE a.project <> (SELECT p FROM ref))"""


def _effects(c: Catalog) -> DataFrame:
    df = statistics.symbols(c).withColumn("project", F.split("repo_id", "@")[0])
    return statistics.discriminability(df, "project", df.agg(F.min("project")).first()[0])


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    """The last digit depends on the order of addition."""
    return df.withColumns({k: F.round(k, n) for k, n in digits.items()})


@query(f", {_MATRIX}, {_EFFECT} SELECT grp, feature, round(mean, 3) AS mean, round(d, 3) AS d FROM ef")
def feature_effects(c):
    return _rounded(_effects(c), mean=3, d=3)


@query(f", {_MATRIX}, {_EFFECT} SELECT CAST(row_number() OVER (ORDER BY max(d) DESC, feature) AS INTEGER) AS row_no, feature, round(max(d), 3) AS max_d FROM ef GROUP BY feature")
def discriminating_features(c):
    return _rounded(statistics.discriminating(_effects(c)), max_d=3)


@query()
def feature_components(c):
    got = statistics.principal_components(statistics.symbols(c), 5)
    rows = [(i + 1, round(s, 6), round(t, 6), f) for i, (s, t, f) in enumerate(zip(got["explained"], got["cumulative"], got["top_features"]))]
    return c.spark.createDataFrame(rows, "component int, explained double, cumulative double, top_features array<string>")


@query()
def feature_projection(c):
    return statistics.projection(statistics.symbols(c), "pca")


def _pooled(c: Catalog) -> tuple[DataFrame, str]:
    df = keep(statistics.symbols(c).withColumn("project", F.split("repo_id", "@")[0]), "symbols")
    return df, df.agg(F.min("project")).first()[0]


@query()
def feature_importances(c):
    df, clean = _pooled(c)
    got = statistics.importances(statistics.pooled(df, "project", clean))
    return c.spark.createDataFrame([(i + 1, k, round(v, 6)) for i, (k, v) in enumerate(got["importances"].items())], "rank int, feature string, importance double")


@query(f""", v AS (SELECT nf.utility_score AS u, nf.transitive_callers AS t FROM n JOIN nf ON nf.repo_id = n.repo_id AND nf.hash = n.hash WHERE u IS NOT NULL AND t IS NOT NULL AND NOT isnan(u)),
r AS (SELECT rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2 AS a, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2 AS b FROM v) SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r""")
def rank_correlation(c):
    got = statistics.spearman(statistics.symbols(c), "utility_score", "transitive_callers")
    return got.select(F.round("rho", 6).alias("rho"), "n")


@query("""SELECT u, n1, n0 FROM (SELECT sum(CASE WHEN l = 1 THEN r END) - count(*) FILTER (l = 1) * (count(*) FILTER (l = 1) + 1) / 2 AS u, count(*) FILTER (l = 1) AS n1, count(*) FILTER (l = 0) AS n0 FROM (
SELECT l, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM (SELECT nf.authority_score AS v, CASE WHEN risk IN ('high', 'critical') THEN 1 ELSE 0 END AS l FROM n JOIN nf ON nf.repo_id = n.repo_id AND nf.hash = n.hash WHERE risk IS NOT NULL AND authority_score IS NOT NULL AND NOT isnan(authority_score))))""")
def rank_sums(c):
    risky = c.internal_nodes.where(C("risk").isNotNull()).select("repo_id", "hash", C("risk").isin("high", "critical").cast("int").alias("risky"))
    return statistics.mann_whitney(c.features.join(risky, ["repo_id", "hash"]), "authority_score", "risky").select("u", "n1", "n0")
