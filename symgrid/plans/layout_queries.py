"""Queries of drawings of the call graphs: places, measurements and what viewers make of them, with SQL to compare."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrid.operators import layout, perceptions
from symgrid.plans.registry import query
from symgrid.sources.catalog import Catalog
from symgrid.sources.tables import keep

C = F.col


def _members(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """Symbols with their module as group and a radius by their callers, and the distinct calls between them, loops left out."""
    # read many times below
    c.internal_nodes = keep(c.internal_nodes.select("repo_id", "hash", "module", "caller_count"), "drawn-nodes")
    nodes = c.internal_nodes.where(C("module").isNotNull())
    r = 4 + F.least(F.lit(8.0), F.sqrt(F.coalesce("caller_count", F.lit(0)).cast("double")))
    edges = c.edges_distinct.where(C("src") != C("dst")).select(C("repo_id").alias("scenario"), C("src").alias("source"), C("dst").alias("target"))
    return nodes.select(C("repo_id").alias("scenario"), C("hash").alias("id"), C("module").alias("grp"), F.round(r, 6).alias("r")), edges


def _drawn(c: Catalog) -> tuple[DataFrame, DataFrame]:
    members, edges = _members(c)
    return keep(layout.place(members), "places"), keep(edges, "drawn-edges")


_PLACED = f"""mem AS (SELECT repo_id AS scenario, hash AS id, module AS grp, round(4 + least(8.0, sqrt(CAST(coalesce(caller_count, 0) AS DOUBLE))), 6) AS r FROM n WHERE module IS NOT NULL),
gs AS (SELECT scenario, grp, count(*) AS k, row_number() OVER (PARTITION BY scenario ORDER BY grp) - 1 AS place FROM mem GROUP BY scenario, grp),
gw AS (SELECT scenario, count(*) AS groups, sum(sqrt(k)) * 48 / (2 * {math.pi!r}) AS spread FROM gs GROUP BY 1),
pl AS (SELECT m.scenario, id, m.grp, r, round(cos(2 * {math.pi!r} * place / groups) * spread + sqrt(j) * 24 * cos(j * {layout.GOLDEN!r}), 6) AS x, round(sin(2 * {math.pi!r} * place / groups) * spread + sqrt(j) * 24 * sin(j * {layout.GOLDEN!r}), 6) AS y FROM (
  SELECT *, row_number() OVER (PARTITION BY scenario, grp ORDER BY id) - 1 AS j FROM mem) m JOIN gs ON gs.scenario = m.scenario AND gs.grp = m.grp JOIN gw ON gw.scenario = m.scenario),
le AS (SELECT repo_id AS scenario, src AS source, dst AS target FROM ed WHERE src <> dst)"""


@query(f", {_PLACED} SELECT scenario, id, grp, r, round(x, 2) AS x, round(y, 2) AS y FROM pl")
def layout_places(c):
    # the last digit may depend on a library's cosine
    return layout.place(_members(c)[0]).withColumns({k: F.round(k, 2) for k in "xy"})


_FACTS = f"""{_PLACED}, sg AS (SELECT le.scenario, source, target, a.grp AS g1, b.grp AS g2, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, a.r AS r1, b.r AS r2, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS len, row_number() OVER (ORDER BY le.scenario, source, target) AS no FROM le JOIN pl a ON a.scenario = le.scenario AND a.id = source JOIN pl b ON b.scenario = le.scenario AND b.id = target),
lk AS (SELECT scenario, count(*) AS links FROM le GROUP BY 1), sz AS (SELECT scenario, count(*) AS k FROM pl GROUP BY 1),
np AS (SELECT a.scenario, a.grp = b.grp AS same, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, a.r + b.r AS rr FROM pl a JOIN pl b ON a.scenario = b.scenario AND a.id < b.id),
pairs AS (SELECT scenario, count(*) FILTER (d < rr) AS overlapping, count(*) AS n, coalesce(max(CASE WHEN d < rr THEN rr - d END), 0) AS deepest, coalesce(avg(CASE WHEN same THEN d END), 0) AS within, avg(CASE WHEN NOT same THEN d END) AS between_ FROM np GROUP BY 1),
md AS (SELECT scenario, grp, avg(x) AS cx, avg(y) AS cy FROM pl GROUP BY ALL), rd AS (SELECT pl.scenario, pl.grp, greatest(1, max(sqrt((x - cx) ** 2 + (y - cy) ** 2))) AS rad FROM pl JOIN md ON md.scenario = pl.scenario AND md.grp = pl.grp GROUP BY ALL),
sep AS (SELECT a.scenario, min(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) - ra.rad - rb.rad) AS clear, avg(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) - ra.rad - rb.rad) AS avg_clear, count(*) FILTER (sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) < ra.rad + rb.rad) AS overlapping FROM md a JOIN md b ON a.scenario = b.scenario AND a.grp < b.grp
  JOIN rd ra ON ra.scenario = a.scenario AND ra.grp = a.grp JOIN rd rb ON rb.scenario = b.scenario AND rb.grp = b.grp GROUP BY 1),
ow AS (SELECT pl.scenario, pl.id, pl.x, pl.y, (pl.x - md.cx) ** 2 + (pl.y - md.cy) ** 2 AS own FROM pl JOIN md ON md.scenario = pl.scenario AND md.grp = pl.grp),
integ AS (SELECT scenario, count(*) FILTER (ok) AS n FROM (SELECT ow.scenario, ow.id, bool_and((ow.x - md.cx) ** 2 + (ow.y - md.cy) ** 2 >= own * (1 - 1e-12)) AS ok FROM ow JOIN md ON md.scenario = ow.scenario GROUP BY ALL) GROUP BY 1),
vis AS (SELECT scenario, count(*) AS m, count(*) FILTER (len - r1 - r2 > 8) AS seen, sum(len - r1 - r2) AS gap, min(len - r1 - r2) AS least, avg(len) AS mean, stddev_pop(len) AS dev, count(*) FILTER (g1 <> g2) AS crossing, count(*) FILTER (g1 <> g2 AND len - r1 - r2 > 8) AS crossing_seen FROM sg GROUP BY 1),
big AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY r DESC, id) AS k FROM pl QUALIFY k <= 5),
prom AS (SELECT big.scenario, count(*) AS top, count(*) FILTER (NOT EXISTS (SELECT 1 FROM pl o WHERE o.scenario = big.scenario AND o.id <> big.id AND sqrt((o.x - big.x) ** 2 + (o.y - big.y) ** 2) < o.r + big.r)) AS clear FROM big GROUP BY 1),
dg AS (SELECT pl.scenario, pl.id, count(sg.no) AS d FROM pl LEFT JOIN sg ON sg.scenario = pl.scenario AND pl.id IN (sg.source, sg.target) GROUP BY ALL),
gi AS (SELECT scenario, avg(d) AS mean, max(d) AS top, coalesce(abs(sum((2 * (k - 1) - n + 1) * d) / (n * nullif(sum(d), 0))), 0) AS gini FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY d) AS k, count(*) OVER (PARTITION BY scenario) AS n FROM dg) GROUP BY scenario, n)
SELECT sz.scenario, k AS n_nodes, round(coalesce(seen / links, 1), 6) AS edge_visibility, round(coalesce(gap / links, 0), 3) AS avg_gap, round(coalesce(least, 0), 3) AS min_gap, round(overlapping_ / n, 8) AS node_overlap, round(deepest, 3) AS max_overlap, round(within, 3) AS within_distance, round(between_, 3) AS between_distance,
round(greatest(0, 1 - within / between_), 6) AS gestalt_cohesion, round(integ_n / k, 6) AS blob_integrity, round(clear, 3) AS module_separation, round(avg_clear, 3) AS avg_clearance, overlapping AS overlapping_groups, round(coalesce(mean, 0), 3) AS edge_length, round(coalesce(dev / mean, 0), 6) AS edge_length_cv,
coalesce(crossing, 0) AS cross_edge_count, round(coalesce(crossing_seen / nullif(crossing, 0), 1), 6) AS cross_edge_visibility, round(pc / pt, 6) AS prominent_visibility, round(gm, 6) AS degree_mean, gt AS degree_max, round(gini, 6) AS degree_gini
FROM sz LEFT JOIN lk ON lk.scenario = sz.scenario LEFT JOIN vis ON vis.scenario = sz.scenario LEFT JOIN (SELECT scenario AS s, overlapping AS overlapping_, n, deepest, within, between_ FROM pairs) p ON p.s = sz.scenario LEFT JOIN sep ON sep.scenario = sz.scenario
LEFT JOIN (SELECT scenario AS s, n AS integ_n FROM integ) i ON i.s = sz.scenario LEFT JOIN (SELECT scenario AS s, top AS pt, clear AS pc FROM prom) q ON q.s = sz.scenario LEFT JOIN (SELECT scenario AS s, mean AS gm, top AS gt, gini FROM gi) g ON g.s = sz.scenario"""
_COMPARED = {
    "n_nodes": None, "edge_visibility": 6, "avg_gap": 3, "min_gap": 3, "node_overlap": 8, "max_overlap": 3, "within_distance": 3, "between_distance": 3, "gestalt_cohesion": 6, "blob_integrity": 6,
    "module_separation": 3, "avg_clearance": 3, "overlapping_groups": None, "edge_length": 3, "edge_length_cv": 6, "cross_edge_count": None, "cross_edge_visibility": 6, "prominent_visibility": 6,
    "degree_mean": 6, "degree_max": None, "degree_gini": 6,
}


def _whole(c: str) -> F.Column:
    return C(c).cast("long").alias(c)


@query(f", {_FACTS}")
def layout_facts(c):
    found = layout.facts(*_drawn(c), only=[*_COMPARED])
    return found.select("scenario", *[_whole(k) if d is None else F.round(k, d).alias(k) for k, d in _COMPARED.items()])


_CROSS = f"""{_PLACED}, sg AS (SELECT le.scenario, source, target, a.x AS x1, a.y AS y1, b.x - a.x AS dx, b.y - a.y AS dy, row_number() OVER (ORDER BY le.scenario, source, target) AS no FROM le JOIN pl a ON a.scenario = le.scenario AND a.id = source JOIN pl b ON b.scenario = le.scenario AND b.id = target),
hit AS (SELECT p.scenario, count(*) AS k FROM sg p JOIN sg q ON q.scenario = p.scenario AND p.no < q.no AND p.source <> q.source AND p.source <> q.target AND p.target <> q.source AND p.target <> q.target AND abs(p.dx * q.dy - p.dy * q.dx) >= 1e-10
  AND ((q.x1 - p.x1) * q.dy - (q.y1 - p.y1) * q.dx) / (p.dx * q.dy - p.dy * q.dx) > 0.01 AND ((q.x1 - p.x1) * q.dy - (q.y1 - p.y1) * q.dx) / (p.dx * q.dy - p.dy * q.dx) < 0.99
  AND ((q.x1 - p.x1) * p.dy - (q.y1 - p.y1) * p.dx) / (p.dx * q.dy - p.dy * q.dx) > 0.01 AND ((q.x1 - p.x1) * p.dy - (q.y1 - p.y1) * p.dx) / (p.dx * q.dy - p.dy * q.dx) < 0.99 GROUP BY 1)
SELECT s.scenario, coalesce(k, 0) AS edge_crossing_count, round(coalesce(k, 0) / m, 6) AS edge_crossings FROM (SELECT scenario, count(*) AS m FROM sg GROUP BY 1) s LEFT JOIN hit ON hit.scenario = s.scenario"""


@query(f", {_CROSS}")
def layout_crossings(c):
    found = layout.facts(*_drawn(c), only=["edge_crossing_count", "edge_crossings", "degree_max"]).where(C("degree_max") > 0)
    return found.select("scenario", _whole("edge_crossing_count"), F.round("edge_crossings", 6).alias("edge_crossings"))


_LINKS = f"""{_PLACED}, g AS (SELECT scenario, id, grp, x, y, r FROM pl), md AS (SELECT scenario, grp, avg(x) AS cx, avg(y) AS cy FROM g GROUP BY ALL),
un AS (SELECT DISTINCT le.scenario, unnest([source, target]) AS v, unnest([target, source]) AS w FROM le JOIN g a ON a.scenario = le.scenario AND a.id = source JOIN g b ON b.scenario = le.scenario AND b.id = target),
hn AS (SELECT un.scenario, v, any_value(a.x) AS x, any_value(a.y) AS y, avg(b.x) AS mx, avg(b.y) AS my, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS far, count(*) AS k FROM un JOIN g a ON a.scenario = un.scenario AND a.id = v JOIN g b ON b.scenario = un.scenario AND b.id = w WHERE a.grp = b.grp GROUP BY un.scenario, v HAVING count(*) >= 3),
hub AS (SELECT scenario, count(*) AS hubs, avg(CASE WHEN far > 0 THEN sqrt((x - mx) ** 2 + (y - my) ** 2) / far ELSE 0 END) AS err FROM hn GROUP BY 1),
an AS (SELECT le.scenario, source AS v, atan2(b.y - a.y, b.x - a.x) AS t FROM le JOIN g a ON a.scenario = le.scenario AND a.id = source JOIN g b ON b.scenario = le.scenario AND b.id = target UNION ALL SELECT le.scenario, target, atan2(a.y - b.y, a.x - b.x) FROM le JOIN g a ON a.scenario = le.scenario AND a.id = source JOIN g b ON b.scenario = le.scenario AND b.id = target),
aw AS (SELECT scenario, v, degrees(coalesce(lead(t) OVER (PARTITION BY scenario, v ORDER BY t) - t, min(t) OVER (PARTITION BY scenario, v) - t + 2 * pi())) AS turn, count(*) OVER (PARTITION BY scenario, v) AS k FROM an),
am AS (SELECT scenario, min(least_) AS min_angle, avg(least_) AS avg_min_angle, count(*) FILTER (least_ < 15) AS poor FROM (SELECT scenario, v, min(turn) AS least_ FROM aw WHERE k > 1 GROUP BY ALL) GROUP BY 1),
co AS (SELECT le.scenario, least(a.grp, b.grp) AS p, greatest(a.grp, b.grp) AS q, count(*) AS w FROM le JOIN g a ON a.scenario = le.scenario AND a.id = source JOIN g b ON b.scenario = le.scenario AND b.id = target WHERE a.grp <> b.grp GROUP BY ALL),
cl AS (SELECT co.*, a.cx AS x1, a.cy AS y1, b.cx - a.cx AS dx, b.cy - a.cy AS dy, row_number() OVER (ORDER BY co.scenario, p, q) AS no FROM co JOIN md a ON a.scenario = co.scenario AND a.grp = p JOIN md b ON b.scenario = co.scenario AND b.grp = q),
cp AS (SELECT a.scenario, a.w + b.w AS w, ((b.x1 - a.x1) * b.dy - (b.y1 - a.y1) * b.dx) / nullif(a.dx * b.dy - a.dy * b.dx, 0) AS t, ((b.x1 - a.x1) * a.dy - (b.y1 - a.y1) * a.dx) / nullif(a.dx * b.dy - a.dy * b.dx, 0) AS u FROM cl a JOIN cl b ON b.scenario = a.scenario AND a.no < b.no AND a.p <> b.p AND a.p <> b.q AND a.q <> b.p AND a.q <> b.q),
cc AS (SELECT scenario, count(*) FILTER (t > 0.01 AND t < 0.99 AND u > 0.01 AND u < 0.99) AS k, coalesce(sum(CASE WHEN t > 0.01 AND t < 0.99 AND u > 0.01 AND u < 0.99 THEN w END), 0) / sum(w) AS ratio FROM cp GROUP BY 1),
rr AS (SELECT g.scenario, g.grp, greatest(20, max(sqrt((x - cx) ** 2 + (y - cy) ** 2) + r + 8)) AS rad FROM g JOIN md ON md.scenario = g.scenario AND md.grp = g.grp GROUP BY ALL),
bl AS (SELECT scenario, no, w, bool_or(grp NOT IN (p, q) AND t BETWEEN 0.15 AND 0.85 AND sqrt((cx - x1 - t * dx) ** 2 + (cy - y1 - t * dy) ** 2) < rad + 25) AS blocked FROM (SELECT cl.*, md.grp, md.cx, md.cy, rad, greatest(0, least(1, ((md.cx - x1) * dx + (md.cy - y1) * dy) / (dx * dx + dy * dy))) AS t FROM cl JOIN md ON md.scenario = cl.scenario JOIN rr ON rr.scenario = md.scenario AND rr.grp = md.grp) GROUP BY ALL),
br AS (SELECT scenario, count(*) FILTER (blocked) AS blocked, 1 - coalesce(sum(CASE WHEN blocked THEN w END), 0) / sum(w) AS ratio FROM bl GROUP BY 1)
SELECT s.scenario, coalesce(hubs, 0) AS hubs, round(coalesce(err, 0), 5) AS hub_centrality_error, round(coalesce(min_angle, 180), 4) AS min_angle, round(coalesce(avg_min_angle, 180), 4) AS avg_min_angle, coalesce(poor, 0) AS poor_angles, coalesce(k, 0) AS corridor_crossings, round(coalesce(cc.ratio, 0), 6) AS inter_module_crossings, coalesce(blocked, 0) AS blocked_corridors, round(coalesce(br.ratio, 1), 6) AS blob_edge_routing
FROM (SELECT DISTINCT scenario FROM g) s LEFT JOIN hub ON hub.scenario = s.scenario LEFT JOIN am ON am.scenario = s.scenario LEFT JOIN cc ON cc.scenario = s.scenario LEFT JOIN br ON br.scenario = s.scenario"""
_LINKED = {"hubs": None, "hub_centrality_error": 5, "min_angle": 4, "avg_min_angle": 4, "poor_angles": None, "corridor_crossings": None, "inter_module_crossings": 6, "blocked_corridors": None, "blob_edge_routing": 6}


@query(f", {_LINKS}")
def layout_links(c):
    found = layout.facts(*_drawn(c), only=[*_LINKED])
    return found.select("scenario", *[_whole(k) if d is None else F.round(k, d).alias(k) for k, d in _LINKED.items()])


@query(f""", {_PLACED}, un AS (SELECT DISTINCT le.scenario, unnest([source, target]) AS v, unnest([target, source]) AS w FROM le JOIN pl a ON a.scenario = le.scenario AND a.id = source JOIN pl b ON b.scenario = le.scenario AND b.id = target),
steps(scenario, s, node, d) USING KEY (scenario, s, node) AS (SELECT scenario, id, id, 0 FROM pl UNION SELECT x.scenario, x.s, un.w, min(x.d) + 1 FROM steps x JOIN un ON un.scenario = x.scenario AND un.v = x.node WHERE NOT EXISTS (SELECT 1 FROM recurring.steps r WHERE r.scenario = x.scenario AND r.s = x.s AND r.node = un.w) GROUP BY x.scenario, x.s, un.w),
st AS (SELECT a.scenario, a.grp = b.grp AS within, ((sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) - d * 120) / (d * 120)) ** 2 AS e FROM steps JOIN pl a ON a.scenario = steps.scenario AND a.id = s JOIN pl b ON b.scenario = steps.scenario AND b.id = node WHERE d > 0 AND s < node)
SELECT s.scenario, round(coalesce(all_, 0), 5) AS global_stress, round(coalesce(own, 0), 5) AS layout_stress FROM (SELECT DISTINCT scenario FROM pl) s LEFT JOIN (SELECT scenario, avg(e) AS all_, avg(CASE WHEN within THEN e END) AS own FROM st GROUP BY 1) t ON t.scenario = s.scenario""")
def layout_stress(c):
    wanted = ["global_stress", "layout_stress"]
    return layout.facts(*_drawn(c), only=wanted).select("scenario", *[F.round(k, 5).alias(k) for k in wanted])


@query()
def layout_orders(c):
    members, edges = _members(c)
    return layout.circular_orders(members.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)}), edges)


@query()
def layout_perceptions(c):
    return perceptions.perceptions(layout.facts(*_drawn(c), only=perceptions.NEEDED))
