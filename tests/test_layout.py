"""Measurements of drawings against plain loops, and what is made of them."""

from __future__ import annotations

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgrid.operators import layout as L
from symgrid.operators import perceptions as P


def _random(seed: int, n: int = 40, m: int = 70):
    rng = random.Random(seed)
    ids = [f"{i:02d}" for i in range(n)]
    groups = [rng.choice(["a", "b", "c", "d", None]) for _ in ids]
    at = [(rng.uniform(-200, 200), rng.uniform(-200, 200)) for _ in ids]
    r = [rng.uniform(4, 22) for _ in ids]
    links = [(rng.choice(ids), rng.choice(ids)) for _ in range(m)] + [("00", "gone")]
    return ids, groups, at, r, links


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_against_loops(seed, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 7)
    ids, groups, at, r, links = _random(seed)
    d = L.Drawing(ids, groups, np.array(at), np.array(r), links)
    far = lambda i, j: math.dist(at[i], at[j])
    n = len(ids)
    over = [(i, j) for i in range(n) for j in range(i + 1, n) if far(i, j) < r[i] + r[j]]
    assert d.node_overlap()["count"] == len(over)
    within = [far(i, j) for i in range(n) for j in range(i + 1, n) if groups[i] and groups[i] == groups[j]]
    between = [far(i, j) for i in range(n) for j in range(i + 1, n) if not (groups[i] and groups[i] == groups[j])]
    assert d.gestalt_proximity()["ratio"] == pytest.approx(np.mean(within) / np.mean(between))
    ends = [(int(a), int(b)) for a, b in links if b != "gone"]

    def hit(p, q):
        (a, b), (c, e) = p, q
        if {a, b} & {c, e}:
            return False
        m = np.array([np.subtract(at[b], at[a]), np.subtract(at[c], at[e])]).T
        if abs(np.linalg.det(m)) < 1e-10:
            return False
        return all(0.01 < t < 0.99 for t in np.linalg.solve(m, np.subtract(at[c], at[a])))

    assert d.edge_crossings()["count"] == sum(hit(p, q) for p, q in itertools.combinations(ends, 2))
    near = {i: set() for i in range(n)}
    for a, b in ends:
        near[a].add(b)
        near[b].add(a)
    stress, pairs = 0.0, 0
    for i in range(n):
        steps, front = {i: 0}, [i]
        while front:
            front = [w for v in front for w in near[v] if w not in steps and not steps.update({w: steps[v] + 1})]
        for j in range(i + 1, n):
            if steps.get(j):
                stress += ((far(i, j) - steps[j] * 120) / (steps[j] * 120)) ** 2
                pairs += 1
    assert d.layout_stress()["per_edge"] == pytest.approx(stress / pairs)
    gaps = [far(a, b) - r[a] - r[b] for a, b in ends]
    assert d.edge_visibility() == pytest.approx({"ratio": sum(g > 8 for g in gaps) / len(links), "avg_gap": sum(gaps) / len(links), "min_gap": min(gaps)})


def test_shapes_and_empty_drawings():
    line = L.Drawing(list("abcd"), ["m"] * 4, np.array([[0, 0], [120, 0], [240, 0], [360, 1]]), np.full(4, 6.0), [("a", "b"), ("b", "c"), ("c", "d")])
    f = line.facts()
    assert f["chains"] == 1 and f["chain_straightness"] == 1 and f["chain_elongation"] == 10 and f["edge_crossing_count"] == 0
    assert f["layout_stress"] == pytest.approx(0, abs=1e-4) and f["quality_score"] == 100.0 and f["module_separation"] is None
    assert line.chains == [[0, 1, 2, 3]]
    star = L.Drawing(list("hxyz"), ["m"] * 4, np.array([[0, 0], [100, 0], [-50, 86.6], [-50, -86.6]]), np.full(4, 6.0), [("h", x) for x in "xyz"])
    assert star.hub_centrality() == {"hubs": 1, "avg_normalised": pytest.approx(0, abs=1e-3)}
    assert star.angular_resolution()["min_angle"] == pytest.approx(120, abs=0.1)
    none = L.Drawing([], [], np.zeros((0, 2)), np.zeros(0), []).facts()
    assert none["n_nodes"] == 0 and none["edge_visibility"] == 1.0
    cross = L.Drawing(list("abcd"), list("wxyz"), np.array([[0, 0], [10, 10], [0, 10], [10, 0]]), np.full(4, 1.0), [("a", "b"), ("c", "d")])
    assert cross.edge_crossings()["count"] == 1 and cross.corridor_crossings()["weighted_ratio"] == 1.0


def test_a_line_past_a_third_group_is_blocked():
    at = np.array([[0, 0], [500, 0], [250, 10], [250, 400]])
    blocked = L.Drawing(list("abcd"), ["a", "b", "c", "d"], at, np.full(4, 6.0), [("a", "b"), ("a", "d")])
    assert blocked.edge_routing() == {"ratio": 0.5, "violating": 1, "pairs": 2}


def test_circular_order_is_best_for_few_groups_and_improves_many():
    def cost(order, weights):
        at = {g: i for i, g in enumerate(order)}
        total = 0
        for (p, v), (q, w) in itertools.combinations(weights.items(), 2):
            if not set(p) & set(q):
                lo, hi = sorted((at[p[0]], at[p[1]]))
                total += (v + w) * ((lo < at[q[0]] < hi) != (lo < at[q[1]] < hi))
        return total

    rng = random.Random(3)
    for n in (6, 14):
        groups = [f"g{i:02d}" for i in range(n)]
        weights = {p: rng.randint(1, 5) for p in itertools.combinations(groups, 2) if rng.random() < 0.4}
        order = L.circular_order(groups, weights)
        assert sorted(order) == groups and order[0] == groups[0] and cost(order, weights) <= cost(groups, weights)
        if n == 6:
            assert cost(order, weights) == min(cost([groups[0], *p], weights) for p in itertools.permutations(groups[1:]))
        else:  # no swap of neighbours helps any more
            for i in range(1, n - 1):
                other = [*order]
                other[i], other[i + 1] = other[i + 1], other[i]
                assert cost(other, weights) >= cost(order, weights)
    assert L.circular_order(["x"], {}) == ["x"]


def test_hulls():
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert sorted(L.convex_hull([*square, (1.0, 1.0), (1.0, 0.0)])) == sorted(square)
    assert L.inside(1, 1, square) and not L.inside(3, 1, square) and L.inside(5, 0, [(0.0, 0.0)]) and not L.inside(0, 0, [])
    assert L.expand([(0.0, 0.0), (2.0, 0.0)], 1) == [(-1.0, 0.0), (3.0, 0.0)]


def test_scenarios_in_tasks_and_perceptions(spark, tmp_path):
    rows, edges = [], []
    for s in range(3):
        ids, groups, at, r, links = _random(s)
        rows += [(f"s{s}", i, g, *p, x) for i, g, p, x in zip(ids, groups, at, r)]
        edges += [(f"s{s}", *e) for e in links]
    rows += [("alone", "x", None, 0.0, 0.0, None), ("alone", "nowhere", "g", None, None, 1.0), (None, "x", "g", 0.0, 0.0, 1.0)]
    nodes = spark.createDataFrame(rows, "scenario string, id string, grp string, x double, y double, r double").withColumn("score", F.lit(1))
    facts = L.facts(nodes, spark.createDataFrame(edges, "scenario string, source string, target string")).cache()
    got = {r.scenario: r for r in facts.collect()}
    assert got.keys() == {"s0", "s1", "s2", "alone"} and got["alone"].n_nodes == 1
    ids, groups, at, r, links = _random(1)
    want = L.Drawing(ids, groups, np.array(at), np.array(r), links).facts()
    assert got["s1"].quality_score == want["quality_score"] and got["s1"].degrees == want["degrees"]
    p = {r.scenario: r.asDict() for r in P.perceptions(facts).collect()}
    assert len(p["s0"]) == 1 + 54
    s = p["s1"]
    assert s["readability"] == pytest.approx(s["edge_visibility"] * (1 - s["node_overlap"]) * (1 - s["edge_crossings"]))
    assert 0 <= s["layout_conformance"] <= 1 and s["violation_count"] == round(s["violation_count"])
    assert (s["required_silhouette"] == math.inf) == (0.5 / (s["blob_integrity"] * (1 - s["cross_edge_ratio"]) / 2) - 1 > 1)
    judged = P.judge(P.perceptions(facts), [("v", None, "module_count >= 1"), ("v", "module_count >= 3", "blob_integrity > 1"), ("w", None, "edge_visibility >= 0")])
    by = {(r.scenario, r.viewer): (r.satisfied, r.score, r.violations) for r in judged.collect()}
    assert by["s1", "v"] == (False, 0.5, ["module_count >= 3 => blob_integrity > 1"]) and by["alone", "v"][0] and by["s1", "w"] == (True, 1.0, [])
    assert {r.viewer: r.satisfied for r in P.averages(judged).collect()} == {"v": 1, "w": 4}
    assert L.facts(nodes.limit(0), spark.createDataFrame([], "scenario string, source string, target string")).count() == 0


def test_recorded_facts_are_read(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"moduleCount": 2, "nodeList": [{"x": 1, "y": 2, "g": "m"}], "edgeVisibility": {"ratio": 0.5}, "chainNodePos": [[{"x": 0, "y": 0}]], "degreeDist": {"values": [1, 2], "mean": 1.5, "max": 2, "gini": 0.1}, "blobSeparation": {"minClearance": None}}))
    r = L.read_facts(spark, str(tmp_path)).first()
    assert (r.scenario, r.module_count, r.edge_visibility, r.n_nodes, r.degrees, r.module_separation) == ("one", 2, 0.5, 1, [1, 2], None)
    assert P.raw(L.read_facts(spark, str(tmp_path))).first().module_separation == 0.0


def test_silhouette_and_clusters():
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(m, 0.3, size=(12, 2)) for m in ((0, 0), (9, 0), (0, 9))])
    groups = np.repeat(["a", "b", "c"], 12)
    assert P.silhouette(points, groups, block=5) == pytest.approx(P.silhouette(points, groups)) and P.silhouette(points, groups) > 0.9
    assert P.rand_index(groups, P.k_means(points, 3)) == 1.0
    assert P.rand_index(np.array(list("aabb")), np.array(list("abab"))) == pytest.approx(-0.5)
    assert P.entropy([1, 1, 1]) == 0.0 and P.angle_entropy([3.0]) == 1.0


@pytest.mark.parametrize("block", [7, 192])
def test_crossings_where_sides_are_hard_to_tell(block, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", block)
    rng = np.random.default_rng(5)
    for scale in (1e-6, 1.0, 7e3):
        # places on a coarse grid: collinear, parallel, touching, repeated and reversed segments, some without length
        at = rng.integers(0, 6, (60, 2)) * scale
        ends = rng.integers(0, 60, (150, 2))
        ends = np.concatenate([ends, ends[:20, ::-1], ends[:9]])
        a, b, w = at[ends[:, 0]], at[ends[:, 1]], rng.integers(1, 9, len(ends))
        hits = [(i, j) for i, j in itertools.combinations(range(len(ends)), 2) if not set(ends[i]) & set(ends[j]) and L.crosses(a[i], b[i], a[j], b[j])]
        assert L.count_crossings(a, b, ends, w) == (len(hits), sum(int(w[i] + w[j]) for i, j in hits))
    # the hundredth at an end doesn't count, what is just within does
    p = lambda t: (np.array([[0.0, 0.0], [t, -50.0]]), np.array([[100.0, 0.0], [t, 50.0]]), np.array([[0, 1], [2, 3]]))
    assert [L.count_crossings(*p(t))[0] for t in (0.9999, 1.0001, 50.0, 98.9999, 99.0001)] == [0, 1, 1, 1, 0]


def test_only_what_is_asked_for_is_measured(spark, monkeypatch):
    d = L.Drawing(*_random(1)[:2], np.array(_random(1)[2]), np.array(_random(1)[3]), _random(1)[4])
    every = d.facts()
    for k in L.FACTS:
        assert d.facts(only=[k]) == {k: every[k]}

    def fail(*_):
        raise AssertionError

    for x in ("layout_stress", "gestalt_proximity", "node_overlap", "hub_centrality", "edge_routing"):
        monkeypatch.setattr(L.Drawing, x, fail)
    assert L.Drawing(*_random(1)[:2], np.array(_random(1)[2]), np.array(_random(1)[3]), _random(1)[4]).facts(only=["edge_crossing_count"]) == {"edge_crossing_count": every["edge_crossing_count"]}
    # scenarios stay spread over tasks however few bytes they have
    nodes = spark.createDataFrame([(f"s{i}", "x", "g", 0.0, 0.0, 1.0) for i in range(40)], "scenario string, id string, grp string, x double, y double, r double")
    found = L.facts(nodes, spark.createDataFrame([], "scenario string, source string, target string"), only=["n_nodes"])
    assert found.columns == ["scenario", "n_nodes"] and found.select(F.spark_partition_id()).distinct().count() > 4


def test_steps_of_long_ways_parts_and_repeated_edges(spark):
    # a line of 600 nodes, more than a block of sources and than a byte holds, and a part of its own
    n = 600
    ids = [f"{i:03d}" for i in range(n + 3)]
    links = [(ids[i + (i % 2)], ids[i + 1 - (i % 2)]) for i in range(n - 1)] + [(ids[0], ids[1]), (ids[n], ids[n + 1]), (ids[n + 1], ids[n]), (ids[5], ids[5])]
    at = np.random.default_rng(2).uniform(0, 900, (n + 3, 2))
    d = L.Drawing(ids, ["g" if i % 3 else None for i in range(n + 3)], at, np.full(n + 3, 5.0), links)
    steps = np.concatenate([d._steps(0, 512), d._steps(512, n + 3)], 1)
    want = np.abs(np.subtract.outer(np.arange(n + 3), np.arange(n + 3)))
    want[n:, :n] = want[:n, n:] = want[n + 2] = want[:, n + 2] = 0
    assert (steps == want).all()
    i, j = np.nonzero(np.triu(want))
    off = (np.hypot(*(at[i] - at[j]).T) / (want[i, j] * 120) - 1) ** 2
    same = np.array([a == b for a, b in zip(d.group[i], d.group[j])])
    assert d.layout_stress()["per_edge"] == pytest.approx(off.mean()) and d.layout_stress(within=True)["per_edge"] == pytest.approx(off[same].mean())


def test_pairs_of_nodes_are_read_once_in_blocks(monkeypatch):
    ids, groups, at, r, links = _random(4)
    want = L.Drawing(ids, groups, np.array(at), np.array(r), links).facts()
    sizes = []
    far = L.Drawing._far
    monkeypatch.setattr(L, "BLOCK", 7)
    monkeypatch.setattr(L.Drawing, "_far", lambda self, i, j: (x := far(self, i, j), sizes.append(x.size))[0])
    got = L.Drawing(ids, groups, np.array(at), np.array(r), links).facts(only=["node_overlap", "max_overlap", "within_distance", "between_distance", "gestalt_cohesion", "blob_integrity"])
    assert got == pytest.approx({k: want[k] for k in got})
    assert sum(sizes) < 0.7 * len(ids) ** 2 and max(sizes) <= 49


def test_hubs_angles_and_corridors_against_loops(monkeypatch):
    ids, groups, at, r, links = _random(6, 50, 160)
    links += [(ids[3], ids[3]), (ids[4], ids[5]), (ids[5], ids[4])]
    at = np.array(at).round(-1)  # places on a grid: equal angles, equal places
    monkeypatch.setattr(L, "BLOCK", 7)
    d = L.Drawing(ids, groups, at, np.array(r), links)
    # no Python list of a node's neighbours: a drawing may have many
    monkeypatch.setattr(L.Drawing, "neighbours", property(lambda _: pytest.fail("read")))
    ends = [(int(a), int(b)) for a, b in links if b != "gone"]
    near, turns = {i: set() for i in range(50)}, {i: [] for i in range(50)}
    for a, b in ends:
        near[a].add(b)
        near[b].add(a)
        dx, dy = at[b] - at[a]
        turns[a].append(math.atan2(dy, dx))
        turns[b].append(math.atan2(-dy, -dx))
    errors = []
    for v, ws in near.items():
        own = [w for w in ws if groups[w] == groups[v]]
        if len(own) >= 3:
            far = np.mean([math.dist(at[w], at[v]) for w in own])
            errors.append(math.dist(at[own].mean(0), at[v]) / far if far else 0.0)
    assert d.hub_centrality() == {"hubs": len(errors), "avg_normalised": pytest.approx(np.mean(errors))}
    least = [math.degrees(min(np.diff(sorted(x)).tolist() + [min(x) - max(x) + 2 * math.pi])) for x in turns.values() if len(x) > 1]
    assert d.angular_resolution() == {"min_angle": pytest.approx(min(least)), "avg_min_angle": pytest.approx(np.mean(least)), "poor": sum(x < 15 for x in least)}
    pairs, w = d.corridors
    apart = [(i, j) for i, j in itertools.combinations(range(len(pairs)), 2) if not set(pairs[i]) & set(pairs[j])]
    hits = [(i, j) for i, j in apart if L.crosses(*d.middles[[*pairs[i], *pairs[j]]])]
    weight = lambda some: sum(int(w[i] + w[j]) for i, j in some)
    assert d.corridor_crossings() == {"crossing": len(hits), "pairs": len(apart), "ratio": len(hits) / len(apart), "weighted_ratio": weight(hits) / weight(apart)}


def test_clusters_are_those_of_comparing_all_middles_each_time():
    def plain(points, k, starts=10, seed=42):
        rng, best, least = np.random.default_rng(seed), None, np.inf
        for _ in range(starts):
            middle = points[rng.integers(len(points))][None]
            while len(middle) < k:
                d = ((points[:, None] - middle[None]) ** 2).sum(2).min(1)
                middle = np.vstack([middle, points[rng.choice(len(points), p=d / d.sum() if d.sum() else None)]])
            for _ in range(300):
                own = ((points[:, None] - middle[None]) ** 2).sum(2).argmin(1)
                new = np.array([points[own == i].mean(0) if (own == i).any() else middle[i] for i in range(k)])
                if np.allclose(new, middle):
                    break
                middle = new
            cost = ((points - middle[own]) ** 2).sum()
            if cost < least:
                best, least = own, cost
        return best

    rng = np.random.default_rng(8)
    for n, k in ((400, 23), (150, 2), (30, 1), (12, 12)):
        points = rng.normal(size=(n, 2)) * [90, 30] + rng.integers(0, 5, (n, 1)) * 150
        assert (P.k_means(points, k) == plain(points, k)).all()
    assert len(P.k_means(np.ones((9, 2)), 3)) == 9


def test_a_drawing_is_measured_once_for_its_readings(spark, tmp_path):
    ids, groups, at, r, links = _random(2)
    nodes = spark.createDataFrame([(f"s{s}", i, g, *p, x) for s in range(3) for i, g, p, x in zip(ids, groups, at, r)], "scenario string, id string, grp string, x double, y double, r double")
    edges = spark.createDataFrame([(f"s{s}", *e) for s in range(3) for e in links], "scenario string, source string, target string")

    def counted(batches):
        for b in batches:
            for s in b.column(0).to_pylist():
                with open(tmp_path / s, "a") as f:
                    f.write("x")
            yield b

    facts = L.facts(nodes, edges, only=P.NEEDED)
    found = P.perceptions(facts.mapInArrow(counted, facts.schema)).collect()
    assert [len((tmp_path / r.scenario).read_text()) for r in found] == [1, 1, 1]
    every = {r.scenario: r for r in P.perceptions(L.facts(nodes, edges)).collect()}
    assert {r.scenario: r for r in found} == every
