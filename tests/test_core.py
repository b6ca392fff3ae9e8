"""The core operators against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from symgrid.operators import frequency, graph, hierarchy, orphans, snapdiff
from symgrid.operators.components import components

T0 = dt.datetime(2025, 1, 1)
at = lambda h: T0 + dt.timedelta(hours=h)
TIME = "timestamp_ntz"


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_profile_of_heavy_and_null_keys(spark):
    data = [("a", "x")] * 6 + [("a", "y")] * 6 + [("a", None), ("b", None), (None, "x"), ("", "z")]
    df = spark.createDataFrame(data, "key string, value string").withColumn("n", F.lit(1))
    got = rows(frequency.profile(frequency.compress(df, "key", "value")))
    assert got == sorted([("a", 13, 2, "x", 6), ("b", 1, 0, None, None), ("", 1, 1, "z", 1)], key=repr)
    assert rows(frequency.heavy_keys(df, "key", "value", 0.5).select("key")) == [("a",)]
    assert rows(frequency.profile(frequency.compress(df.limit(0), "key", "value"))) == []


def test_weighted_percentiles(spark):
    rng = random.Random(1)
    data = [(rng.choice("abc"), rng.choice([None, 0, -5, 3, 3, 7, 1000000, rng.randint(-50, 50)])) for _ in range(400)]
    df = spark.createDataFrame(data, "k string, v int")
    by = defaultdict(list)
    for k, v in data:
        if v is not None:
            by[k].append(v)

    def q(x, p):
        x = sorted(x)
        i = p * (len(x) - 1)
        lo = int(i)
        return x[lo] + (x[min(lo + 1, len(x) - 1)] - x[lo]) * (i - lo)

    for in_task in (500_000, 2):  # with and without bands that are split
        got = {r.key: (r.n, r.p_50, r.p_90) for r in frequency.percentiles(frequency.compress(df, "k", "v"), [0.5, 0.9], in_task).collect()}
        for k, x in by.items():
            assert got[k][0] == len(x) and got[k][1] == pytest.approx(q(x, 0.5)) and got[k][2] == pytest.approx(q(x, 0.9))


def test_orphans(spark, monkeypatch):
    nodes = spark.createDataFrame([("r", "a", at(0)), ("r", "late", at(9)), ("q", "b", at(0)), ("r", "a", at(0))], f"repo_id string, hash string, loaded_at {TIME}")
    snaps = spark.createDataFrame([("r", at(5)), ("q", at(5))], f"repo_id string, closed_at {TIME}")
    edges = spark.createDataFrame([("r", "a", "b")] * 50 + [("r", "late", "a"), ("r", None, ""), (None, "a", "a"), ("q", "b", "ext:x"), ("none", "b", "b")], "repo_id string, caller_hash string, callee_hash string")
    inh = spark.createDataFrame([("r", "gone"), ("r", "unresolved:X"), ("r", "b"), ("q", None)], "repo_id string, parent_hash string")
    want = sorted([("edges", "callee_hash", "r", "b", 50), ("edges", "caller_hash", "r", "late", 1), ("edges", "caller_hash", None, "a", 1), ("edges", "callee_hash", None, "a", 1), ("edges", "callee_hash", "q", "ext:x", 1), ("edges", "caller_hash", "none", "b", 1), ("edges", "callee_hash", "none", "b", 1), ("inheritance", "parent_hash", "r", "gone", 1), ("inheritance", "parent_hash", "r", "b", 1)], key=repr)
    for heavy in (4096, 10):  # with and without heavy references
        monkeypatch.setattr(orphans, "HEAVY", heavy)
        assert rows(orphans.orphans(edges, inh, nodes, snaps)) == want
    assert rows(orphans.orphans(edges.limit(0), inh.limit(0), nodes.limit(0), snaps.limit(0))) == []


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, None)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = rows(components(spark.createDataFrame(links, "a int, b int"), "a", "b"))
    assert got == sorted([(x, find(x)) for x in up], key=repr)


def test_components_alike_in_one_task_and_by_stars(spark):
    rng = random.Random(12)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, i) for i in range(5001, 5100)]
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    assert rows(components(df, "a", "b", one_task=0)) == rows(components(df, "a", "b"))
    assert rows(components(df.limit(0), "a", "b", one_task=0)) == rows(components(df.limit(0), "a", "b")) == []


def test_a_long_chain_is_walked_without_copies_of_its_path():
    from symgrid.operators.hierarchy import Walk

    n = 100_000
    w = Walk([-1, *range(n - 1)], [str(i) for i in range(n)])
    assert w.level == list(range(n)) and w.below[0] == n - 1 and w.order == list(range(n))
    at, row = next(r for r in w.rows(["hash", "path"]) if r[0] == 3)
    assert row == ("3", ["0", "1", "2", "3"])


def _brute(parent):
    out = {}
    for n in {*parent, *[p for p in parent.values() if p]}:
        way, x = [n], n
        while parent.get(x) and parent[x] not in way:
            x = parent[x]
            way.append(x)
        back = parent.get(x)
        out[n] = (x, len(way) - 1) if not back else ("", -1) if back == n or _on(parent, n) else ("", -2)
    return out


def _on(parent, n):
    x = parent.get(n)
    seen = set()
    while x and x not in seen:
        if x == n:
            return True
        seen.add(x)
        x = parent.get(x)
    return False


@pytest.mark.parametrize("largest", [100_000, 3])
def test_hierarchies(spark, largest):
    rng = random.Random(3)
    data, want = [], []
    for repo in ("r", "s", None):
        parent = {f"n{i}": rng.choice([None, "", "unresolved:q", f"n{rng.randint(0, 40)}", f"n{rng.randint(0, i)}"]) for i in range(30)}
        parent |= {f"d{i}": f"d{i + 1}" for i in range(20)} | {"self": "self"}
        data += [(repo, c, p, at(1)) for c, p in parent.items()] + [(repo, "n3", "old", at(0)), (repo, "n4", parent["n4"], at(1)), (repo, None, "n1", at(1))]
        clean = {c: p if p and not p.startswith("unresolved:") else None for c, p in parent.items()}
        want += [(repo, n, *v) for n, v in _brute(clean).items()]
    if largest == 3:
        data, want = [x for x in data if x[0] is not None], [x for x in want if x[0] is not None]
    df = spark.createDataFrame(data, f"repo_id string, child_hash string, parent_hash string, loaded_at {TIME}").withColumn("depth", F.lit(1))
    found = hierarchy.hierarchies(df, largest)
    assert rows(found.select("repo_id", "hash", "root_hash", "depth")) == sorted(want, key=repr)
    below = Counter((r.repo_id, a) for r in found.collect() if r.path for a in r.path[:-1])
    for r in found.where("depth >= 0").collect():
        assert r.n_descendants == below[r.repo_id, r.hash] and r.path[0] == r.root_hash and len(r.path) == r.depth + 1
    assert rows(hierarchy.hierarchies(df.limit(0))) == []


def test_large_hierarchies_with_long_tails_on_circles(spark):
    data = []
    for repo in ("r", None):
        parent = {"a": "b", "b": "a", "t0": "a", "self": "self", "s": "self", "top": None, "x": "top", "y": "gone", "z": "y"}
        parent |= {f"t{i}": f"t{i - 1}" for i in range(1, 10)} | {f"u{i}": f"t{i}" for i in range(3)}
        data += [(repo, c, p, at(1)) for c, p in parent.items()]
    df = spark.createDataFrame(data, f"repo_id string, child_hash string, parent_hash string, loaded_at {TIME}")
    large = hierarchy.hierarchies(df, 1)
    assert rows(large) == rows(hierarchy.hierarchies(df))
    got = {(r.repo_id, r.hash): (r.depth, r.n_descendants) for r in large.collect()}
    for repo in ("r", None):
        assert {h for (q, h), v in got.items() if q == repo and v[0] == -1} == {"a", "b", "self"}
        circle = {h: (r, c) for q, h, r, c in large.where("circle IS NOT NULL").select("repo_id", "hash", "circle", "closes").collect() if q == repo}
        assert circle["t9"] == ("a", False) and circle["a"] == ("a", True) and circle["b"] == ("a", False) and circle["s"] == ("self", False) and circle["self"] == ("self", True)
        assert got[repo, "t9"] == (-2, 0) and got[repo, "t0"] == (-2, 12) and got[repo, "b"] == (-1, 15) and got[repo, "gone"] == (0, 2)


@pytest.mark.parametrize("largest", [100_000, 1])
def test_descendants_on_and_below_circles(spark, largest):
    rng = random.Random(7)
    data, want = [], []
    for repo in ("r", None):
        parent = {f"c{i}": f"c{(i + 1) % 5}" for i in range(5)} | {"self": "self", "s": "self", "top": None, "q": "unresolved:x"}
        parent |= {f"n{i}": rng.choice(["c0", "c3", "s", "top", "gone", f"n{rng.randint(0, 19)}"]) for i in range(20)}
        data += [(repo, c, p, at(1)) for c, p in parent.items()]
        for node in parent:
            seen, x = {}, node
            while (x := parent.get(x)) and not x.startswith("unresolved:") and x not in seen:
                seen[x] = len(seen) + 1
            want += [(repo, a, node, d) for a, d in seen.items()]
    df = spark.createDataFrame(data, f"repo_id string, child_hash string, parent_hash string, loaded_at {TIME}")
    assert rows(hierarchy.descendants(df, largest)) == sorted(want, key=repr)
    below = Counter((repo, a) for repo, a, *_ in want)
    for r in hierarchy.hierarchies(df, largest).collect():
        assert r.n_descendants == below[r.repo_id, r.hash]
        assert r.depth != -2 or (r.path[0] in {"c0", "c1", "c2", "c3", "c4", "self"} or r.path[0].startswith("n")) and r.path[-1] == r.hash
    assert rows(hierarchy.descendants(df.limit(0), largest)) == []


def test_snapshot_changes(spark, monkeypatch):
    monkeypatch.setattr(snapdiff, "CHUNK_KEYS", 4)
    rng = random.Random(4)
    exports = [(p, f"{p}@{i}", "complete" if i != 2 else "failed", at(10 - i if p == "p" else i)) for p in ("p", "q") for i in range(4)]
    ex = spark.createDataFrame(exports, f"project string, repo_id string, export_state string, exported_at {TIME}")
    state, tables, data = {f"k{i}": "0" for i in range(200)}, {}, []
    for p in ("p", "q"):
        for _, repo, *_ in sorted([e for e in exports if e[0] == p], key=lambda e: e[3]):
            state = {k: rng.choice([None, "1"]) if rng.random() < 0.03 else v for k, v in state.items() if rng.random() > 0.03} | {f"n{rng.randint(0, 999)}": "x"}
            tables[repo] = dict(state)
            data += [("node", repo, k, "m", v) for k, v in state.items()]
    want = []
    for p in ("p", "q"):
        order = [e[1] for e in sorted([e for e in exports if e[0] == p and e[2] == "complete"], key=lambda e: e[3])]
        for old, new in zip(order, order[1:]):
            a, b = tables[old], tables[new]
            want += [("node", new, k, "m", "removed" if k not in b else "added" if k not in a else "changed") for k in {*a, *b} if k not in a or k not in b or a[k] != b[k]]
    df = spark.createDataFrame(data, "entity string, repo_id string, key_1 string, key_2 string, value string")
    assert rows(snapdiff.changes(df, snapdiff.complete_exports(ex))) == sorted(want, key=repr)
    assert rows(snapdiff.changes(df.limit(0), snapdiff.complete_exports(ex))) == []


def test_entries_take_the_latest_row(spark):
    nodes = spark.createDataFrame([("r", "m", "f", "x:1", at(0)), ("r", "m", "f", "y:2", at(1)), ("r", "m", "f", "z:3", at(1)), ("r", None, "f", "a", at(1)), ("r", "m", "e", "ext:a:b", at(1))], f"repo_id string, module string, name string, hash string, loaded_at {TIME}")
    assert rows(snapdiff.node_entries(nodes).select("key_2", "value")) == [("e", "ext:a:b"), ("f", "3")]


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(5)
    e = {(r, f"{rng.randint(0, 24):02d}", f"{rng.randint(0, 24):02d}") for r in "ab" for _ in range(40)}
    return e, spark.createDataFrame(sorted(e), "repo_id string, src string, dst string").cache()


@pytest.mark.parametrize("name", ["scc", "pagerank", "hits", "betweenness"])
def test_small_and_large_snapshots_alike(spark, random_graph, name):
    _, df = random_graph
    f = getattr(graph, name)
    args = (df,) if name == "scc" else (df, graph.nodes_of(df))
    a, b = ({(r[0], r[1]): r[2:] for r in f(*args, largest=n).collect()} for n in (10**6, 0))
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert x == y if name == "scc" else x == pytest.approx(y, abs=2e-5 if name == "pagerank" else 1e-4)


def test_all_signals_alike_in_small_and_large_snapshots(spark):
    from symgrid.operators import signals

    # one hub, so hubs settle within few rounds
    e = [("a", "h", f"x{i}") for i in range(6)] + [("a", *x) for x in (("x1", "h"), ("x2", "x1"), ("x3", "y"), ("y", "z"), ("z", "z"))] + [("b", "p", "q"), ("b", "q", "p")]
    df = spark.createDataFrame(e, "repo_id string, src string, dst string").coalesce(1).cache()
    nodes = graph.nodes_of(df).unionByName(spark.createDataFrame([("a", "alone")], "repo_id string, node string"))
    a, b = ({(r[0], r[1]): r[2:] for r in signals.signals(df, nodes, largest=n).collect()} for n in (10**6, 0))
    assert a.keys() == b.keys() and a["a", "alone"][:5] == ("alone", 0, 0, 1.0, 1.0)
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert x == pytest.approx(y, abs=1e-6) if isinstance(x, float) else x == y


@pytest.mark.parametrize("name", ["pagerank", "hits"])
def test_rounds_end_alike_in_small_and_large_snapshots(spark, name):
    e = [("s", "x", f"x{i}") for i in range(6)] + [("s", "y", "x5"), ("s", "y", "y0"), ("s", "y0", "x"), ("t", "a", "b")]
    if name == "hits":  # two stars that part slowly
        e = [("s", "x", f"x{i}") for i in range(5)] + [("s", "y", "y0"), ("s", "y", "y1"), ("t", "a", "b")]
    df = spark.createDataFrame(e, "repo_id string, src string, dst string").coalesce(1).cache()
    a, b = ({(r[0], r[1]): r[2:] for r in getattr(graph, name)(df, graph.nodes_of(df), largest=n).collect()} for n in (10**6, 0))
    assert a.keys() == b.keys()
    for k in a:
        assert b[k] == pytest.approx(a[k], rel=0, abs=1e-9)  # 8 digits are given out


def _brandes(nodes, ways, sources):
    score = dict.fromkeys(nodes, 0.0)
    for s in sources:
        dist, paths, order, at = {s: 0}, Counter({s: 1}), [s], 0
        while at < len(order):
            v, at = order[at], at + 1
            for w in ways[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        gain = Counter()
        for v in reversed(order):
            for w in ways[v]:
                if dist[w] == dist[v] + 1:
                    gain[v] += paths[v] / paths[w] * (1 + gain[w])
        for v in order[1:]:
            score[v] += gain[v]
    n = len(nodes)
    return {v: x * n / len(sources) / ((n - 1) * (n - 2)) for v, x in score.items()}


@pytest.mark.parametrize("largest", [10**6, 0])
def test_betweenness_is_exact_above_500_nodes(spark, largest):
    rng = random.Random(6)
    leaf, hub = lambda: f"{rng.randint(10, 299):03d}", lambda: f"{rng.randint(0, 9):03d}"
    e = sorted({(f"{i:03d}", hub()) for i in range(10, 300)} | {(hub(), f"{i:03d}") for i in range(300, 600)} | {(leaf(), hub()) for _ in range(80)} | {(hub(), hub()) for _ in range(12)})
    df = spark.createDataFrame([("r", *x) for x in e], "repo_id string, src string, dst string")
    ways = defaultdict(list)
    for a, b in e:
        ways[a].append(b)
    nodes = sorted({x for ab in e for x in ab})
    assert len(nodes) > 510
    want = _brandes(nodes, ways, nodes)
    got = {r.node: r.score for r in graph.betweenness(df, graph.nodes_of(df), largest=largest).collect()}
    assert got == pytest.approx(want, abs=6e-7)
    some = {r.node: r.score for r in graph.betweenness(df, graph.nodes_of(df), pivots=100, largest=largest, exact=len(nodes) - 1).collect()}
    assert some != pytest.approx(want, abs=6e-7)  # above the limit: a sample


def test_dag_depth_and_paths(spark):
    e = spark.createDataFrame([("r", "a", "b"), ("r", "a", "c"), ("r", "b", "d"), ("r", "c", "d"), ("r", "d", "e")], "repo_id string, src string, dst string")
    n = graph.nodes_of(e)
    for largest in (10**6, 0):
        assert {r.node: r.depth for r in graph.longest_depth(e, n, largest).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
        counts = {r.node: r.n for r in graph.path_counts(e, n.withColumn("size", F.lit(1)), largest).collect()}
        assert counts == {"e": 1, "d": 2, "b": 3, "c": 3, "a": 7}  # the diamond counts twice


@pytest.mark.parametrize("largest", [10**6, 0])
def test_chains_stop_at_branches_and_go_round(spark, largest):
    e = spark.createDataFrame([("r", *x) for x in ("ab", "bc", "cd", "xd", "pq", "qp", "mn", "nn")], "repo_id string, src string, dst string")
    got = {r.head: (r.length, r.members, r.circle) for r in graph.chains(e, largest=largest).collect()}
    assert got == {"a": (3, ["a", "b", "c"], False), "p": (2, ["p", "q"], True)}


@pytest.mark.parametrize("largest", [10**6, 0])
def test_distinct_reach_counts_a_diamond_once(spark, largest):
    e = spark.createDataFrame([("r", "a", "b"), ("r", "a", "c"), ("r", "b", "d"), ("r", "c", "d")], "repo_id string, src string, dst string")
    sizes = graph.nodes_of(e).withColumn("size", F.when(F.col("node") == "d", 3).otherwise(1))
    assert {r.node: r.n for r in graph.reach_counts(e, sizes, largest).collect()} == {"a": 6, "b": 4, "c": 4, "d": 3}


def test_reach_in_blocks():
    import numpy as np

    from symgrid.operators import local

    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 60, 150), rng.integers(0, 60, 150)
    src, dst = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    size = rng.integers(1, 4, 60).astype(float)
    names = [str(i) for i in range(60)]
    assert (local.reach_counts(names, src, dst, size, block=7)[0] == local.reach_counts(names, src, dst, size)[0]).all()


def _undirected_modularity(edges, of):
    m, inside, degree = 0, 0, Counter()
    for _, a, b in edges:
        m += 1
        inside += of[a] == of[b]
        degree[of[a]] += 1
        degree[of[b]] += 1
    return inside / m - sum(d * d for d in degree.values()) / (4 * m * m)


def test_communities_alike_in_one_task_and_by_joins(spark):
    from symgrid.operators import communities

    rng = random.Random(8)
    groups = [[f"{g}{i:02d}" for i in range(8)] for g in "xyz"]
    e = [("r", rng.choice(g), rng.choice(g)) for g in groups for _ in range(30)] + [("r", rng.choice(groups[0]), rng.choice(groups[1])), ("r", "x00", "x00"), ("r", "z01", "y01")]
    df = spark.createDataFrame(e, "repo_id string, src string, dst string").coalesce(2).cache()
    nodes = graph.nodes_of(df).unionByName(spark.createDataFrame([("r", "alone")], "repo_id string, node string"))
    for resolution in (1.0, 2.0):
        a, b = ({r.node: r.community for r in communities.louvain(df, nodes, resolution, largest=n).collect()} for n in (10**6, 0))
        assert a == b and a["alone"] == "alone"
        assert all(c == min(n for n in a if a[n] == c) for c in a.values())
    a = {r.node: r.community for r in communities.louvain(df, nodes).collect()}
    best = _undirected_modularity(e, {n: n[0] for n in a})
    assert _undirected_modularity(e, a) > best - 0.02
    got = communities.modularity(df, spark.createDataFrame([("r", n, c) for n, c in a.items()], "repo_id string, node string, community string")).first().modularity
    assert got == pytest.approx(_undirected_modularity(e, a))


def test_runs_of_calls_are_patterns(spark, tmp_path):
    from symgrid.operators.patterns import Detector
    from symgrid.sources.catalog import Catalog

    calls = [(f"a{i}", f"a{i + 1}") for i in range(5)] + [("u", "a0"), ("v", "a0")] + [(f"b{i}", f"b{i + 1}") for i in range(5)] + [(f"c{i}", f"c{(i + 1) % 5}") for i in range(5)]
    calls += [("h", f"m{i}") for i in range(4)] + [(f"m{i}", "red") for i in range(3)]
    _catalog(spark, tmp_path, sorted({x for ab in calls for x in ab}), calls)
    found = {(r.pattern, r.hash): r.nodes for r in Detector(Catalog(spark, str(tmp_path))).every().collect()}
    assert found["decorator_chain", "a0"] == ["a0", "a1", "a2", "a3", "a4", "a5"]
    assert found["chain_of_responsibility", "a1"] == ["a1", "a2", "a3", "a4", "a5"]  # a0 has two callers
    assert found["chain_of_responsibility", "b0"][-1] == "b5" and found["pipeline", "b1"] == ["b1", "b2", "b3", "b4", "b5"]
    assert found["pipeline", "c0"] == found["mutual_recursion", "c0"] == ["c0", "c1", "c2", "c3", "c4"]
    assert found["map_reduce", "h"] == ["h", "m0", "m1", "m2", "m3", "red"]
    assert Detector(Catalog(spark, str(tmp_path)), ["class"]).every().count() == 0


def _catalog(spark, folder, names, calls, modules=lambda x: x[0]):
    """Tables of one snapshot."""
    into, out = Counter(b for _, b in calls), Counter(a for a, _ in calls)
    rows = [("r@1", x, x, modules(x), f"{modules(x)}.py", 1, 2, "function", "low", 1, into[x], out[x], at(0)) for x in names]
    spark.createDataFrame(rows, f"repo_id string, hash string, name string, module string, file_path string, line_start int, line_end int, kind string, risk string, complexity int, caller_count int, callee_count int, loaded_at {TIME}").write.parquet(f"{folder}/nodes.parquet")
    spark.createDataFrame([("r@1", a, b, 1, "call") for a, b in calls], "repo_id string, caller_hash string, callee_hash string, call_count int, edge_kind string").write.parquet(f"{folder}/edges.parquet")


def _with(df, *names):
    """Extra columns with names that operators use themselves."""
    return df.withColumns({n: F.lit("extra") for n in names if n not in df.columns})


def test_extra_columns_with_clashing_names(spark):
    df = _with(spark.createDataFrame([("a", 1), ("a", 3), ("b", None), (None, 2)], "k string, v int"), "key", "value", "n", "band", "total", "rows", "at")
    assert rows(frequency.profile(frequency.compress(df, "k", "v")).select("key", "n_rows", "n_distinct")) == [("a", 2, 2), ("b", 1, 0)]
    assert [tuple(r) for r in frequency.percentiles(frequency.compress(df, "k", "v"), [0.5]).collect()] == [("a", 2, 2.0)]
    nodes = _with(spark.createDataFrame([("r", "a", at(0))], f"repo_id string, hash string, loaded_at {TIME}"), "closed_at", "ref_hash", "n0", "h", "k")
    snaps = _with(spark.createDataFrame([("r", at(5))], f"repo_id string, closed_at {TIME}"), "hash", "loaded_at")
    edges = _with(spark.createDataFrame([("r", "a", "b")], "repo_id string, caller_hash string, callee_hash string"), "h", "k", "r", "ref_hash", "n0")
    inh = _with(spark.createDataFrame([("r", "c")], "repo_id string, parent_hash string"), "h", "k", "child_hash")
    assert rows(orphans.orphans(edges, inh, nodes, snaps)) == [("edges", "callee_hash", "r", "b", 1), ("inheritance", "parent_hash", "r", "c", 1)]
    tree = _with(spark.createDataFrame([("r", "b", "a", at(0)), ("r", "s", "s", at(0))], f"repo_id string, child_hash string, parent_hash string, loaded_at {TIME}"), "id", "component", "repo", "node", "repo_key", "path", "child", "parent")
    for largest in (100, 0):
        assert {r.hash: r.depth for r in hierarchy.hierarchies(tree, largest).collect()} == {"a": 0, "b": 1, "s": -1}
    n = _with(spark.createDataFrame([("p@1", "m", "f", "x:1", at(0)), ("p@2", "m", "f", "x:2", at(0))], f"repo_id string, module string, name string, hash string, loaded_at {TIME}"), "entity", "value", "key_1", "chunk", "h", "part", "ord", "project")
    ex = _with(spark.createDataFrame([("p", f"p@{i}", "complete", at(i)) for i in (1, 2)], f"project string, repo_id string, export_state string, exported_at {TIME}"), "ord", "at", "last")
    assert rows(snapdiff.changes(snapdiff.node_entries(n), snapdiff.complete_exports(ex))) == [("node", "p@2", "m", "f", "changed")]


def test_missing_tables_and_snapshots_are_told(spark, tmp_path):
    from symgrid.sources.catalog import Catalog, RepoNotFound, UnreadableSnapshot

    _catalog(spark, tmp_path, ["a", "b"], [("a", "b")])
    c = Catalog(spark, str(tmp_path))
    assert not c.has_features and not c.has_schema and c.open("r@1").nodes.count() == 2
    with pytest.raises(RepoNotFound):
        c.open("none")
    with pytest.raises(UnreadableSnapshot):
        c.raw("inheritance")


def test_enrichment_of_a_diamond(spark, tmp_path):
    from symgrid.operators import analyses
    from symgrid.sources.catalog import Catalog

    _catalog(spark, tmp_path, list("abcde"), [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], modules=lambda x: "m" if x in "ab" else "n")
    c = Catalog(spark, str(tmp_path))
    got = {r.hash: r for r in analyses.enrich(c).collect()}
    assert got["a"].transitive_callees == 4 and got["d"].transitive_callers == 4  # the diamond counts twice
    assert (got["d"].topological_depth, got["a"].reverse_topological_depth) == (2, 2)
    assert sum(r.pagerank for r in got.values()) == pytest.approx(1, abs=1e-5)
    assert got["d"].xmod_fan_in == 1 and got["b"].stability_rank == 1.0 and got["a"].xmod_call_ratio == 0.5
    assert got["e"].community_dominant_mod == "n" and got["e"].community_alignment == 1 and got["e"].scc_size == 1
    assert analyses.enrich_to(c, str(tmp_path / "out")) == {}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_bucket_thresholds_differ_from_percentile_disc(spark):
    from symgrid.plans.explore import thresholds

    df = spark.createDataFrame([("r", x) for x in (1, 2, 3, 4)], "repo_id string, x int")
    assert thresholds(df, F.col("x"), 2).first().cuts == [3.0]


def test_filters(spark):
    from symgrid.plans import filters

    df = spark.createDataFrame([(0.0,), (1.0,), (3.0,), (None,)], "x double")
    keep = lambda t: [r.x for r in df.where(filters.match_expression(F.col("x"), t)).collect()]
    assert keep("> 2") == [3.0, None] and keep("!1..2") == [0.0, 3.0, None] and keep("= 1") == keep("==1") == [1.0, None]
    assert keep("! 0") == keep("!= 0") == [1.0, 3.0, None] and keep("1..3") == [1.0, 3.0, None]
    every = [0.0, 1.0, 3.0, None]
    assert keep("huh") == keep("") == keep(None) == keep("> -1") == keep("> 1.2.3") == every
    names = spark.createDataFrame([("Test",), ("core",), ("!x",), (None,)], "x string")
    match = lambda p: [r.x for r in names.where(filters.match_regex(F.col("x"), p)).collect()]
    assert match("test") == ["Test"] and match("!test") == ["core", "!x", None] and match("!!x") == ["Test", "core", None]
    assert match("(") == match("") == match("!") == match("(?P<n>a)") == ["Test", "core", "!x", None]  # not a pattern where it runs
    assert filters.parse_filters("[{") == [] and filters.parse_filters('[{"kind": "dim"}]') == [{"kind": "dim"}]


def test_paths_of_folders(spark):
    from symgrid.functions import scalars

    df = spark.createDataFrame([("a/b/c.py",), ("b/c.py",), ("c.py",), ("/x",), ("a//b/c",), ("",), (None,)], "p string")
    got = [tuple(r) for r in df.select(scalars.dirname(F.col("p")), scalars.dirdir(F.col("p"))).collect()]
    assert got == [("a/b", "a/b"), ("b", "b"), (".", "."), ("/", "/"), ("a//b", "a/b"), (None, None), (None, None)]


def test_formats_and_addresses(spark):
    from symgrid.functions import scalars

    df = spark.createDataFrame([(0.4214,), (0.0012,), (0.0,), (2.5,), (None,)], "x double")
    got = [tuple(r) for r in df.select(*[scalars.format_measure(F.col("x"), k) for k in ("ratio", "float", "int")]).collect()]
    assert got == [("42.1%", "0.421", "0"), ("0.1%", "1.20e-3", "0"), ("0.0%", "0.000", "0"), ("250.0%", "2.500", "3"), (None, None, None)]
    assert scalars.compare_url("https://h/o/p/", "p@a", "p@b") == "https://h/o/p/compare/a...b"
    assert scalars.compare_url("https://h/o/p", "p", "p@b").endswith("HEAD...b") and scalars.compare_url("https://h", "p@a", "q@a") is None
    assert df.limit(1).select(scalars.blend_colours("#000000", "#ff8000", F.lit(0.5))).first()[0] == "#804000"
    assert [s["arrow"] for s in scalars.steps(3)] == [8, 6, 4] and scalars.steps(1)[0]["colour"] == "rgb(255,149,0)"
    assert scalars.parse_symbol("a::b::c") == ("a", "b::c")


def test_rank_statistics(spark):
    from symgrid.operators import statistics

    rng = random.Random(11)
    data = [(rng.choice([0.0, 1.0, 2.0, rng.random()]), rng.choice([0.0, 1.0, rng.random()]), rng.randint(0, 1)) for _ in range(200)] + [(None, 1.0, 1), (float("nan"), 1.0, 0)]
    df = spark.createDataFrame(data, "a double, b double, l int").repartition(5)
    ok = [x for x in data if x[0] is not None and x[0] == x[0]]

    def ranks(v):
        s = sorted(v)
        return [(s.index(x) + 1 + len(s) - s[::-1].index(x)) / 2 for x in v]

    import numpy as np

    want = np.corrcoef(ranks([x[0] for x in ok]), ranks([x[1] for x in ok]))[0, 1]
    assert statistics.spearman(df, "a", "b").first().rho == pytest.approx(want)
    u = sum((x[0] > y[0]) + 0.5 * (x[0] == y[0]) for x in ok for y in ok if x[2] == 1 and y[2] == 0)
    assert statistics.mann_whitney(df, "a", "l").first().u == pytest.approx(u)
    assert statistics.mann_whitney(df.limit(0), "a", "l").first().u is None


def test_components_and_projection(spark):
    import numpy as np

    from symgrid.operators import statistics

    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3)) @ np.array([[3, 1, 0], [0, 1, 0.2], [0, 0, 0.5]])
    rows = [("r", f"h{i}", "n", "m", *map(float, r), 7.0) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "repo_id string, hash string, name string, module string, a double, b double, c double, d double")
    got = statistics.principal_components(df, 2, list("abcd"))
    z = (x - x.mean(0)) / x.std(0)
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert got["dropped"] == ["d"] and got["explained"] == pytest.approx((values / values.sum())[:2].tolist())
    scores = np.array([r.scores for r in got["scores"].orderBy("hash").collect()])
    order = np.argsort([f"h{i}" for i in range(60)])
    w = np.array([[got["loadings"][k][c] for c in "abc"] for k in range(2)])
    assert scores == pytest.approx(z[order] @ w.T, abs=1e-3)
    flat = statistics.projection(df, "tsne", list("abcd"), perplexity=10)
    assert flat.count() == 60 and flat.select("x", "y").distinct().count() == 60
    with pytest.raises(ValueError):
        statistics.projection(df, "tsne", list("abcd"), most=10)
    with pytest.raises(ValueError):
        statistics.principal_components(df.limit(1), 2, list("abcd"))


def test_queries_without_optional_package():
    import __spark_entry__ as e

    assert {"p1_found", "p2_found", "p6_found", "p7_found", "explore_default"} <= e.queries().keys()
    assert e.oracle_sql().keys() <= e.queries().keys()
