"""What a client may ask for, on a small snapshot pair."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from symgrid.functions.scalars import parse_repo_url
from symgrid.plans.api import Api
from symgrid.plans.explore import parse_dimension, parse_list
from symgrid.sources.catalog import RepoNotFound
from symgrid.sources.imports import Importer, repo_id_of
from tests.test_core import TIME, at


@pytest.fixture(scope="module")
def api(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("api")
    shape = f"repo_id string, hash string, name string, module string, file_path string, line_start int, line_end int, kind string, risk string, complexity int, caller_count int, callee_count int, loaded_at {TIME}"
    row = lambda repo, h, name, module, body, callers=1: (repo, f"{h}:{body}", name, module, f"{module}/f.py", 1, 9, "function", "low", 3, callers, 1, at(0))
    nodes = [row("p@1", "a", "f", "core", "x", 0), row("p@1", "b", "g", "api", "y"), row("p@1", "c", "h", "api", "z"), row("p@2", "a", "f", "core", "x", 0), row("p@2", "b", "g", "api", "y2"), row("p@2", "d", "k", "core", "n")]
    spark.createDataFrame(nodes, shape).write.parquet(f"{folder}/nodes.parquet")
    calls = [("p@1", "a:x", "b:y"), ("p@1", "b:y", "c:z"), ("p@2", "a:x", "b:y2"), ("p@2", "b:y2", "d:n"), ("p@2", "d:n", "b:y2")]
    spark.createDataFrame([(*c, 2, "call") for c in calls], "repo_id string, caller_hash string, callee_hash string, call_count int, edge_kind string").write.parquet(f"{folder}/edges.parquet")
    modules = [("p@1", "core", "api", 1, at(0)), ("p@2", "core", "api", 1, at(0)), ("p@2", "api", "core", 1, at(0))]
    spark.createDataFrame(modules, f"repo_id string, caller_module string, callee_module string, edge_count int, loaded_at {TIME}").write.parquet(f"{folder}/module_edges.parquet")
    (folder / "p.meta.json").write_text(json.dumps({"github_url": "https://host/o/p"}))
    return Api(spark, str(folder), str(folder))


def names(df, column):
    return sorted(r[0] for r in df.select(column).collect())


def test_snapshots_and_symbols(api):
    assert names(api.repos(), "repo_id") == ["p@1", "p@2"] and names(api.versions(), "ref") == ["1", "2"]
    assert api.overview("p@1")["totals"].first().node_count == 3
    with pytest.raises(RepoNotFound):
        api.overview("q@1")
    with pytest.raises(RepoNotFound):
        api.lookup("p@1", "core::none")
    around = api.lookup("p@1", "api::g")["relations"] if api.catalog.has_inheritance else None
    assert around is None and api.node_flags("p@1") is None and api.inheritance_graph("p@1") is None
    assert names(api.search("p@1", "F"), "name") == ["f"]
    nodes, edges = api.graph("p@2", limit=2, offset=1)
    assert names(nodes, "hash") == ["b:y2", "d:n"] and edges.count() == 2
    table, totals = api.nodes("p@2", "name", "asc", 2)
    assert [r.name for r in table.orderBy("row_no").collect()] == ["f", "g"] and totals.first().truncated
    with pytest.raises(ValueError):
        api.nodes("p@2", limit=5000)


def test_analyses_of_a_snapshot(api):
    assert names(api.blast_radius("p@1", "c:z"), "name") == ["f", "g"]
    assert [r.nodes for r in api.cycles("p@2").collect()] == [["b:y2", "d:n"]]
    assert api.dead_code("p@1")["totals"].first().dead == 1
    assert names(api.module_edges_detail("p@1", "core", "api"), "callee_name") == ["g"]
    assert api.declare("p@1", module="core") == {"declared_modules": ["core"], "declared_nodes": []}
    assert {r.name: r.declaration for r in api.building("p@1")[0].collect()} == {"f": "explicit", "g": "none", "h": "none"}
    assert api.declare("p@1", module="core", remove=True) == api.load_bearing_config("p@1") == {"declared_modules": [], "declared_nodes": []}
    assert api.communities("p@2").totals().first().total_nodes in (2, 3)
    assert names(api.patterns("p@2")["summary"], "pattern") == ["mutual_recursion"]
    assert api.triage("p@2").where("type = 'cross_module_cycle'").count() == 1
    assert api.centrality("p@1").orderBy("row_no").first().name == "g"
    assert api.module_graph("p@1")[0].count() == 2 and api.modules("p@1").count() == 2


def test_diffs_and_pivots(api):
    assert {r.symbol: r.status for r in api.diff_status("p@2", "p@1").collect()} == {"core::k": "added", "api::h": "removed", "api::g": "modified"}
    s = api.diff("p@1", "p@2")["summary"].first()
    assert (s.added, s.removed, s.modified, s.unchanged, s.similarity, s.module_edges_added) == (1, 1, 1, 1, 0.5, 1)
    g = api.diff_graph("p@1", "p@2")
    assert g["compare_url"] == "https://host/o/p/compare/1...2" and {r.id: r.status for r in g["nodes"].collect()}["f::core"] == "context"
    assert {(r.source, r.target): r.status for r in g["edges"].collect()}["g::api", "h::api"] == "removed"
    x = api.explore("p@2", "module", compare_to="p@1")
    assert {r.module: r.diff_status_value for r in x["overlay"].collect()} == {"core": 0.25, "api": 0.25}
    assert {(r.source, r.target): r.diff_status for r in x["edge_overlay"].collect()} == {("core", "api"): "modified", ("api", "core"): "added"}
    assert x["pivot"].rows.count() == 2 and x["pivot"].types["dead_ratio"] == "ratio" and not x["pivot"].enriched
    flat = api.explore("p@2", "symbol")["pivot"]
    assert flat.rows.count() == 3 and flat.edges.count() == 3 and flat.totals.first().total_count == 3
    nothing = api.explore("p@2", "in_cycle,huh", "pagerank:avg")["pivot"]
    assert nothing.measures == [] and nothing.edges.count() == 0  # features are missing
    assert names(api.dimension_values("p@2").where(F.col("dimension") == "module"), "value") == ["api", "core"]
    nodes, edges = api.diff_building("p@1", "p@2")
    assert {(r.name, r.diff_status) for r in nodes.collect()} == {("f", "common"), ("g", "common"), ("h", "removed"), ("k", "added")} and edges.count() == 5


def test_tokens_of_dimensions():
    assert parse_dimension("module") == ("module", None) and parse_dimension("complexity:decile") == ("complexity", "decile")
    assert parse_dimension("complexity:third") is None and parse_list(" a,,b ") == ["a", "b"] and parse_list("", ["x"]) == ["x"]


def test_imports_go_through_their_steps():
    seen = []
    steps = {s: lambda *a, s=s: seen.append((s, a)) for s in ("cloning", "indexing", "exporting", "enriching")}
    job = (i := Importer(steps)).start("https://host.org/o/r.git")
    assert i.wait(job, 10)["status"] == "done" and [s for s, _ in seen] == list(steps) and seen[0][1] == ("o", "r", None, "r@HEAD")

    def fail(*_):
        raise RuntimeError("no")

    job = (i := Importer(steps | {"enriching": fail})).start("https://host.org/o/r/tree/v1")
    assert i.wait(job, 10) | {"job_id": 0} == {"job_id": 0, "status": "done", "message": "", "progress": 100, "repo_id": "r@v1", "warning": "no"}
    job = (i := Importer(steps | {"indexing": fail})).start("https://host.org/o/r")
    assert i.wait(job, 10)["status"] == "error" and i.status("none") == {"status": "not_found"}
    with pytest.raises(ValueError):
        i.start("not an address")
    assert repo_id_of("r", "a" * 40) == "r@" + "a" * 12
    assert parse_repo_url("http://h.org/o/r/commit/abc/") == {"owner": "o", "repo": "r", "ref": "abc"}
