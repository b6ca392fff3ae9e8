"""One method for each thing a client asks for, with its defaults and bounds. Results are DataFrames or small dictionaries."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrid.functions.scalars import compare_url, parse_symbol, project_and_ref
from symgrid.operators import analyses, communities, details
from symgrid.operators.diffs import Diff
from symgrid.operators.patterns import Detector
from symgrid.plans import explore
from symgrid.plans.explore import Explore, parse_list
from symgrid.sources.catalog import Catalog, LoadBearing, RepoNotFound
from symgrid.sources.imports import Importer

C = F.col


def _within(name: str, value: float, least: float, most: float) -> float:
    if not least <= value <= most:
        raise ValueError(f"{name} must lie between {least} and {most}")
    return value


class Api:
    """Snapshots below a folder; declarations and addresses of projects as small JSON files below ``config``."""

    def __init__(self, spark: SparkSession, folder: str, config: str, importer: Importer | None = None) -> None:
        self.catalog, self.config, self.importer = Catalog(spark, folder), Path(config), importer

    def _open(self, repo_id: str) -> Catalog:
        return self.catalog.open(repo_id)

    def _declared(self, repo_id: str) -> LoadBearing:
        return LoadBearing(str(self.config / f"{repo_id}.load-bearing.json"))

    def _explore(self, repo_id: str, dimensions: str = "module", measures: str = "symbol_count,dead_ratio,caller_count:avg", kinds: str = "") -> Explore:
        return Explore(self._open(repo_id), parse_list(dimensions), parse_list(measures), parse_list(kinds))

    # snapshots

    def repos(self) -> DataFrame:
        return self.catalog.repos()

    def overview(self, repo_id: str) -> dict[str, DataFrame]:
        c = self._open(repo_id)
        return {"totals": c.overview(), "top_modules": c.top_modules(), "risks": c.risks()}

    def start_import(self, url: str) -> str:
        if self.importer is None:
            raise RuntimeError("no importer")
        return self.importer.start(url)

    def import_status(self, job: str) -> dict:
        return {"status": "not_found"} if self.importer is None else self.importer.status(job)

    # analyses

    def dead_code(self, repo_id: str, limit: int = 200) -> dict[str, DataFrame]:
        _within("limit", limit, 1, 1000)
        c = self._open(repo_id)
        return {"symbols": analyses.dead_code(c, limit), "files": analyses.dead_by_file(c, limit), "totals": analyses.dead_summary(c)}

    def cycles(self, repo_id: str) -> DataFrame:
        return analyses.cycles(self._open(repo_id))

    def modules(self, repo_id: str) -> DataFrame:
        return analyses.module_stats(self._open(repo_id))

    def module_edges(self, repo_id: str) -> DataFrame:
        return self._open(repo_id).top_module_edges(200)

    def module_edges_detail(self, repo_id: str, from_module: str, to_module: str, limit: int = 50) -> DataFrame:
        _within("limit", limit, 1, 200)
        return analyses.edge_details(self._open(repo_id), from_module, to_module, limit)

    def building(self, repo_id: str, max_nodes: int = 120) -> tuple[DataFrame, DataFrame]:
        _within("max_nodes", max_nodes, 1, 300)
        d = self._declared(repo_id)
        return analyses.building(self._open(repo_id), max_nodes, d.of["declared_modules"], d.of["declared_nodes"])

    def diff_building(self, repo_a: str, repo_b: str, max_nodes: int = 120) -> tuple[DataFrame, DataFrame]:
        _within("max_nodes", max_nodes, 1, 300)
        d = self._declared(repo_b.split("@")[0])
        return self._diff(repo_a, repo_b).building(max_nodes, d.of["declared_modules"], d.of["declared_nodes"])

    def triage(self, repo_id: str) -> DataFrame:
        d = self._declared(repo_id)
        return details.triage(self._open(repo_id), d.of["declared_modules"], d.of["declared_nodes"])

    def centrality(self, repo_id: str, top_n: int = 30) -> DataFrame:
        _within("top_n", top_n, 1, 100)
        return analyses.centrality(self._open(repo_id), top_n)

    def blast_radius(self, repo_id: str, hash_: str, max_depth: int = 5) -> DataFrame:
        _within("max_depth", max_depth, 0, 10)
        c = self._open(repo_id)
        return analyses.blast_radius(c, self._symbol(c, hash_), max_depth).join(c.internal_nodes.select("repo_id", "hash", "name", "module", "file_path", "caller_count"), ["repo_id", "hash"])

    def communities(self, repo_id: str, resolution: float = 1.0) -> communities.Report:
        _within("resolution", resolution, 0.1, 5.0)
        return communities.Report(self._open(repo_id), resolution)

    def module_graph(self, repo_id: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        _within("depth", depth, 1, 6)
        return analyses.module_graph(self._open(repo_id), depth)

    def patterns(self, repo_id: str, min_confidence: float = 0.6, kinds: str = "") -> dict[str, DataFrame]:
        _within("min_confidence", min_confidence, 0.0, 1.0)
        d = Detector(self._open(repo_id), parse_list(kinds))
        found = d.every(min_confidence)
        return {"instances": d.labels(found), "summary": d.summary(found)}

    # declarations

    def load_bearing(self, repo_id: str, threshold: int = 3) -> DataFrame:
        _within("threshold", threshold, 1, 50)
        d = self._declared(repo_id)
        return analyses.load_bearing(self._open(repo_id), d.of["declared_modules"], d.of["declared_nodes"], threshold)

    def load_bearing_config(self, repo_id: str) -> dict:
        return self._declared(repo_id).of

    def declare(self, repo_id: str, hash_: str | None = None, module: str | None = None, remove: bool = False) -> dict:
        d = self._declared(repo_id)
        for kind, value in (("declared_nodes", hash_), ("declared_modules", module)):
            if value:
                (d.undeclare if remove else d.declare)(kind, value)
        return d.of

    # symbols

    def graph(self, repo_id: str, module: str | None = None, limit: int = 300, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        _within("limit", limit, 1, 2000)
        return self._open(repo_id).graph_page(module, limit, offset)

    def _symbol(self, c: Catalog, hash_: str) -> DataFrame:
        found = c.nodes.where(C("hash") == hash_).select("repo_id", "hash")
        if not found.limit(1).count():
            raise RepoNotFound(hash_)
        return found

    def node(self, repo_id: str, hash_: str) -> dict[str, DataFrame]:
        c = self._open(repo_id)
        chosen = self._symbol(c, hash_)
        return {"node": c.nodes.where(C("hash") == hash_), "relations": details.relations(c, chosen)}

    def lookup(self, repo_id: str, symbol: str) -> dict[str, DataFrame]:
        found = details.lookup(self._open(repo_id), *parse_symbol(symbol)).first()
        if found is None:
            raise RepoNotFound(symbol)
        return self.node(repo_id, found.hash)

    def node_flags(self, repo_id: str) -> DataFrame | None:
        c = self._open(repo_id)
        return details.flags(c) if c.has_schema else None

    def inheritance_graph(self, repo_id: str) -> tuple[DataFrame, DataFrame] | None:
        c = self._open(repo_id)
        return details.inheritance_graph(c) if c.has_inheritance else None

    def search(self, repo_id: str, q: str, limit: int = 20) -> DataFrame:
        if not q:
            raise ValueError("nothing to search for")
        return explore.search(self._open(repo_id), q, limit)

    # diffs

    def _diff(self, repo_a: str, repo_b: str) -> Diff:
        for r in (repo_a, repo_b):
            self._open(r)
        c = Catalog(self.catalog.spark, self.catalog.folder)
        return Diff(c, c.spark.createDataFrame([(repo_a, repo_b)], "repo_a string, repo_b string"))

    def diff(self, repo_a: str, repo_b: str) -> dict[str, DataFrame]:
        d = self._diff(repo_a, repo_b)
        return {"summary": d.summary(), "symbols": d.symbol_lists(), "module_edges": d.module_edge_lists()}

    def diff_graph(self, repo_a: str, repo_b: str, max_context: int = 4, max_nodes: int = 120) -> dict:
        _within("max_context", max_context, 0, 10)
        _within("max_nodes", max_nodes, 1, 300)
        nodes, edges = self._diff(repo_a, repo_b).graph(max_context, max_nodes)
        meta = self.config / f"{repo_a.split('@')[0]}.meta.json"
        base = json.loads(meta.read_text()).get("github_url") if meta.exists() else None
        return {"nodes": nodes, "edges": edges, "compare_url": compare_url(base, repo_a, repo_b)}

    def diff_status(self, repo_id: str, compare_to: str) -> DataFrame:
        return self._diff(compare_to, repo_id).status.where(C("status") != "unchanged").select("symbol", "status")

    # pivots

    def explore(self, repo_id: str, dimensions: str = "module", measures: str = "symbol_count,dead_ratio,caller_count:avg", kinds: str = "", compare_to: str | None = None) -> dict:
        x = self._explore(repo_id, dimensions, measures, kinds)
        out: dict = {"pivot": x.envelope(), "available": explore.metadata(), "kinds": x.catalog.internal_nodes.select("kind").where(C("kind").isNotNull()).distinct()}
        if compare_to and x.dimensions:
            d = self._diff(compare_to, repo_id)
            out |= {"overlay": d.overlay(x), "edge_overlay": d.edge_overlay(x, x.dimensions[0])}
        return out

    def dimension_values(self, repo_id: str, kinds: str = "") -> DataFrame:
        return self._explore(repo_id, kinds=kinds).picker_values()

    def kinds(self, repo_id: str) -> DataFrame:
        return self._open(repo_id).internal_nodes.select("kind").where(C("kind").isNotNull()).distinct()

    def nodes(self, repo_id: str, sort_by: str = "caller_count", sort_dir: str = "desc", limit: int = 300, kinds: str = "") -> tuple[DataFrame, DataFrame]:
        _within("limit", limit, 1, 1000)
        x = self._explore(repo_id, "", "", kinds)
        return x.node_table(sort_by, sort_dir.lower() == "desc", limit), x.totals(limit)

    def versions(self) -> DataFrame:
        """(project, ref, repo_id) of each snapshot."""
        project, ref = project_and_ref(C("repo_id"))
        return self.catalog.repos().select(project.alias("project"), ref.alias("ref"), "repo_id")
