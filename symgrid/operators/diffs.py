"""Diffs of two exports: symbols by module and name, calls between them, and what a view of the later one shows of it.

A pair (repo_a, repo_b) is compared as before and after; by default every complete export is compared with the one before
it. Symbols without module or name have no identity across exports and are left out; of several with the same the
greatest hash counts.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.functions.scalars import symbol
from symgrid.operators.analyses import building, declaration, layer
from symgrid.operators.snapdiff import complete_exports, content
from symgrid.plans.explore import Explore, alias
from symgrid.sources.catalog import Catalog
from symgrid.sources.tables import keep, small

C = F.col
_PAIR = ["repo_a", "repo_b"]
#: What a changed symbol is worth where members of a group are averaged.
VALUES = {"added": 0.0, "modified": 0.25, "unchanged": 0.5, "removed": 1.0}


def consecutive(c: Catalog) -> DataFrame:
    """(repo_a, repo_b): each complete export of a project with the one before it."""
    ex = keep(complete_exports(c.raw("snapshots")), "exports")
    before = ex.select("project", (C("ord") + 1).alias("ord"), C("repo_id").alias("repo_a"))
    return ex.join(before, ["project", "ord"]).select("repo_a", C("repo_id").alias("repo_b"))


def _first(df: DataFrame, n: int, by: list[str], *order: Column) -> DataFrame:
    return df.withColumn("row_no", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(C("row_no") <= n)


class Diff:
    """The comparison of pairs of exports."""

    def __init__(self, c: Catalog, pairs: DataFrame | None = None) -> None:
        self.c = c
        self.pairs = keep((consecutive(c) if pairs is None else pairs).select(*_PAIR).distinct(), "pairs")

    @cached_property
    def symbols(self) -> DataFrame:
        """One row for each symbol of each export."""
        about = ["hash", "name", "module", "kind", "file_path", "caller_count", "callee_count"]
        rows = self.c.internal_nodes.where(C("module").isNotNull() & C("name").isNotNull()).groupBy("repo_id", symbol(C("module"), C("name")).alias("symbol"))
        return keep(rows.agg(F.max(F.struct(*about)).alias("r")).select("repo_id", "symbol", "r.*").withColumn("body", content("hash")), "symbols")

    def side(self, end: str, df: DataFrame) -> DataFrame:
        """Rows of the exports that stand at one end of a pair, once for each of their pairs."""
        return df.join(small(self.pairs.withColumn("repo_id", C(end))), "repo_id").drop("repo_id")

    @cached_property
    def status(self) -> DataFrame:
        """(repo_a, repo_b, symbol, status, name, module, kind, caller_count): details from the later export, of removed ones from the earlier."""
        details = ["name", "module", "kind", "file_path", "caller_count", "body"]
        a = self.side("repo_a", self.symbols).select(*_PAIR, "symbol", F.struct(*details).alias("a"))
        b = self.side("repo_b", self.symbols).select(*_PAIR, "symbol", F.struct(*details).alias("b"))
        both = a.join(b, [*_PAIR, "symbol"], "full_outer")
        status = F.when(C("a").isNull(), "added").when(C("b").isNull(), "removed").when(C("a.body") != C("b.body"), "modified").otherwise("unchanged")
        shown = F.coalesce("b", "a")
        return keep(both.select(*_PAIR, "symbol", status.alias("status"), *[shown[x].alias(x) for x in details if x != "body"]), "status")

    @cached_property
    def module_edges(self) -> DataFrame:
        """(repo_a, repo_b, from, to, status, count): pairs of modules with calls in one of the two only; the external one left out."""
        e = self.c.module_edges.select("repo_id", C("caller_module").alias("from"), C("callee_module").alias("to"), F.struct("edge_count").alias("n"))
        key = [*_PAIR, "from", "to"]
        a, b = self.side("repo_a", e).withColumnRenamed("n", "a"), self.side("repo_b", e).withColumnRenamed("n", "b")
        both = a.join(b, key, "full_outer").where(C("a").isNull() | C("b").isNull())
        return keep(both.select(*key, F.when(C("a").isNull(), "added").otherwise("removed").alias("status"), F.coalesce("b", "a")["edge_count"].alias("count")), "module-diff")

    def summary(self) -> DataFrame:
        """Numbers of symbols added, removed, modified and unchanged, similarity common / all, module pairs added and removed."""
        s = self.status.groupBy(*_PAIR).agg(*[F.count_if(C("status") == x).alias(x) for x in VALUES])
        common = C("modified") + C("unchanged")
        s = self.pairs.join(s, _PAIR, "left").na.fill(0)
        s = s.withColumn("similarity", F.bround(common / F.greatest(common + C("added") + C("removed"), F.lit(1)), 3))
        m = self.module_edges.groupBy(*_PAIR).agg(*[F.count_if(C("status") == x).alias(f"module_edges_{x}") for x in ("added", "removed")])
        return s.join(m, _PAIR, "left").na.fill(0)

    def symbol_lists(self, limit: int = 50) -> DataFrame:
        """Symbols added and removed, ``limit`` of each, by module and name."""
        rows = self.status.where(C("status").isin("added", "removed"))
        return _first(rows, limit, [*_PAIR, "status"], C("module"), C("name")).select(*_PAIR, "status", "row_no", "module", "name", "kind", "caller_count")

    def module_edge_lists(self, limit: int = 30) -> DataFrame:
        """Module pairs added and removed, ``limit`` of each, by name."""
        return _first(self.module_edges, limit, [*_PAIR, "status"], C("from"), C("to")).select(*_PAIR, "status", "row_no", "from", "to", "count")

    # the graph around changes

    def calls(self, end: str) -> DataFrame:
        """(repo_a, repo_b, src, dst): distinct calls between symbols of the export at that end."""
        of = lambda h, s: self.symbols.select("repo_id", C("hash").alias(h), C("symbol").alias(s))
        e = self.c.edges.select("repo_id", "caller_hash", "callee_hash").distinct()
        e = e.join(of("caller_hash", "src"), ["repo_id", "caller_hash"]).join(of("callee_hash", "dst"), ["repo_id", "callee_hash"])
        return self.side(end, e.select("repo_id", "src", "dst"))

    def graph(self, max_context: int = 4, max_nodes: int = 120) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges): changed symbols, their most called neighbours as context, and the calls between them.

        Each changed symbol looks at its ``max_context`` callers and as many callees of most callers (ties by symbol; a
        modified one at half of them and one more); neighbours that changed themselves use a place but add none. Above
        ``max_nodes`` the context is cut, that of most callers first; changed symbols are never cut.
        """
        calls = keep(self.calls("repo_a").withColumn("side", F.lit("a")).unionByName(self.calls("repo_b").withColumn("side", F.lit("b"))), "diff-calls")
        changed = keep(self.status.where(C("status") != "unchanged"), "changed")
        half = max_context // 2 + 1
        look = changed.select(*_PAIR, "symbol", F.when(C("status") == "removed", "a").otherwise("b").alias("side"), F.when(C("status") == "modified", half).otherwise(max_context).alias("most"))
        weight = self.status.select(*_PAIR, C("symbol").alias("near"), F.coalesce("caller_count", F.lit(0)).alias("callers"), (C("status") != "unchanged").alias("is_changed"))
        ends = [calls.select(*_PAIR, "side", C(a).alias("symbol"), C(b).alias("near"), F.lit(b).alias("role")) for a, b in (("src", "dst"), ("dst", "src"))]
        near = look.join(ends[0].unionByName(ends[1]), [*_PAIR, "side", "symbol"]).join(weight, [*_PAIR, "near"])
        place = F.row_number().over(Window.partitionBy(*_PAIR, "symbol", "role").orderBy(C("callers").desc(), "near"))
        near = near.withColumn("r", place).where(C("r") <= max(max_context, half)).where((C("r") <= C("most")) & ~C("is_changed"))
        context = near.select(*_PAIR, C("near").alias("symbol"), "callers").distinct()
        n = changed.groupBy(*_PAIR).agg(F.count(F.lit(1)).alias("n_changed"))
        total = F.count(F.lit(1)).over(Window.partitionBy(*_PAIR)) + C("n_changed")
        ranked = context.withColumn("r", F.row_number().over(Window.partitionBy(*_PAIR).orderBy(C("callers").desc(), "symbol"))).join(n, _PAIR).withColumn("total", total)
        kept = ranked.where((C("total") <= max_nodes) | (C("r") <= F.greatest(F.lit(0), max_nodes - C("n_changed")))).select(*_PAIR, "symbol", F.lit("context").alias("shown"))
        chosen = keep(changed.select(*_PAIR, "symbol", C("status").alias("shown")).unionByName(kept), "diff-nodes")
        nodes = chosen.join(self.status, [*_PAIR, "symbol"]).select(*_PAIR, F.concat("name", F.lit("::"), "module").alias("id"), "name", "module", "kind", "caller_count", C("shown").alias("status"))
        e = calls
        for end in ("src", "dst"):
            e = e.join(chosen.select(*_PAIR, C("symbol").alias(end)), [*_PAIR, end], "left_semi")
        sides = e.groupBy(*_PAIR, "src", "dst").agg(F.bool_or(C("side") == "a").alias("a"), F.bool_or(C("side") == "b").alias("b"))
        status = F.when(C("a") & C("b"), "unchanged").when(C("b"), "added").otherwise("removed")
        turn = lambda x: F.regexp_replace(x, r"^(?s)(.*?)::(.*)$", "$2::$1")
        return nodes, sides.select(*_PAIR, turn("src").alias("source"), turn("dst").alias("target"), status.alias("status"))

    # what a view shows

    def changed_only(self, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes without the context, and the edges between them."""
        rows = nodes.where(C("status") != "context")
        for end in ("source", "target"):
            edges = edges.join(rows.select(*_PAIR, C("id").alias(end)), [*_PAIR, end], "left_semi")
        return rows, edges

    def overlay(self, explore: Explore) -> DataFrame:
        """A pivot of the later export with diff_status_value: the mean over a group's symbols, 0 added, 0.25 modified, 0.5 unchanged.

        Exports that are the later end of no pair are left out, removed symbols have no row there.
        """
        keys = [alias(d) for d in explore.dimensions]
        value = F.create_map(*[F.lit(x) for kv in VALUES.items() for x in kv])
        status = self.status.select("repo_a", C("repo_b").alias("repo_id"), C("symbol").alias("id"), value[C("status")].alias("v"))
        rows = explore.rows().withColumn("id", symbol(C("module"), C("name"))).join(small(self.pairs.withColumnRenamed("repo_b", "repo_id")), "repo_id")
        names = [C(f"d_{i}").alias(k) for i, k in enumerate(keys)]
        rows = rows.join(status, ["repo_a", "repo_id", "id"], "left").select("repo_a", "repo_id", *names, F.coalesce("v", F.lit(0.5)).alias("v"))
        mean = rows.groupBy("repo_a", "repo_id", *keys).agg(F.round(F.avg("v"), 3).alias("diff_status_value"))
        pivot = explore.pivot()
        on = pivot["repo_id"] == mean["repo_id"]
        for k in keys:
            on &= pivot[k].eqNullSafe(mean[k])
        return pivot.join(mean, on).select(mean["repo_a"], *[pivot[x] for x in pivot.columns], mean["diff_status_value"])

    def legend(self, overlaid: DataFrame) -> DataFrame:
        """By pair: rows that are wholly added, modified, unchanged or removed."""
        return overlaid.groupBy("repo_a", "repo_id").agg(*[F.count_if(C("diff_status_value") == v).alias(k) for k, v in VALUES.items()])

    def highlighted(self, overlaid: DataFrame, key: str) -> DataFrame:
        """Rows of an overlaid pivot that changed: their value is below that of what stayed."""
        return overlaid.where((C("diff_status_value") < 0.49) & C(key).isNotNull()).select("repo_a", "repo_id", C(key).alias("id"), "diff_status_value")

    def edge_overlay(self, explore: Explore, dimension: str) -> DataFrame:
        """Edges of the later export over a dimension: added, modified if a symbol at either end changed, else unchanged.

        Each dimension is compared with the edges of the earlier export over the same one.
        """
        key = [*_PAIR, "source", "target"]
        both = Explore(self.c, [dimension], [], explore.kinds)  # the view may show one export only
        edges = both.induced_edges(dimension)
        base = self.side("repo_a", edges).select(*key, F.lit(True).alias("old"))
        ends = both.rows().select("repo_id", symbol(C("module"), C("name")).alias("symbol"), C("d_0").alias("group"))
        changed = self.status.where(C("status") != "unchanged").select(*_PAIR, "symbol")
        groups = self.side("repo_b", ends).unionByName(self.side("repo_a", ends)).join(changed, [*_PAIR, "symbol"], "left_semi").select(*_PAIR, "group").distinct()
        groups = keep(groups, "changed-groups")
        e = self.side("repo_b", edges).join(base, key, "left")
        for end in ("source", "target"):
            e = e.join(groups.select(*_PAIR, C("group").alias(end), F.lit(True).alias(f"c_{end}")), [*_PAIR, end], "left")
        status = F.when(C("old").isNull(), "added").when(C("c_source").isNotNull() | C("c_target").isNotNull(), "modified").otherwise("unchanged")
        return e.select(*key, "weight", status.alias("diff_status"))

    def building(self, n: int = 120, modules: list[str] = (), hashes: list[str] = ()) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges): the n most called symbols of both exports as added, removed or common, in layers; edges of both, repeated ones too."""
        nodes, edges = building(self.c, n)
        rows = nodes.where(C("name").isNotNull() & C("module").isNotNull()).select("repo_id", "hash", "name", "module", "file_path", "caller_count", "callee_count", "complexity", "risk")
        rows = keep(rows, "diff-building")
        most = rows.groupBy("repo_id").agg(F.nullif(F.max("caller_count"), F.lit(0)).alias("most"))
        placed = rows.join(small(most), "repo_id").withColumn("layer", layer(F.coalesce(C("caller_count") / C("most"), F.lit(0.0))))
        one = placed.groupBy("repo_id", "name", "module").agg(F.max(F.struct("hash", "file_path", "caller_count", "callee_count", "complexity", "risk", "layer")).alias("r"))
        key = [*_PAIR, "name", "module"]
        a, b = self.side("repo_a", one).withColumnRenamed("r", "a"), self.side("repo_b", one).withColumnRenamed("r", "b")
        both = a.join(b, key, "full_outer")
        status = F.when(C("a").isNull(), "added").when(C("b").isNull(), "removed").otherwise("common")
        out = both.select(*key, status.alias("diff_status"), F.coalesce("b", "a").alias("r")).select(*key, "diff_status", "r.*")
        out = out.withColumn("declaration", declaration(modules, hashes, "none")).withColumn("is_load_bearing", C("declaration") != "none")
        return out, self.side("repo_a", edges).unionByName(self.side("repo_b", edges))
