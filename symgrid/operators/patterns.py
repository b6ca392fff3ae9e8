"""Structural patterns: shapes of calls told by degrees, by a symbol's callees, by runs and by circles.

Degrees count edge rows between internal symbols. One profile of each caller's callees tells most patterns; the symbols
that an instance lists are looked up for the instances only, with a limit before the shuffle. Where an order matters
(first callee, first pair) it is that of the hashes or names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.operators import graph
from symgrid.sources.catalog import Catalog
from symgrid.sources.tables import keep

C = F.col
#: Patterns in the order that equal counts keep, with the names they are shown by.
REGISTRY = {
    "singleton": "Singleton",
    "factory_method": "Factory Method",
    "observer": "Observer / Event Bus",
    "decorator_chain": "Decorator Chain",
    "facade": "Façade",
    "composite_recursive": "Composite / Recursive",
    "strategy": "Strategy",
    "chain_of_responsibility": "Chain of Responsibility",
    "template_method": "Template Method",
    "command": "Command / Dispatcher",
    "map_reduce": "Map / Reduce",
    "mediator": "Mediator",
    "mutual_recursion": "Mutual Recursion",
    "layered_architecture": "Layered Architecture",
    "proxy": "Proxy",
    "pipeline": "Pipeline",
}
_INSTANCE = ["repo_id", "pattern", "hash"]


def _rise(base: float, step: float, x: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.lit(base) + F.lit(step) * x)


def _confidence(value: Column) -> Column:
    return F.bround(value.cast("double"), 2).alias("confidence")


def _found(df: DataFrame, rules: list[tuple[str, Column, Column]], *more: Column | str) -> DataFrame:
    """(repo_id, pattern, hash, confidence, more…): one row for each rule that holds. rules: name, condition, confidence."""
    each = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(name).alias("pattern"), _confidence(conf))) for name, cond, conf in rules]
    rows = df.select("repo_id", "hash", F.explode(F.array(*each)).alias("r"), *more).where(C("r").isNotNull())
    return rows.select("repo_id", "r.pattern", "hash", "r.confidence", *more)


class Detector:
    """Finds instances (repo_id, pattern, hash, confidence, nodes); ``hash`` is the symbol that an instance is about.

    ``kinds`` keeps symbols of some kinds only, and calls between them.
    """

    def __init__(self, c: Catalog, kinds: list[str] | None = None) -> None:
        nodes = c.internal_nodes.where(C("kind").isin(kinds)) if kinds else c.internal_nodes
        self.nodes = keep(nodes.select("repo_id", "hash", "name", "module"), "pattern-nodes")
        rows = c.call_rows
        if kinds:
            for end in ("src", "dst"):
                rows = rows.join(self.nodes.select("repo_id", C("hash").alias(end)), ["repo_id", end], "left_semi")
        rows = keep(rows, "pattern-calls")
        ends = F.explode(F.array(F.struct(C("src").alias("h"), F.lit(0).alias("i"), C("n").alias("o")), F.struct(C("dst").alias("h"), C("n").alias("i"), F.lit(0).cast("long").alias("o"))))
        deg = rows.select("repo_id", ends.alias("e")).groupBy("repo_id", C("e.h").alias("hash")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
        self.degrees = keep(deg, "pattern-degrees")
        into = self.degrees.select("repo_id", C("hash").alias("dst"), C("in_degree").alias("din"))
        # (repo_id, src, dst, s_module, t_module, n, din)
        self.calls = keep(rows.join(into, ["repo_id", "dst"]), "pattern-calls")

    # shapes of a symbol's callees

    def shapes(self) -> DataFrame:
        """Instances that degrees and one profile of callees tell, without their nodes."""
        same, narrow, n = C("s_module").eqNullSafe(C("t_module")), C("din") <= 2, C("n")
        count = lambda cond: F.sum(F.when(cond, n).otherwise(0))
        profile = self.calls.groupBy("repo_id", C("src").alias("hash")).agg(
            count(same & narrow).alias("same_narrow"),
            count(same & narrow & (C("src") != C("dst"))).alias("siblings"),
            count(narrow).alias("narrow"),
            count(C("din") == 1).alias("single"),
            F.count_distinct(F.when(~same, C("t_module"))).alias("modules"),
            F.max(C("src") == C("dst")).alias("loop"),
            count(same & (C("din") <= 1)).alias("subjects"),
        )
        p = self.degrees.join(profile, ["repo_id", "hash"], "left").na.fill(0).na.fill(False)
        i, o = C("in_degree"), C("out_degree")
        companion = F.when(C("single") > 0, 0.1).otherwise(0.0)
        rules = [
            ("singleton", (i >= 4) & (o <= 3), F.least(F.lit(0.95), _rise(0.55, 0.04, i, 0.95) + companion)),
            ("factory_method", C("same_narrow") >= 3, _rise(0.50, 0.06, C("same_narrow"), 0.90)),
            ("observer", (o >= 5) & (C("narrow") >= 4), _rise(0.55, 0.05, C("narrow"), 0.92)),
            ("facade", C("modules") >= 3, _rise(0.50, 0.08, C("modules"), 0.90)),
            ("composite_recursive", C("loop"), F.lit(0.85)),
            ("strategy", C("siblings").between(3, 8), _rise(0.48, 0.07, C("siblings"), 0.85)),
            ("template_method", C("narrow") >= 5, _rise(0.48, 0.05, C("narrow"), 0.87)),
            ("command", C("single") >= 5, _rise(0.50, 0.05, C("single"), 0.88)),
            ("mediator", (i >= 4) & (o >= 4), _rise(0.45, 0.025, i + o, 0.90)),
            ("proxy", (i >= 3) & (C("subjects") >= 1) & (C("narrow") >= 3), F.least(F.lit(0.88), 0.52 + 0.04 * i + 0.03 * (C("narrow") - 1))),
        ]
        return _found(p, rules)

    def _listed(self, rows: DataFrame, by: Column, most: dict[str, int], part: int) -> DataFrame:
        """(…, part, r, node): of candidates (repo_id, pattern, hash, node, n) the first ``most`` by ``by``, repeated as often as their edge rows."""
        limit = F.coalesce(F.create_map(*[x for k, v in most.items() for x in (F.lit(k), F.lit(v))])[C("pattern")], F.lit(0))
        first = rows.withColumn("r", F.row_number().over(Window.partitionBy(*_INSTANCE).orderBy(by))).where(C("r") <= max(most.values())).where(C("r") <= limit)
        times = F.explode(F.sequence(F.lit(1), F.least(C("n").cast("int"), limit)))
        return first.select(*_INSTANCE, F.lit(part).alias("part"), "r", "node", times.alias("time"), limit.alias("most"))

    def with_nodes(self, found: DataFrame) -> DataFrame:
        """Instances of ``shapes`` with their nodes: the symbol itself, then callees (or callers) by hash."""
        found = keep(found, "instances")
        at = found.select(*_INSTANCE)
        same, narrow = C("s_module").eqNullSafe(C("t_module")), C("din") <= 2
        p = lambda *names: C("pattern").isin(*names)
        out = at.join(self.calls.withColumnRenamed("src", "hash"), ["repo_id", "hash"])
        out = out.withColumn("node", C("dst"))
        fits = (
            (p("singleton", "command") & (C("din") == 1))
            | (p("factory_method") & same & narrow)
            | (p("strategy") & same & narrow & (C("dst") != C("hash")))
            | (p("observer", "template_method") & narrow)
            | (p("facade") & ~same)
            | p("mediator")
        )
        callees = self._listed(out.where(fits), C("node"), {"singleton": 1, "factory_method": 6, "observer": 8, "facade": 8, "strategy": 8, "template_method": 8, "command": 8, "mediator": 4}, 2)
        into = at.where(p("mediator")).join(self.calls.withColumnRenamed("dst", "hash"), ["repo_id", "hash"]).withColumn("node", C("src"))
        callers = self._listed(into, C("node"), {"mediator": 4}, 1)
        # a proxy's subject comes first, then its hooks
        hooks = out.where(p("proxy") & narrow)
        subject = hooks.where(same & (C("din") <= 1)).groupBy(*_INSTANCE).agg(F.min("node").alias("subject"))
        subjects = subject.select(*_INSTANCE, F.lit(1).alias("part"), F.lit(1).alias("r"), C("subject").alias("node"), F.lit(1).alias("time"), F.lit(1).alias("most"))
        others = self._listed(hooks.join(subject, _INSTANCE).where(C("node") != C("subject")), C("node"), {"proxy": 4}, 2)
        every = callees.unionByName(callers).unionByName(subjects).unionByName(others)
        # at most eight nodes a part
        parts = every.groupBy(*_INSTANCE, "part").agg(F.slice(F.array_sort(F.collect_list(F.struct("r", "time", "node"))), 1, F.max("most")).alias("some"))
        nodes = parts.groupBy(*_INSTANCE).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "some"))), lambda x: F.transform(x["some"], lambda y: y["node"]))).alias("others"))
        joined = found.join(nodes, _INSTANCE, "left")
        return joined.select(*_INSTANCE, "confidence", F.concat(F.array("hash"), F.coalesce("others", F.array().cast("array<string>"))).alias("nodes"))

    # shapes of more than one step

    def map_reduce(self) -> DataFrame:
        """A hub of four callees or more, three of which call the same symbol: the hub, six of them, and the symbol most of them call."""
        hub = self.degrees.where(C("out_degree") >= 4).select("repo_id", C("hash").alias("src"), C("out_degree").alias("mappers"))
        step = self.calls.join(hub, ["repo_id", "src"]).select("repo_id", C("src").alias("hub"), C("dst").alias("mapper"), C("n").alias("n1"), "mappers")
        down = self.calls.select("repo_id", C("src").alias("mapper"), C("dst").alias("to"), C("n").alias("n2"))
        meets = step.join(down, ["repo_id", "mapper"]).where(C("to") != C("hub")).groupBy("repo_id", "hub", "to", "mappers").agg(F.sum(C("n1") * C("n2")).alias("k")).where(C("k") >= 3)
        best = meets.groupBy("repo_id", C("hub").alias("hash"), "mappers").agg(F.min(F.struct((-C("k")).alias("k"), C("to").alias("to"))).alias("b"))
        found = best.select("repo_id", F.lit("map_reduce").alias("pattern"), "hash", _confidence(_rise(0.50, 0.06, C("mappers"), 0.86)), C("b.to").alias("reducer"))
        found = keep(found, "map-reduce")
        rows = found.select(*_INSTANCE).join(self.calls.withColumnRenamed("src", "hash"), ["repo_id", "hash"]).withColumn("node", C("dst"))
        listed = self._listed(rows, C("node"), {"map_reduce": 6}, 1)
        six = listed.groupBy(*_INSTANCE).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("r", "time", "node"))), lambda x: x["node"]), 1, 6).alias("six"))
        return found.join(six, _INSTANCE).select(*_INSTANCE, "confidence", F.concat(F.array("hash"), "six", F.array("reducer")).alias("nodes"))

    def runs(self) -> DataFrame:
        """Decorator chains, chains of responsibility and pipelines: runs by the callers of the symbol they begin with.

        Where the head of a run has too many callers for a chain of responsibility, or none as a pipeline needs one, the
        run begins with its second symbol, which has one caller.
        """
        edges = self.calls.select("repo_id", "src", "dst", F.explode(F.sequence(F.lit(1), F.least(C("n").cast("int"), F.lit(2)))).alias("i")).drop("i")
        run = graph.chains(edges).join(self.degrees.select("repo_id", C("hash").alias("head"), "in_degree"), ["repo_id", "head"])
        i, n = C("in_degree"), C("length")
        kinds = [
            ("decorator_chain", i >= 2, F.lit(False), 4, 0.45, 0.88),
            ("chain_of_responsibility", i <= 1, i > 1, 5, 0.40, 0.82),
            ("pipeline", i >= 1, i < 1, 4, 0.38, 0.80),
        ]
        out = None
        for name, head, second, least, base, cap in kinds:
            length = F.when(head, n).when(second, n - 1)
            rows = run.withColumn("k", length).where(C("k") >= least)
            members = F.when(head, F.slice("members", 1, 8)).otherwise(F.slice("members", 2, 8))
            rows = rows.select("repo_id", F.lit(name).alias("pattern"), members[0].alias("hash"), _confidence(_rise(base, 0.07, C("k"), cap)), members.alias("nodes"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def circles(self) -> DataFrame:
        """Mutual recursion: strongly connected symbols, two or more, named after the least; eight are listed."""
        parts = keep(graph.scc(self.calls.select("repo_id", "src", "dst")), "scc")
        size = parts.groupBy("repo_id", "scc").agg(F.count(F.lit(1)).alias("size")).where(C("size") > 1)
        some = parts.join(size, ["repo_id", "scc"]).withColumn("r", F.row_number().over(Window.partitionBy("repo_id", "scc").orderBy("node"))).where(C("r") <= 8)
        g = some.groupBy("repo_id", "scc", "size").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
        return g.select("repo_id", F.lit("mutual_recursion").alias("pattern"), C("scc").alias("hash"), _confidence(_rise(0.70, 0.04, C("size"), 0.95)), "nodes")

    def layers(self) -> DataFrame:
        """Layered architecture, once a snapshot: three calling modules or more and three pairs or more that call one way only.

        Its symbols are the first twelve by hash of the modules of the first three pairs.
        """
        pairs = keep(one_way(self.calls), "one-way")
        callers = self.calls.where(C("s_module") != C("t_module")).groupBy("repo_id").agg(F.count_distinct("s_module").alias("callers"))
        n = pairs.groupBy("repo_id").agg(F.count(F.lit(1)).alias("pairs")).join(callers, "repo_id").where((C("pairs") >= 3) & (C("callers") >= 3))
        first = pairs.withColumn("r", F.row_number().over(Window.partitionBy("repo_id").orderBy("caller_module", "callee_module"))).where(C("r") <= 3)
        of = first.select("repo_id", F.explode(F.array("caller_module", "callee_module")).alias("module")).distinct()
        some = self.nodes.join(of, ["repo_id", "module"], "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("repo_id").orderBy("hash"))).where(C("r") <= 12)
        g = n.join(some.groupBy("repo_id").agg(F.array_sort(F.collect_list("hash")).alias("nodes")), "repo_id")
        return g.select("repo_id", F.lit("layered_architecture").alias("pattern"), C("nodes")[0].alias("hash"), _confidence(_rise(0.50, 0.06, C("pairs"), 0.85)), "nodes")

    def every(self, least: float = 0.5) -> DataFrame:
        """All instances of at least that confidence, with their nodes."""
        shapes = self.with_nodes(self.shapes().where(C("confidence") >= least))
        out = shapes
        for rows in (self.map_reduce(), self.runs(), self.circles(), self.layers()):
            out = out.unionByName(rows.where(C("confidence") >= least))
        return out

    def summary(self, instances: DataFrame) -> DataFrame:
        """(repo_id, row_no, pattern, display_name, count): patterns with instances, most frequent first, ties as registered."""
        keys = list(REGISTRY)
        place = F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(k), F.lit(i))])
        name = F.create_map(*[x for k, v in REGISTRY.items() for x in (F.lit(k), F.lit(v))])
        n = instances.groupBy("repo_id", "pattern").agg(F.count(F.lit(1)).alias("count"))
        order = Window.partitionBy("repo_id").orderBy(C("count").desc(), place[C("pattern")])
        return n.select("repo_id", F.row_number().over(order).alias("row_no"), "pattern", name[C("pattern")].alias("display_name"), "count")

    def labels(self, instances: DataFrame) -> DataFrame:
        """Instances with the names of their nodes as module.name."""
        rows = instances.select(*_INSTANCE, F.posexplode("nodes").alias("at", "node"))
        named = rows.join(self.nodes.select("repo_id", C("hash").alias("node"), F.concat_ws(".", F.coalesce("module", F.lit("")), F.coalesce("name", F.lit(""))).alias("label")), ["repo_id", "node"])
        listed = named.groupBy(*_INSTANCE).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("labels"))
        return instances.join(listed, _INSTANCE)


def one_way(calls: DataFrame) -> DataFrame:
    """(repo_id, caller_module, callee_module): pairs of modules that call one way only; null modules are none."""
    p = calls.where(C("s_module") != C("t_module")).select("repo_id", C("s_module").alias("caller_module"), C("t_module").alias("callee_module")).distinct()
    back = p.select("repo_id", C("callee_module").alias("caller_module"), C("caller_module").alias("callee_module"))
    return p.join(back, ["repo_id", "caller_module", "callee_module"], "left_anti")
