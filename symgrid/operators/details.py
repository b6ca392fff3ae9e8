"""A symbol's neighbours, flags and relatives, and what to look at first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgrid.functions.scalars import symbol
from symgrid.operators import analyses
from symgrid.operators.analyses import first_rows
from symgrid.operators.rows import is_reference
from symgrid.sources.catalog import Catalog, internal
from symgrid.sources.tables import keep

C = F.col
_RELATION = ["relation", "row_no", "hash", "name", "module", "file_path", "line_start", "call_count"]


def lookup(c: Catalog, module: str, name: str) -> DataFrame:
    """(repo_id, hash) of the symbol of that module and name in each snapshot, the least hash of several."""
    return c.nodes.where((C("module") == module) & (C("name") == name)).groupBy("repo_id").agg(F.min("hash").alias("hash"))


def relations(c: Catalog, chosen: DataFrame) -> DataFrame:
    """(repo_id, of, relation, row_no, …): around each chosen symbol (repo_id, hash) 50 callers and callees, 20 external callees, parents, 30 children.

    Callers are those with most callers first, callees and external ones by calls, the others by hash; the hash breaks
    ties. Edge rows count each; a parent that isn't in the snapshot has its name only. External callees have their
    package as module.
    """
    of = keep(chosen.select("repo_id", C("hash").alias("of")).distinct(), "chosen")
    nodes = c.nodes.select("repo_id", "hash", "name", "module", "file_path", "line_start", "caller_count", "ext_package")
    into = c.edges.join(of.withColumnRenamed("of", "callee_hash"), ["repo_id", "callee_hash"]).select("repo_id", C("callee_hash").alias("of"), C("caller_hash").alias("hash"), "call_count")
    out = c.edges.join(of.withColumnRenamed("of", "caller_hash"), ["repo_id", "caller_hash"]).select("repo_id", C("caller_hash").alias("of"), C("callee_hash").alias("hash"), "call_count")
    out = keep(out, "out")
    inherits = keep(_parents(c), "parents")
    up = inherits.join(of.withColumnRenamed("of", "child_hash"), ["repo_id", "child_hash"]).select("repo_id", C("child_hash").alias("of"), C("parent_hash").alias("hash"), "parent_name")
    down = inherits.join(of.withColumnRenamed("of", "parent_hash"), ["repo_id", "parent_hash"]).select("repo_id", C("parent_hash").alias("of"), C("child_hash").alias("hash"))

    def part(name: str, rows: DataFrame, limit: int, *order: Column) -> DataFrame:
        if "call_count" not in rows.columns:
            rows = rows.withColumn("call_count", F.lit(None).cast("int"))
        first = first_rows(rows.withColumn("relation", F.lit(name)), limit, ["repo_id", "of"], *order, C("hash"), C("call_count").desc_nulls_last())
        return first.select("repo_id", "of", *_RELATION)

    by_calls = C("call_count").desc_nulls_last()
    external = out.where(~internal()).join(nodes, ["repo_id", "hash"]).withColumn("module", C("ext_package"))
    parents = up.join(nodes, ["repo_id", "hash"], "left").withColumn("name", F.coalesce("parent_name", "name"))
    parts = [
        part("caller", into.join(nodes, ["repo_id", "hash"]), 50, C("caller_count").desc_nulls_last()),
        part("callee", out.where(internal()).join(nodes, ["repo_id", "hash"]), 50, by_calls),
        part("external", external, 20, by_calls),
        part("parent", parents, 1_000, F.lit(0)),
        part("child", down.join(nodes, ["repo_id", "hash"]), 30, F.lit(0)),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def flags(c: Catalog) -> DataFrame:
    """(repo_id, symbol, async, recursive, exported, test) of the internal symbols with some flag or framework entry point.

    Several symbols of one module and name have the greatest of their flags; null flags are 0.
    """
    entry = F.coalesce("framework_entry_point", F.lit(""))
    some = (C("is_async") == 1) | (C("is_self_recursive") == 1) | (C("is_exported") == 1) | (entry != "")
    n = c.internal_nodes.where(F.coalesce(some, entry != "")).withColumn("symbol", symbol(C("module"), C("name"))).where(C("symbol").isNotNull())
    best = lambda x, name: F.max(F.coalesce(x, F.lit(0)).cast("int")).alias(name)
    return n.groupBy("repo_id", "symbol").agg(best(C("is_async"), "async"), best(C("is_self_recursive"), "recursive"), best(C("is_exported"), "exported"), best((entry == "TestFunction").cast("int"), "test"))


def _parents(c: Catalog) -> DataFrame:
    """(repo_id, child_hash, parent_hash, parent_name): the counting row of each child; of equal ones the least name."""
    raw = c.raw("inheritance").select("repo_id", "child_hash", "parent_hash", "parent_name")
    names = raw.groupBy("repo_id", "child_hash", "parent_hash").agg(F.min("parent_name").alias("parent_name"))
    rows, n = c.inheritance.alias("r"), names.alias("n")
    same = [C(f"r.{k}").eqNullSafe(C(f"n.{k}")) for k in ("repo_id", "child_hash", "parent_hash")]
    return rows.join(n, same[0] & same[1] & same[2]).select("r.repo_id", "r.child_hash", "r.parent_hash", "n.parent_name")


def inheritance_graph(c: Catalog, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): classes that extend others (``limit`` a snapshot, by hash), a stub for each parent not among them, and all links.

    Children that are placeholders or not in the snapshot are left out of the nodes, placeholders out of the edges too.
    A null or empty parent gives an edge but no stub.
    """
    rows = keep(_parents(c).where(is_reference("child_hash")), "links")
    about = c.nodes.select("repo_id", "hash", "name", "module", "file_path", "kind")
    children = about.join(rows.select("repo_id", C("child_hash").alias("hash")).distinct(), ["repo_id", "hash"], "left_semi")
    children = keep(first_rows(children, limit, ["repo_id"], C("hash")).drop("row_no").withColumn("external", F.lit(False)), "children")
    stubs = rows.where(C("parent_hash") != "").groupBy("repo_id", C("parent_hash").alias("hash")).agg(F.min("parent_name").alias("name"))
    stubs = stubs.join(children.select("repo_id", "hash"), ["repo_id", "hash"], "left_anti")
    none = F.lit(None).cast("string")
    stubs = stubs.select("repo_id", "hash", "name", F.lit("external").alias("module"), none.alias("file_path"), F.lit("externalclass").alias("kind"), F.lit(True).alias("external"))
    return children.unionByName(stubs), rows.select("repo_id", C("child_hash").alias("source"), C("parent_hash").alias("target"), "parent_name")


def triage(c: Catalog, modules: list[str] = (), hashes: list[str] = (), limit: int = 5) -> DataFrame:
    """(repo_id, row_no, type, severity, subject, n, detail): what to look at first, ``limit`` a snapshot, high severity before low.

    Up to three symbols called from five other modules or more that aren't declared (by equal module or hash), high from
    eight on; the unstable module with most calls (more than five in, over 0.65 of its calls out; calls to itself count);
    the largest circle across modules; the file with most dead symbols (five or more). Equal severities keep this order.
    """
    undeclared = ~C("hash").isin(list(hashes)) & ~F.coalesce("module", F.lit("")).isin(list(modules))
    called = first_rows(analyses.high_fan_in(c, 5).where(undeclared).withColumnRenamed("row_no", "place"), 3, ["repo_id"], C("place"))
    n = C("calling_module_count")
    one = called.select("repo_id", F.lit(1).alias("step"), C("row_no").alias("at"), F.lit("unexpected_coupling").alias("type"), F.when(n >= 8, "high").otherwise("medium").alias("severity"), C("hash").alias("subject"), n.alias("n"), C("module").alias("detail"))

    role = lambda m, i, o: F.struct(C(m).alias("module"), i.alias("ca"), o.alias("ce"))
    zero = F.lit(0).cast("long")
    count = C("edge_count").cast("long")
    traffic = c.module_edges.select("repo_id", F.explode(F.array(role("callee_module", count, zero), role("caller_module", zero, count))).alias("r")).groupBy("repo_id", "r.module").agg(F.sum("r.ca").alias("ca"), F.sum("r.ce").alias("ce"))
    share = C("ce") / (C("ca") + C("ce"))
    shaky = traffic.where((C("ca") > 5) & (share > 0.65))
    worst = shaky.groupBy("repo_id").agg(F.min(F.struct((-(C("ca") + C("ce"))).alias("t"), "module", F.bround(share, 2).alias("share"))).alias("w"))
    two = worst.select("repo_id", F.lit(2).alias("step"), F.lit(1).alias("at"), F.lit("unstable_module").alias("type"), F.lit("medium").alias("severity"), C("w.module").alias("subject"), (-C("w.t")).alias("n"), C("w.share").cast("string").alias("detail"))

    across = analyses.cycles(c).where("cross_module")
    largest = first_rows(across.withColumnRenamed("row_no", "place"), 1, ["repo_id"], C("size").desc(), C("place"))
    three = largest.select("repo_id", F.lit(3).alias("step"), F.lit(1).alias("at"), F.lit("cross_module_cycle").alias("type"), F.lit("high").alias("severity"), C("scc").alias("subject"), C("size").alias("n"), F.array_join("modules", ", ").alias("detail"))

    files = analyses.dead_files(c, limit=1).where(C("dead") >= 5)
    four = files.select("repo_id", F.lit(4).alias("step"), F.lit(1).alias("at"), F.lit("dead_code_concentration").alias("type"), F.lit("low").alias("severity"), C("file_path").alias("subject"), C("dead").alias("n"), F.bround(C("dead") / C("total") * 100, 0).cast("int").cast("string").alias("detail"))

    every = one.unionByName(two).unionByName(three).unionByName(four).withColumn("n", C("n").cast("long"))
    rank = F.when(C("severity") == "high", 0).when(C("severity") == "medium", 1).otherwise(2)
    return first_rows(every, limit, ["repo_id"], rank, C("step"), C("at")).select("repo_id", "row_no", "type", "severity", "subject", "n", "detail")
