"""Analyses of the code graph: coupling, module graph, dead code, load-bearing symbols, layers, cycles, centrality, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.functions.scalars import has_load_bearing_word, instability, middleman, module_depth, rollup_module, utility
from symgrid.operators import communities, graph, signals
from symgrid.sources.catalog import EXTERNAL_MODULE, Catalog, internal
from symgrid.sources.tables import keep, small

C = F.col
CALLABLE = ["function", "method", "class"]
#: Names, name parts and path parts that speak against deleting a symbol nobody calls.
ENTRYPOINTS = ["main", "setup", "teardown", "configure", "run", "start", "init", "handler", "handle", "on_event", "register", "create_app", "app", "cli", "command", "callback", "entry", "entrypoint", "wsgi", "asgi", "lambda_handler", "index"]
FRAMEWORK_NAMES = ["test_", "Test", "Spec", "Fixture", "conftest", "setUp", "tearDown"]
FRAMEWORK_PATHS = ["test", "spec", "fixture", "conftest", "__init__", "setup.py", "manage.py"]


def first_rows(df: DataFrame, n: int, by: list[str], *order: Column) -> DataFrame:
    """The first n rows of each ``by``; the limit is applied before the shuffle too."""
    return df.withColumn("row_no", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(C("row_no") <= n)


# coupling


def coupling(c: Catalog) -> DataFrame:
    """(repo_id, module, ca, ce, instability) from calls between different modules; 0 for an isolated one."""
    e = c.module_edges.where(C("caller_module") != C("callee_module"))
    sides = e.select("repo_id", C("callee_module").alias("module"), C("edge_count").alias("ca"), F.lit(0).alias("ce")).union(e.select("repo_id", C("caller_module"), F.lit(0), C("edge_count")))
    sums = sides.groupBy("repo_id", "module").agg(F.coalesce(F.sum("ca"), F.lit(0)).alias("ca"), F.coalesce(F.sum("ce"), F.lit(0)).alias("ce"))
    return sums.withColumn("instability", F.bround(instability(C("ca"), C("ce"), 0.0), 3))


def module_stats(c: Catalog) -> DataFrame:
    """Symbols and complexity of each module that has symbols, with its coupling, most coupled first (``row_no``)."""
    s = c.module_stats().join(coupling(c), ["repo_id", "module"], "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    own = ["repo_id", "module", "symbol_count", "total_complexity", F.bround("avg_complexity", 2).alias("avg_complexity")]
    s = s.select(*own, zero("ca"), zero("ce"), F.coalesce("instability", F.lit(0.0)).alias("instability"))
    return s.withColumn("row_no", F.row_number().over(Window.partitionBy("repo_id").orderBy((C("ca") + C("ce")).desc(), "module")))


def heatmap(c: Catalog, top: int = 12) -> DataFrame:
    """(repo_id, caller_module, callee_module, count, ratio, heat): calls among the ``top`` most coupled modules of each snapshot.

    ratio is the share of the greatest count of any two modules, heat 3 above 0.6, 2 above 0.3, 1 above 0, else 0; cells
    without calls are given too.
    """
    chosen = keep(module_stats(c).where(C("row_no") <= top).select("repo_id", "module", "row_no"), "top-modules")
    calls = c.module_edges.groupBy("repo_id", "caller_module", "callee_module").agg(F.sum("edge_count").alias("count"))
    most = calls.groupBy("repo_id").agg(F.greatest(F.max("count"), F.lit(1)).alias("most"))
    a = chosen.select("repo_id", C("module").alias("caller_module"), C("row_no").alias("caller_no"))
    b = chosen.select("repo_id", C("module").alias("callee_module"), C("row_no").alias("callee_no"))
    cells = a.join(b, "repo_id").join(calls, ["repo_id", "caller_module", "callee_module"], "left").join(most, "repo_id", "left")
    count = F.coalesce("count", F.lit(0))
    ratio = count / F.coalesce("most", F.lit(1))
    heat = F.when(ratio > 0.6, 3).when(ratio > 0.3, 2).when(ratio > 0, 1).otherwise(0)
    return cells.select("repo_id", "caller_module", "callee_module", "caller_no", "callee_no", count.alias("count"), F.round(ratio, 6).alias("ratio"), heat.alias("heat"))


def module_graph(c: Catalog, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Modules rolled up to ``depth`` parts, with the deepest depth there is to show (6 at most), and the calls between them."""
    s = c.internal_nodes.where(C("module").isNotNull()).groupBy("repo_id", "module").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("complexity"), F.lit(0)).alias("x"))
    s = s.withColumn("id", rollup_module(C("module"), depth))
    deepest = s.groupBy("repo_id").agg(F.least(F.lit(6), F.coalesce(F.max(module_depth(C("module"))), F.lit(1))).alias("max_depth"))
    nodes = s.groupBy("repo_id", "id").agg(F.sum("n").alias("symbol_count"), F.sum("x").alias("complexity"), F.count_if(C("module") != C("id")).alias("submodule_count"))
    nodes = nodes.where(~C("id").startswith("__"))
    rolled = [rollup_module(C("caller_module"), depth).alias("src"), rollup_module(C("callee_module"), depth).alias("dst")]
    e = c.module_edges.select("repo_id", *rolled, F.coalesce("edge_count", F.lit(0)).alias("n")).groupBy("repo_id", "src", "dst").agg(F.sum("n").alias("count"))
    cross = (C("src") != C("dst")) & ~C("src").startswith("__") & ~C("dst").startswith("__")
    zero = F.lit(0).cast("long")
    role = lambda end, ca, ce, own: F.struct(C(end).alias("id"), ca.alias("ca"), ce.alias("ce"), own.alias("own"))
    roles = F.when(cross, F.array(role("src", zero, C("count"), zero), role("dst", C("count"), zero, zero))).when(C("src") == C("dst"), F.array(role("src", zero, zero, C("count"))))
    sums = e.select("repo_id", F.explode(roles).alias("r")).groupBy("repo_id", "r.id").agg(*[F.sum(f"r.{x}").alias(x) for x in ("ca", "ce", "own")])
    z = lambda x: F.coalesce(x, F.lit(0))
    nodes = nodes.join(sums, ["repo_id", "id"], "left").join(small(deepest), "repo_id")
    nodes = nodes.select("repo_id", "id", "symbol_count", "complexity", "submodule_count", z("ca").alias("afferent"), z("ce").alias("efferent"), z("own").alias("intra_calls"), "max_depth")
    nodes = nodes.withColumn("instability", F.bround(instability(C("afferent"), C("efferent"), 0.5), 3))
    cross_edges = e.where(cross)
    top = cross_edges.groupBy("repo_id").agg(F.max("count").alias("most"))
    valid = nodes.select("repo_id", "id")
    edges = cross_edges.join(small(top), "repo_id").join(valid.withColumnRenamed("id", "src"), ["repo_id", "src"], "left_semi").join(valid.withColumnRenamed("id", "dst"), ["repo_id", "dst"], "left_semi")
    return nodes, edges.select("repo_id", C("src").alias("from"), C("dst").alias("to"), "count", F.bround(C("count") / F.nullif("most", F.lit(0)), 3).alias("weight"))


def module_graph_totals(nodes: DataFrame) -> DataFrame:
    """By snapshot of a module graph: modules, symbols, mean instability and the most coupled module, ties to the least name."""
    best = F.min(F.struct((-(C("afferent") + C("efferent"))).alias("n"), C("id").alias("id")))
    sums = [F.count(F.lit(1)).alias("modules"), F.sum("symbol_count").alias("symbols"), F.round(F.avg("instability"), 2).alias("avg_instability")]
    return nodes.groupBy("repo_id").agg(*sums, best.alias("b")).select("repo_id", "modules", "symbols", "avg_instability", C("b.id").alias("most_coupled"))


def fan_in_modules(c: Catalog) -> DataFrame:
    """(repo_id, hash, s_module, n): edge rows into each hash by the caller's module, before anything is known of the callee.

    A callee with a tenth of all rows is one row for each calling module from here on.
    """
    caller = c.nodes.select("repo_id", C("hash").alias("caller_hash"), C("module").alias("s_module"))
    e = c.edges.join(caller, ["repo_id", "caller_hash"])
    return e.groupBy("repo_id", C("callee_hash").alias("hash"), "s_module").agg(F.count(F.lit(1)).alias("n"))


def calling_modules(c: Catalog) -> DataFrame:
    """(repo_id, hash, modules): distinct other modules, the external one left out, that call each internal symbol."""
    into = fan_in_modules(c).where(C("s_module") != EXTERNAL_MODULE)
    callee = c.internal_nodes.select("repo_id", "hash", "module")
    other = into.join(callee, ["repo_id", "hash"]).where(C("s_module") != C("module"))
    return other.groupBy("repo_id", "hash").agg(F.count(F.lit(1)).alias("modules"))


def high_fan_in(c: Catalog, least_modules: int = 3, limit: int = 100) -> DataFrame:
    """Internal symbols called from at least so many other modules, those of most modules first, ``limit`` a snapshot."""
    found = calling_modules(c).where(C("modules") >= least_modules).withColumnRenamed("modules", "calling_module_count")
    details = ["name", "module", "file_path", "caller_count", "callee_count", "risk"]
    rows = found.join(c.internal_nodes.select("repo_id", "hash", *details), ["repo_id", "hash"])
    order = [C("calling_module_count").desc(), C("caller_count").desc_nulls_last(), C("hash")]
    return first_rows(rows, limit, ["repo_id"], *order).select("repo_id", "row_no", "hash", *details, "calling_module_count")


def edge_details(c: Catalog, caller_module: str, callee_module: str, limit: int = 50) -> DataFrame:
    """Calls between the symbols of two modules, most calls first, a missing call count as 1."""
    side = lambda p, m: c.internal_nodes.where(C("module") == m).select("repo_id", C("hash").alias(f"{p}_hash"), C("name").alias(f"{p}_name"), C("file_path").alias(f"{p}_file"))
    e = c.edges.join(side("caller", caller_module), ["repo_id", "caller_hash"]).join(side("callee", callee_module), ["repo_id", "callee_hash"])
    e = e.withColumn("call_count", F.coalesce("call_count", F.lit(1)))
    rows = first_rows(e, limit, ["repo_id"], C("call_count").desc(), C("caller_hash"), C("callee_hash"))
    return rows.select("repo_id", "row_no", "caller_name", "caller_hash", "caller_file", "callee_name", "callee_hash", "callee_file", "call_count")


def declaration(modules: list[str], hashes: list[str], otherwise: str) -> Column:
    """explicit for a named hash or a module that holds a named one's text, auto for a module with a telling word."""
    low = F.lower(F.coalesce("module", F.lit("")))
    explicit = C("hash").isin(list(hashes))
    for m in modules:
        explicit |= low.contains(m)
    return F.when(explicit, "explicit").when(has_load_bearing_word(C("module")), "auto").otherwise(otherwise)


def load_bearing(c: Catalog, modules: list[str] = (), hashes: list[str] = (), least_modules: int = 3) -> DataFrame:
    """High fan-in symbols with a declaration: explicit, auto or unexpected."""
    return high_fan_in(c, least_modules).withColumn("declaration", declaration(modules, hashes, "unexpected"))


# dead code, layers


def dead_candidates(c: Catalog) -> DataFrame:
    return c.internal_nodes.where((C("caller_count") == 0) & C("kind").isin(CALLABLE))


def dead_code(c: Catalog, limit: int | None = None) -> DataFrame:
    """Symbols without callers and how surely they are unused: safe, review or caution.

    With a limit, that many of each snapshot, the most complex first, then by name and hash.
    """
    name, path = F.coalesce("name", F.lit("")), F.lower(F.coalesce("file_path", F.lit("")))
    caution = F.lower(name).isin(ENTRYPOINTS) | (C("kind") == "class")
    for p in FRAMEWORK_NAMES:
        caution |= name.startswith(p) | name.endswith(p)
    for p in FRAMEWORK_PATHS:
        caution |= path.contains(p)
    tier = F.when(caution, "caution").when(name.startswith("_") & (F.coalesce("complexity", F.lit(0)) <= 8), "safe").otherwise("review")
    rows = dead_candidates(c)
    if limit is not None:
        rows = first_rows(rows, limit, ["repo_id"], C("complexity").desc_nulls_last(), C("name").asc_nulls_first(), C("hash"))
    return rows.select("repo_id", "hash", "name", "module", "file_path", "kind", "complexity", "line_start", "line_end", tier.alias("confidence"))


def _tiers() -> list[Column]:
    lines = F.coalesce(F.when(C("line_end") != 0, C("line_end")), "line_start", F.lit(0)) - F.coalesce("line_start", F.lit(0))
    return [F.count(F.lit(1)).alias("dead"), *[F.count_if(C("confidence") == t).alias(t) for t in ("safe", "review", "caution")], F.sum(lines).alias("lines")]


def dead_summary(c: Catalog) -> DataFrame:
    """By snapshot: dead symbols by tier, their lines, and their share of all internal symbols."""
    every = c.internal_nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total"))
    tiers = dead_code(c).groupBy("repo_id").agg(*_tiers())
    return every.join(tiers, "repo_id", "left").na.fill(0).withColumn("dead_ratio", F.round(C("dead") / C("total"), 6))


def dead_by_file(c: Catalog, limit: int | None = None) -> DataFrame:
    """By file (null as unknown): dead symbols by tier, files with most of them first (``row_no``)."""
    f = dead_code(c, limit).groupBy("repo_id", F.coalesce(F.nullif("file_path", F.lit("")), F.lit("unknown")).alias("file")).agg(*_tiers())
    return f.withColumn("row_no", F.row_number().over(Window.partitionBy("repo_id").orderBy(C("dead").desc(), "file")))


def dead_files(c: Catalog, least: int = 5, share: float = 0.6, limit: int = 5) -> DataFrame:
    """Files with at least ``least`` callable symbols of which ``share`` are dead; of each snapshot the ``limit`` with most dead ones."""
    rows = c.internal_nodes.where(C("kind").isin(CALLABLE) & C("file_path").isNotNull())
    f = rows.groupBy("repo_id", "file_path").agg(F.count(F.lit(1)).alias("total"), F.count_if(C("caller_count") == 0).alias("dead"))
    return first_rows(f.where((C("total") >= least) & (C("dead") / C("total") >= share)), limit, ["repo_id"], C("dead").desc(), C("file_path"))


def layer(share: Column) -> Column:
    """0 (foundation) to 4 (leaves) by a share of the greatest number of callers."""
    return F.when(share > 0.6, 0).when(share > 0.3, 1).when(share > 0.1, 2).when(share > 0.02, 3).otherwise(4)


def building(c: Catalog, n: int = 120, modules: list[str] = (), hashes: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the n most called symbols of each snapshot in five layers, and the edge rows between them.

    nodes have their declaration (explicit, auto, none) and the number of other modules that call them.
    """
    fields = ["name", "module", "file_path", "caller_count", "callee_count", "complexity", "risk"]
    top = keep(c.scan(fields, None, [C("caller_count").desc_nulls_last()], n), "building")
    most = F.nullif(F.max("caller_count").over(Window.partitionBy("repo_id")), F.lit(0))  # at most n rows a snapshot
    nodes = top.withColumns({"layer": layer(F.coalesce(C("caller_count") / most, F.lit(0.0))), "declaration": declaration(modules, hashes, "none")})
    called = calling_modules(c).withColumnRenamed("modules", "calling_module_count")
    nodes = nodes.withColumn("is_load_bearing", C("declaration") != "none").join(called, ["repo_id", "hash"], "left")
    nodes = nodes.withColumn("calling_module_count", F.coalesce("calling_module_count", F.lit(0)))
    return nodes, c.edges_within(top).select("repo_id", C("caller_hash").alias("source"), C("callee_hash").alias("target"))


def layer_totals(nodes: DataFrame) -> DataFrame:
    """By snapshot of a building: load-bearing symbols, undeclared ones called from three modules or more, symbols of each layer."""
    undeclared = ~C("is_load_bearing") & (C("calling_module_count") >= 3)
    layers = [F.count_if(C("layer") == i).alias(f"layer_{i}") for i in range(5)]
    return nodes.groupBy("repo_id").agg(F.count_if("is_load_bearing").alias("load_bearing"), F.count_if(undeclared).alias("undeclared"), *layers)


def building_places(nodes: DataFrame, edges: DataFrame, width: float = 1000.0, padding: float = 40.0) -> DataFrame:
    """(repo_id, hash, layer, place, x): where each symbol of a building stands in its layer.

    From the leaves down: a symbol stands below the mean x of its callers in higher layers, else in its module's lane;
    places within a layer are then evened out. Near ties put load-bearing symbols first, then those with most callers.
    Mean positions are compared in steps of 1.
    """
    lanes = nodes.select("repo_id", F.coalesce("module", F.lit("")).alias("lane_of")).distinct()
    per = Window.partitionBy("repo_id")
    lane = F.when(F.count(F.lit(1)).over(per) > 1, (F.row_number().over(per.orderBy("lane_of")) - 1) / (F.count(F.lit(1)).over(per) - 1)).otherwise(0.5)
    n = keep(nodes.withColumn("lane_of", F.coalesce("module", F.lit(""))).join(lanes.withColumn("lane", lane), ["repo_id", "lane_of"]), "places")
    edges, placed = keep(edges.distinct(), "places"), None
    for at in (4, 3, 2, 1, 0):
        rows = n.where(C("layer") == at)
        if placed is not None:
            callers = edges.join(placed.select("repo_id", C("hash").alias("source"), "x"), ["repo_id", "source"])
            rows = rows.join(callers.groupBy("repo_id", C("target").alias("hash")).agg(F.avg("x").alias("pull")), ["repo_id", "hash"], "left")
        else:
            rows = rows.withColumn("pull", F.lit(None).cast("double"))
        w = Window.partitionBy("repo_id")
        score = F.round(F.coalesce("pull", padding + C("lane") * width))
        place = F.row_number().over(w.orderBy(score, C("is_load_bearing").desc(), C("caller_count").desc_nulls_last(), "hash"))
        step = width / F.count(F.lit(1)).over(w)
        here = rows.select("repo_id", "hash", "layer", place.alias("place"), F.round(padding + (place - 0.5) * step, 6).alias("x"))
        placed = keep(here if placed is None else placed.unionByName(here), "places")
    return placed


# graph analyses


def blast_radius(c: Catalog, targets: DataFrame, hops: int = 5) -> DataFrame:
    """(repo_id, hash, depth): symbols that reach a target within so many calls, targets themselves left out."""
    return graph.bfs(c.edges_distinct, targets.select("repo_id", C("hash").alias("node")), hops, upstream=True).where(C("depth") > 0).withColumnRenamed("node", "hash")


def blast_rollups(c: Catalog, radius: DataFrame) -> DataFrame:
    """(repo_id, grain, key, n): affected symbols by depth and by module (null modules left out)."""
    rows = radius.join(c.internal_nodes.select("repo_id", "hash", "module"), ["repo_id", "hash"])
    keys = F.array(F.struct(F.lit("depth").alias("grain"), C("depth").cast("string").alias("key")), F.struct(F.lit("module").alias("grain"), C("module").alias("key")))
    return rows.select("repo_id", F.explode(keys).alias("k")).where(C("k.key").isNotNull()).groupBy("repo_id", "k.grain", "k.key").agg(F.count(F.lit(1)).alias("n"))


def centrality(c: Catalog, n: int = 30, exact: int = 2000) -> DataFrame:
    """The n most central symbols of each snapshot, ties by hash: betweenness, above ``exact`` symbols callers / most callers.

    Betweenness is that of the distinct calls between internal symbols; equal scores are compared at 6 digits.
    """
    e, nodes = keep(c.edges_distinct, "edges"), keep(c.internal_nodes.select("repo_id", C("hash").alias("node")), "nodes")
    size = nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("k"))
    large, few = keep(size.where(C("k") > exact).select("repo_id"), "large"), lambda df: df.join(small(large), "repo_id", "left_anti")
    score = graph.betweenness(few(e), few(nodes), exact=exact)
    called = e.join(small(large), "repo_id", "left_semi").groupBy("repo_id", C("dst").alias("node")).agg(F.count(F.lit(1)).alias("in"))
    most = called.groupBy("repo_id").agg(F.max("in").alias("most"))
    degree = nodes.join(small(large), "repo_id", "left_semi").join(called, ["repo_id", "node"], "left").join(most, "repo_id", "left")
    degree = degree.select("repo_id", "node", F.round(F.coalesce(C("in") / C("most"), F.lit(0.0)), 6).alias("score"))
    rows = first_rows(score.unionByName(degree), n, ["repo_id"], C("score").desc(), C("node"))
    about = c.internal_nodes.select("repo_id", C("hash").alias("node"), "name", "module", "file_path", "caller_count", "callee_count", "risk")
    return rows.join(about, ["repo_id", "node"]).select("repo_id", "row_no", C("node").alias("hash"), "name", "module", "file_path", "caller_count", "callee_count", "risk", F.bround("score", 4).alias("centrality"))


def cycles(c: Catalog, limit: int = 20) -> DataFrame:
    """The ``limit`` largest components of more than one symbol of each snapshot, equal ones by their least hash.

    size, the modules in it (null is none), whether there are several, its symbols, and the call with the least count,
    ties to the least hashes, to break it. Repeated edges count with the least of their counts, a null count as 1.
    """
    parts = keep(graph.scc(c.edges_distinct), "scc")
    sizes = parts.groupBy("repo_id", "scc").agg(F.count(F.lit(1)).alias("size")).where(C("size") > 1)
    largest = keep(first_rows(sizes, limit, ["repo_id"], C("size").desc(), C("scc")), "largest")
    sized = keep(parts.join(largest, ["repo_id", "scc"]).join(c.internal_nodes.select("repo_id", C("hash").alias("node"), "module"), ["repo_id", "node"]), "cycles")
    of = lambda a: sized.select("repo_id", C("node").alias(a), C("scc").alias(f"s_{a}"))
    inner = c.edges.join(of("caller_hash"), ["repo_id", "caller_hash"]).join(of("callee_hash"), ["repo_id", "callee_hash"])
    inner = inner.where((C("s_caller_hash") == C("s_callee_hash")) & (C("caller_hash") != C("callee_hash")))
    call = F.struct(F.coalesce("call_count", F.lit(1)).alias("n"), "caller_hash", "callee_hash")
    weakest = inner.groupBy("repo_id", C("s_caller_hash").alias("scc")).agg(F.min(call).alias("w"))
    group = sized.groupBy("repo_id", "scc", "row_no", "size").agg(
        F.array_sort(F.collect_set(F.when(C("module") != "", C("module")))).alias("modules"),
        F.array_sort(F.collect_list("node")).alias("nodes"),
    )
    found = group.join(weakest, ["repo_id", "scc"], "left").withColumn("cross_module", F.size("modules") > 1)
    broken = [C("w.caller_hash").alias("break_caller"), C("w.callee_hash").alias("break_callee"), C("w.n").alias("break_calls")]
    return found.select("repo_id", "row_no", "scc", "size", "cross_module", "modules", "nodes", *broken)


def cycle_totals(report: DataFrame) -> DataFrame:
    """By snapshot of a cycle report: cycles, symbols in them, those of more than five symbols, those across modules."""
    totals = [F.count(F.lit(1)).alias("cycles"), F.sum("size").alias("symbols"), F.count_if(C("size") > 5).alias("large"), F.count_if("cross_module").alias("cross_module")]
    return report.groupBy("repo_id").agg(*totals)


# enrichment


def boundary_signals(c: Catalog) -> DataFrame:
    """Of each internal symbol: module fan-in and fan-out, share of calls that leave the module, dominant callee module, stability.

    Fan-in and fan-out count distinct other modules, the external one left out. The share counts edge rows to internal
    symbols; a null module is never another one. The dominant module is that of most callees with a module (ties to the
    least), its share is of these. Stability is out / (in + out), 0.5 for neither.
    """
    callee = c.internal_nodes.select("repo_id", C("hash").alias("callee_hash"), C("module").alias("t_module"))
    rows = c.edges.where(internal("callee_hash")).join(callee, ["repo_id", "callee_hash"]).groupBy("repo_id", C("caller_hash").alias("hash"), "t_module").agg(F.count(F.lit(1)).alias("n"))
    known = C("t_module") != EXTERNAL_MODULE
    leaves = known & (C("t_module") != C("module"))
    one = F.struct((-C("n")).alias("n"), C("t_module").alias("m"))
    own = c.internal_nodes.select("repo_id", "hash", "module")
    out = rows.join(own, ["repo_id", "hash"]).groupBy("repo_id", "hash").agg(
        F.count_if(leaves).alias("xmod_fan_out"),
        F.sum(F.when(leaves, C("n")).otherwise(0)).alias("crossing"),
        F.sum("n").alias("all"),
        F.sum(F.when(known, C("n"))).alias("known"),
        F.min(F.when(known, one)).alias("d"),
    )
    every = own.select("repo_id", "hash").join(calling_modules(c), ["repo_id", "hash"], "left").join(out, ["repo_id", "hash"], "left")
    fan_in, fan_out = F.coalesce("modules", F.lit(0)), F.coalesce("xmod_fan_out", F.lit(0))
    return every.select(
        "repo_id",
        "hash",
        fan_in.alias("xmod_fan_in"),
        fan_out.alias("xmod_fan_out"),
        F.coalesce(F.round(C("crossing") / C("all"), 4), F.lit(0.0)).alias("xmod_call_ratio"),
        C("d.m").alias("dominant_callee_mod"),
        F.coalesce(F.round(-C("d.n") / C("known"), 4), F.lit(0.0)).alias("dominant_callee_frac"),
        F.round(instability(fan_in, fan_out, 0.5), 4).alias("stability_rank"),
    )


def complexity_rank(c: Catalog) -> DataFrame:
    """rank / n of complexity within a snapshot, null as 0; values are counted before they are ranked."""
    v = c.internal_nodes.select("repo_id", "hash", F.coalesce("complexity", F.lit(0)).alias("v"))
    freq = v.groupBy("repo_id", "v").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("repo_id")
    freq = freq.select("repo_id", "v", F.round((F.sum("k").over(w.orderBy("v")) - C("k") + 1) / F.sum("k").over(w), 4).alias("complexity_pct"))
    return v.join(freq, ["repo_id", "v"]).select("repo_id", "hash", "complexity_pct")


def simple_signals(c: Catalog) -> DataFrame:
    """How much each internal symbol only passes calls on."""
    x, y = F.coalesce("caller_count", F.lit(0)), F.coalesce("callee_count", F.lit(0))
    return c.internal_nodes.select("repo_id", "hash", F.round(middleman(C("complexity"), x, y), 4).alias("middleman_score"))


def enrich(c: Catalog, pivots: int = 500) -> DataFrame:
    """One row for each internal symbol with its signals; defaults where a symbol has no edges."""
    c = c.kept()
    e, nodes = c.edges_distinct, c.internal_nodes.select("repo_id", C("hash").alias("node"))
    key = ["repo_id", "node"]
    mods = c.internal_nodes.select("repo_id", C("hash").alias("node"), "module")
    own = keep(signals.signals(e, nodes, pivots).join(mods, key), "signals")
    # a null module is one of its own here
    several = F.count_distinct(F.coalesce(F.concat(F.lit("m"), "module"), F.lit(""))) > 1
    size = own.groupBy("repo_id", "scc").agg(F.count(F.lit(1)).alias("scc_size"), several.cast("int").alias("scc_cross_module"))
    tri = graph.clustering(e).select(*key, C("coefficient").alias("clustering_coeff"))
    home = communities.dominant(own.select(*key, "community"), mods).select("repo_id", "community", C("dominant").alias("community_dominant_mod"))
    rows = own.join(size, ["repo_id", "scc"]).join(tri, key, "left").join(home, ["repo_id", "community"])
    names = {"rank": "pagerank", "hub": "hub_score", "authority": "authority_score", "score": "betweenness_centrality"}
    rows = rows.withColumns({x: F.round(x, 6) for x in names}).withColumnsRenamed(names)
    rows = rows.withColumns({f"transitive_{x}": C(x) - 1 for x in ("callers", "callees")}).drop("callers", "callees")
    rows = rows.withColumnRenamed("node", "hash")
    for more in (boundary_signals(c), complexity_rank(c), simple_signals(c)):
        rows = rows.join(more, ["repo_id", "hash"])
    more = {
        "clustering_coeff": F.coalesce("clustering_coeff", F.lit(0.0)),
        "utility_score": F.round(utility(C("transitive_callers"), C("xmod_fan_in")), 4),
        "community_alignment": C("module").eqNullSafe(C("community_dominant_mod")).cast("int"),
    }
    return rows.withColumns(more).drop("module")


def enrich_to(c: Catalog, path: str) -> dict[str, str]:
    """Writes the features of all snapshots below ``path``, one folder a snapshot.

    All are computed together; should that fail, each is tried by itself. Returns the messages of those that failed.
    """
    try:
        c.write_features(enrich(c), path)
        return {}
    except Exception:
        failed = {}
    # the list of snapshots, not their rows
    for r in c.raw("nodes").select("repo_id").where(C("repo_id").isNotNull()).distinct().toLocalIterator():
        try:
            one = type(c)(c.spark, c.folder, r.repo_id)
            one.write_features(enrich(one), path)
        except Exception as e:
            failed[r.repo_id] = str(e).splitlines()[0]
    return failed
