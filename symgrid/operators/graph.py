"""Graph algorithms on edge tables. Edges are (repo_id, src, dst), distinct unless said otherwise; all snapshots at once.

A snapshot of up to ``symgrid.operators.local.LARGEST`` edges is brought to one task, which treats it in memory; larger
ones are treated by rounds of joins (``…_by_joins``), with the same results. Rounds write their state to the shared
folder, so a lost executor costs one round and plans stay short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.operators import hierarchy, local
from symgrid.sources.tables import Pile, keep

C = F.col
_KEY = ["repo_id", "node"]


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select("repo_id", C("src").alias("node")).union(edges.select("repo_id", C("dst").alias("node"))).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select("repo_id", C("dst").alias("src"), C("src").alias("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """(repo_id, node, in_degree, out_degree) of rows of edges, repetitions counted."""
    ends = edges.select("repo_id", C("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("repo_id", C("dst").alias("node"), F.lit(1), F.lit(0)))
    return ends.groupBy(*_KEY).agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def bfs(edges: DataFrame, seeds: DataFrame, hops: int, upstream: bool = False, by: list[str] | None = None) -> DataFrame:
    """(repo_id, by…, node, depth): least number of edges from a seed (repo_id, by…, node), seeds at 0, up to ``hops``.

    Seeds with different ``by`` are walked from apart.
    """
    step = (reverse(edges) if upstream else edges).select("repo_id", C("src").alias("node"), "dst")
    key = ["repo_id", *(by or []), "node"]
    seen = Pile("bfs")
    frontier = seen.add(seeds.select(*key).distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, hops + 1):
        reached = frontier.join(step, _KEY).select("repo_id", *(by or []), C("dst").alias("node")).distinct()
        frontier = seen.add(reached.join(seen.all(), key, "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            break
    return seen.all()


def bfs_both(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(repo_id, node, depth): the smaller distance of callers and callees of the seeds."""
    both = bfs(edges, seeds, hops).unionByName(bfs(edges, seeds, hops, upstream=True))
    return both.groupBy(*_KEY).agg(F.min("depth").alias("depth"))


def chain_edges(edges: DataFrame, chosen: DataFrame, hops: int) -> DataFrame:
    """(repo_id, src, dst, length): edges on shortest-way chains between two of the chosen nodes (repo_id, node), and the least length of a chain.

    Of a pair S, T an edge u, v counts if v is farther from S than u, nearer to T, if the distances and the edge sum up to
    ``hops`` at most, and if u is reached from S and T from v over such edges only. A snapshot with fewer than two chosen
    nodes gives no rows.
    """
    edges = keep(edges.select("repo_id", "src", "dst").distinct(), "edges")
    ends = keep(chosen.select("repo_id", "node").distinct(), "chosen")
    out = bfs(edges, ends.withColumn("s", C("node")), hops, by=["s"])
    back = bfs(edges, ends.withColumn("t", C("node")), hops, upstream=True, by=["t"])
    far = lambda df, who, end, name: df.select("repo_id", who, C("node").alias(end), C("depth").alias(name))
    from_s = edges.join(far(out, "s", "src", "su"), ["repo_id", "src"]).join(far(out, "s", "dst", "sv"), ["repo_id", "s", "dst"]).where(C("sv") > C("su"))
    to_t = edges.join(far(back, "t", "dst", "tv"), ["repo_id", "dst"]).join(far(back, "t", "src", "tu"), ["repo_id", "t", "src"]).where(C("tu") > C("tv"))
    step = from_s.join(to_t, ["repo_id", "src", "dst"]).where((C("s") != C("t")) & (C("su") + 1 + C("tv") <= hops))
    step = keep(step.select("repo_id", "s", "t", "src", "dst", (C("su") + 1 + C("tv")).alias("length")), "steps")
    pair = ["repo_id", "s", "t"]

    def reached(start: str, a: str, b: str) -> DataFrame:
        seen = Pile("reached")
        front = seen.add(step.select(*pair).distinct().withColumn("node", C(start)))
        while front.limit(1).count():
            more = front.join(step.select(*pair, C(a).alias("node"), C(b).alias("next")), [*pair, "node"]).select(*pair, C("next").alias("node")).distinct()
            front = seen.add(more.join(seen.all(), [*pair, "node"], "left_anti"))
        return seen.all()

    ahead, behind = reached("s", "src", "dst"), reached("t", "dst", "src")
    whole = ahead.where(C("node") == C("t")).select(*pair)
    on = step.join(whole, pair, "left_semi").join(ahead.withColumnRenamed("node", "src"), [*pair, "src"], "left_semi").join(behind.withColumnRenamed("node", "dst"), [*pair, "dst"], "left_semi")
    return on.groupBy("repo_id", "src", "dst").agg(F.min("length").alias("length"))


def scc_by_joins(edges: DataFrame) -> DataFrame:
    """(repo_id, node, scc): strongly connected components of the nodes of the edges; scc is the least hash in it.

    Nodes without a way in or a way out are trimmed again and again; of the rest, the greatest hash that reaches a node
    colours it, and what reaches a colour's own node inside the colour is its component.
    """
    everyone = keep(nodes_of(edges), "nodes")
    e = keep(edges.where(C("src") != C("dst")).select("repo_id", "src", "dst").distinct(), "scc")
    done = None
    while True:
        size = e.count()
        while size:  # trim
            starts, ends = e.select("repo_id", C("src").alias("x")).distinct(), e.select("repo_id", C("dst").alias("x")).distinct()
            trimmed = e.join(starts.withColumnRenamed("x", "dst"), ["repo_id", "dst"], "left_semi").join(ends.withColumnRenamed("x", "src"), ["repo_id", "src"], "left_semi").select("repo_id", "src", "dst")
            e = keep(trimmed, "scc")
            if (now := e.count()) == size:
                break
            size = now
        if not size:
            break
        colour = keep(nodes_of(e).withColumn("c", C("node")), "colour")
        while True:  # greatest hash that reaches each node, with the jump to the colour's own colour
            got = e.join(colour.select("repo_id", C("node").alias("src"), "c"), ["repo_id", "src"]).groupBy("repo_id", C("dst").alias("node")).agg(F.max("c").alias("g"))
            new = colour.join(got, _KEY, "left").select(*_KEY, F.greatest("c", "g").alias("c"), (C("g") > C("c")).alias("moved"))
            new = keep(new, "colour")
            colour = new.select(*_KEY, "c")
            if not new.where("moved").limit(1).count():
                break
        inside = e.join(colour.select("repo_id", C("node").alias("src"), C("c").alias("cs")), ["repo_id", "src"]).join(colour.select("repo_id", C("node").alias("dst"), C("c").alias("cd")), ["repo_id", "dst"]).where(C("cs") == C("cd")).select("repo_id", "src", "dst")
        inside = keep(inside, "inside")
        back = bfs(inside, colour.where(C("node") == C("c")), 1 << 30, upstream=True).select(*_KEY)
        part = keep(back.join(colour, _KEY), "part")
        done = part if done is None else done.unionByName(part)
        gone = part.select(*_KEY)
        e = keep(e.join(gone.withColumnRenamed("node", "src"), ["repo_id", "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), ["repo_id", "dst"], "left_anti").select("repo_id", "src", "dst"), "scc")
    if done is None:
        return everyone.withColumn("scc", C("node"))
    named = done.join(done.groupBy("repo_id", "c").agg(F.min("node").alias("scc")), ["repo_id", "c"]).select(*_KEY, "scc")
    return everyone.join(named, _KEY, "left").select(*_KEY, F.coalesce("scc", "node").alias("scc"))


def condense(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct edges between different components."""
    of = lambda a: components.select("repo_id", C("node").alias(a), C("scc").alias(f"s_{a}"))
    e = edges.join(of("src"), ["repo_id", "src"]).join(of("dst"), ["repo_id", "dst"])
    return e.where(C("s_src") != C("s_dst")).select("repo_id", C("s_src").alias("src"), C("s_dst").alias("dst")).distinct()


def longest_depth_by_joins(dag: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_id, node, depth): longest path from a node without incoming edges. dag must have no cycles."""
    state = keep(nodes.select(*_KEY).withColumn("depth", F.lit(0)), "depth")
    moved = state
    while True:
        # only nodes that moved in the last round push on
        up = moved.join(dag.withColumnRenamed("src", "node"), _KEY).groupBy("repo_id", C("dst").alias("node")).agg((F.max("depth") + 1).alias("d"))
        new = keep(state.join(up, _KEY, "left").select(*_KEY, F.greatest("depth", "d").alias("depth"), (C("d") > C("depth")).alias("up")), "depth")
        state, moved = new.select(*_KEY, "depth"), new.where("up").select(*_KEY, "depth")
        if not moved.limit(1).count():
            return state


def path_counts_by_joins(dag: DataFrame, sizes: DataFrame) -> DataFrame:
    """(repo_id, node, n): size of a component plus the counts of its successors, so a diamond counts twice.

    sizes: (repo_id, node, size). Counts are doubles, since ways multiply with depth. A level joins the edges that begin
    in it with the counts so far and writes its own counts only.
    """
    level = keep(longest_depth_by_joins(reverse(dag), sizes.select(*_KEY)), "levels")
    base = keep(sizes.join(level, _KEY).select(*_KEY, C("size").cast("double").alias("size"), "depth"), "base")
    steps = keep(dag.join(level.withColumnRenamed("node", "src"), ["repo_id", "src"]).select("repo_id", "src", "dst", "depth"), "steps")
    deepest = base.agg(F.max("depth")).first()[0] or 0
    counts = Pile("paths")
    counts.add(base.where(C("depth") == 0).select(*_KEY, C("size").alias("n")))
    for d in range(1, deepest + 1):
        known = counts.all().withColumnRenamed("node", "dst")
        below = steps.where(C("depth") == d).join(known, ["repo_id", "dst"]).groupBy("repo_id", C("src").alias("node")).agg(F.sum("n").alias("s"))
        counts.add(base.where(C("depth") == d).join(below, _KEY).select(*_KEY, (C("size") + C("s")).alias("n")))
    return counts.all()


def reach_counts_by_joins(dag: DataFrame, sizes: DataFrame) -> DataFrame:
    """(repo_id, node, n): summed size of the distinct nodes that a node reaches, itself included."""
    step = keep(dag.select("repo_id", "src", "dst"), "dag")
    reach = bfs(step, sizes.select("repo_id", C("node").alias("from"), "node"), 1 << 30, by=["from"])
    return reach.join(sizes, _KEY).groupBy("repo_id", C("from").alias("node")).agg(F.sum(C("size").cast("double")).alias("n"))


def _ended(new: DataFrame, change: Column, tolerance: float) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of the snapshots whose change (an aggregate) is below the tolerance, and of the others; None for no snapshot. One row a large snapshot is collected."""
    state = {True: [], False: []}
    for r in new.groupBy("repo_id").agg((change < tolerance).alias("ended")).collect():
        state[r.ended].append(r.repo_id)
    part = lambda ended: None if not state[ended] else new if not state[not ended] else new.where(C("repo_id").isin(state[ended]))
    return part(True), part(False)


def _with(done: DataFrame | None, more: DataFrame | None) -> DataFrame | None:
    return done if more is None else more if done is None else done.unionByName(more)


def pagerank_by_joins(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = local.ROUNDS, tolerance: float = local.RANK_TOLERANCE) -> DataFrame:
    """(repo_id, node, rank): sums to 1 in each snapshot; nodes without outgoing edges give to all; a snapshot ends when its mean change is below the tolerance."""
    size = nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    out = edges.groupBy("repo_id", C("src").alias("node")).agg(F.count(F.lit(1)).alias("o"))
    base = keep(nodes.join(size, "repo_id").join(out, _KEY, "left").select(*_KEY, "n", "o"), "rank-base")
    weighted = keep(edges.join(base.select("repo_id", C("node").alias("src"), "o"), ["repo_id", "src"]).select("repo_id", "src", "dst"), "rank-edges")
    rank, done = base.select(*_KEY, "n", "o", (1 / C("n")).alias("rank")), None
    for _ in range(rounds):
        got = weighted.join(rank.select("repo_id", C("node").alias("src"), "rank", "o"), ["repo_id", "src"]).groupBy("repo_id", C("dst").alias("node")).agg(F.sum(C("rank") / C("o")).alias("in"))
        loose = rank.groupBy("repo_id").agg(F.coalesce(F.sum(F.when(C("o").isNull(), C("rank"))), F.lit(0.0)).alias("loose"))
        new = rank.join(got, _KEY, "left").join(loose, "repo_id").select(*_KEY, "n", "o", ((1 - damping) / C("n") + damping * (F.coalesce("in", F.lit(0.0)) + C("loose") / C("n"))).alias("rank"), C("rank").alias("old"))
        ended, rank = _ended(keep(new, "rank"), F.sum(F.abs(C("rank") - C("old"))) / F.max("n"), tolerance)
        done = _with(done, ended)
        if rank is None:
            break
        rank = rank.drop("old")
    return _with(done.drop("old") if done is not None else None, rank).select(*_KEY, "rank")


def hits_by_joins(edges: DataFrame, nodes: DataFrame, rounds: int = local.ROUNDS, tolerance: float = local.HUB_TOLERANCE) -> DataFrame:
    """(repo_id, node, hub, authority): power iteration, each summing to 1; zeros in a snapshot without edges. A snapshot ends when no hub changes by the tolerance."""
    total = lambda df, c: df.join(df.groupBy("repo_id").agg(F.sum(c).alias("t")), "repo_id").withColumn(c, F.coalesce(C(c) / F.nullif("t", F.lit(0.0)), F.lit(0.0))).drop("t")
    hub, done = keep(total(nodes.select(*_KEY).withColumn("hub", F.lit(1.0)), "hub"), "hits"), None
    for _ in range(rounds):
        auth = total(edges.join(hub.select("repo_id", C("node").alias("src"), "hub"), ["repo_id", "src"]).groupBy("repo_id", C("dst").alias("node")).agg(F.sum("hub").alias("authority")), "authority")
        auth = keep(auth, "authority")
        back = edges.join(auth.select("repo_id", C("node").alias("dst"), "authority"), ["repo_id", "dst"]).groupBy("repo_id", C("src").alias("node")).agg(F.sum("authority").alias("h"))
        new = total(hub.select(*_KEY, C("hub").alias("old")).join(back, _KEY, "left").select(*_KEY, "old", F.coalesce("h", F.lit(0.0)).alias("hub")), "hub")
        new = keep(new.join(auth, _KEY, "left").select(*_KEY, "old", "hub", F.coalesce("authority", F.lit(0.0)).alias("authority")), "hits")
        ended, hub = _ended(new, F.max(F.abs(C("hub") - C("old"))), tolerance)
        done = _with(done, ended)
        if hub is None:
            break
    return _with(done, hub).select(*_KEY, "hub", "authority")


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct pairs u < v without loops."""
    return edges.where(C("src") != C("dst")).select("repo_id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def clustering(edges: DataFrame) -> DataFrame:
    """(repo_id, node, triangles, degree, coefficient) on the undirected graph; 0 below two neighbours.

    Each edge is listed at its end of lower degree only, so a hub doesn't list the pairs of its neighbours.
    """
    pairs = keep(undirected(edges), "pairs")
    ends = pairs.select("repo_id", C("u").alias("node")).union(pairs.select("repo_id", C("v").alias("node")))
    deg = keep(ends.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("degree")), "degrees")
    d = lambda a: deg.select("repo_id", C("node").alias(a), C("degree").alias(f"d{a}"))
    both = pairs.join(d("u"), ["repo_id", "u"]).join(d("v"), ["repo_id", "v"])
    first = (C("du") < C("dv")) | ((C("du") == C("dv")) & (C("u") < C("v")))
    low = both.select("repo_id", F.when(first, C("u")).otherwise(C("v")).alias("a"), F.when(first, C("v")).otherwise(C("u")).alias("b"))
    wedges = low.join(low.withColumnRenamed("b", "c"), ["repo_id", "a"]).where(C("b") < C("c"))
    closed = wedges.join(pairs.select("repo_id", C("u").alias("b"), C("v").alias("c")), ["repo_id", "b", "c"])
    t = closed.select("repo_id", F.explode(F.array("a", "b", "c")).alias("node")).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("triangles"))
    found = deg.join(t, _KEY, "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    return found.withColumn("coefficient", F.round(F.when(C("degree") > 1, 2 * C("triangles") / (C("degree") * (C("degree") - 1))).otherwise(0.0), 4))


def betweenness_by_joins(edges: DataFrame, nodes: DataFrame, pivots: int = 500, exact: int = 3000) -> DataFrame:
    """(repo_id, node, score): shortest-path betweenness, exact in snapshots of up to ``exact`` nodes.

    Larger ones have ``pivots`` sources, those of the first places by hash, scaled to all. Paths are counted level by level
    for all sources together, dependencies are added up backwards.
    """
    size = nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    order = F.row_number().over(Window.partitionBy("repo_id").orderBy(local.bits("node"), "node"))
    sources = nodes.withColumns({"r": order, "n": F.count(F.lit(1)).over(Window.partitionBy("repo_id"))}).where((C("n") <= exact) | (C("r") <= pivots)).select("repo_id", C("node").alias("s"))
    k = sources.groupBy("repo_id").agg(F.count(F.lit(1)).alias("k"))
    at = ["repo_id", "s", "node"]
    seen = Pile("bc")
    fronts = [seen.add(sources.select("repo_id", "s", C("s").alias("node"), F.lit(1.0).alias("paths")))]
    while fronts[-1].limit(1).count():
        reached = fronts[-1].join(edges.withColumnRenamed("src", "node"), _KEY).groupBy("repo_id", "s", C("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        fronts.append(seen.add(reached.join(seen.all(), at, "left_anti").select(*at, "paths")))
    gains, delta = Pile("gains"), fronts.pop().withColumn("delta", F.lit(0.0))  # the last level is empty
    while len(fronts) > 1:  # from the deepest level to the first; the sources get nothing
        level = fronts.pop()
        below = delta.select("repo_id", "s", C("node").alias("dst"), ((1 + C("delta")) / C("paths")).alias("share"))
        share = below.join(edges, ["repo_id", "dst"]).select("repo_id", "s", C("src").alias("node"), "share")
        gain = share.join(level, at).groupBy(*at).agg(F.sum(C("share") * C("paths")).alias("gain"))
        delta = gains.add(level.join(gain, at, "left").select(*at, "paths", F.coalesce("gain", F.lit(0.0)).alias("delta")))
    score = gains.all().groupBy(*_KEY).agg(F.sum("delta").alias("b")) if gains.parts else nodes.select(*_KEY, F.lit(0.0).alias("b"))
    full = nodes.join(score, _KEY, "left").join(size, "repo_id").join(k, "repo_id")
    value = F.coalesce("b", F.lit(0.0)) * C("n") / C("k") / ((C("n") - 1) * (C("n") - 2))
    return full.select(*_KEY, F.round(F.when(C("n") > 2, value).otherwise(0.0), 6).alias("score"))


def chains_by_joins(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """As ``local.chains``: a run is a tree without branches, walked by doubling; a circle is cut before its least node and walked again."""
    d = keep(degrees(edges), "degrees")
    ones = lambda c, end: d.where(C(c) == 1).select("repo_id", C("node").alias(end))
    link = edges.where(C("src") != C("dst")).join(ones("out_degree", "src"), ["repo_id", "src"], "left_semi").join(ones("in_degree", "dst"), ["repo_id", "dst"], "left_semi")
    link = keep(link.select("repo_id", "src", "dst"), "links")
    heads = link.select("repo_id", C("src").alias("child")).join(link.select("repo_id", C("dst").alias("child")), ["repo_id", "child"], "left_anti")
    rows = link.select("repo_id", C("dst").alias("child"), C("src").alias("parent")).unionByName(heads.withColumn("parent", F.lit(None).cast("string")))
    rows = keep(rows.withColumn("component", F.lit(0)), "links")
    found = keep(hierarchy._double(rows, ["hash", "root_hash", "depth", "circle"]), "walked")
    round_ = found.where(C("circle").isNotNull()).select("repo_id", C("hash").alias("child"), "circle")
    cut = rows.join(round_, ["repo_id", "child"]).withColumn("parent", F.when(C("child") != C("circle"), C("parent"))).drop("circle")
    again = hierarchy._double(cut, ["hash", "root_hash", "depth"]).withColumn("circle", F.lit(True))
    runs = found.where(C("circle").isNull()).select("repo_id", "hash", "root_hash", "depth", F.lit(False).alias("circle")).unionByName(again)
    runs = keep(runs, "runs")
    length = runs.groupBy("repo_id", "root_hash").agg(F.count(F.lit(1)).cast("int").alias("length"))
    out = runs.join(length, ["repo_id", "root_hash"]).select("repo_id", C("hash").alias("node"), C("root_hash").alias("head"), C("depth").alias("place"), "length", "circle")
    return nodes.join(out, _KEY, "left").select(*_KEY, "head", "place", "length", "circle")


def chains(edges: DataFrame, listed: int = 9, largest: int = local.LARGEST) -> DataFrame:
    """(repo_id, head, length, members, circle): maximal runs of nodes with one way out into nodes with one way in, two nodes at least.

    edges count with repetitions. A head's own callers are not limited. A run that closes to a circle begins at its least
    node. members has the first ``listed`` ones.
    """
    rows = local.split(edges, nodes_of(edges), local.chains, "head string, place int, length int, circle boolean", chains_by_joins, largest)
    rows = rows.where(C("head").isNotNull() & (C("length") > 1))
    first = F.transform(F.array_sort(F.collect_list(F.when(C("place") < listed, F.struct("place", "node")))), lambda x: x["node"])
    return rows.groupBy("repo_id", "head").agg(F.max("length").alias("length"), first.alias("members"), F.max("circle").alias("circle"))


def scc(edges: DataFrame, largest: int = local.LARGEST) -> DataFrame:
    """(repo_id, node, scc): strongly connected components of the nodes of the edges; scc is the least hash in it."""
    return local.split(edges, nodes_of(edges), local.scc, "scc string", lambda e, n: scc_by_joins(e), largest)


def longest_depth(dag: DataFrame, nodes: DataFrame, largest: int = local.LARGEST) -> DataFrame:
    """(repo_id, node, depth): longest path from a node without incoming edges. dag must have no cycles."""
    return local.split(dag, nodes, local.longest_depth, "depth int", longest_depth_by_joins, largest)


def path_counts(dag: DataFrame, sizes: DataFrame, largest: int = local.LARGEST) -> DataFrame:
    """(repo_id, node, n): size of a component plus the counts of its successors, so a diamond counts twice."""
    return local.split(dag, sizes, local.path_counts, "n double", path_counts_by_joins, largest)


def reach_counts(dag: DataFrame, sizes: DataFrame, largest: int = local.LARGEST) -> DataFrame:
    """(repo_id, node, n): summed size of the distinct nodes that a node reaches, itself included, so a diamond counts once."""
    return local.split(dag, sizes, local.reach_counts, "n double", reach_counts_by_joins, largest)


def pagerank(edges: DataFrame, nodes: DataFrame, largest: int = local.LARGEST) -> DataFrame:
    """(repo_id, node, rank): damping 0.85, sums to 1 in each snapshot; nodes without outgoing edges give to all."""
    return local.split(edges, nodes, local.pagerank, "rank double", pagerank_by_joins, largest)


def hits(edges: DataFrame, nodes: DataFrame, largest: int = local.LARGEST) -> DataFrame:
    """(repo_id, node, hub, authority): power iteration, each summing to 1; zeros in a snapshot without edges."""
    return local.split(edges, nodes, local.hits, "hub double, authority double", hits_by_joins, largest)


def betweenness(edges: DataFrame, nodes: DataFrame, pivots: int = 500, largest: int = local.LARGEST, exact: int = 3000) -> DataFrame:
    """(repo_id, node, score): exact in snapshots of up to ``exact`` nodes, else from ``pivots`` sources (those of the least hash), scaled."""
    ranked = nodes.select("repo_id", "node", local.bits("node").cast("double").alias("size"))
    return local.split(edges, ranked, lambda *a: local.betweenness(*a, pivots=pivots, exact=exact), "score double", lambda e, n: betweenness_by_joins(e, n.select("repo_id", "node"), pivots, exact=exact), largest)
