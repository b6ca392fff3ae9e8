"""Communities of the undirected call graph by moving nodes for modularity, and reports on them.

Nodes move to the neighbouring community of greatest gain, half of them at a time (by a bit of their place), until two
sweeps in a row move none; the division of greatest modularity counts. Communities then become nodes and the same is
done again, until nothing joins. Scores are whole numbers times the resolution, so both ways, in one task and by joins,
take the same decisions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.operators import local
from symgrid.sources.catalog import Catalog
from symgrid.sources.tables import forget, keep, small

C = F.col
_KEY = ["repo_id", "node"]
#: Sweeps of a level and levels at most.
SWEEPS, LEVELS = 40, 20


def unweighted(edges: DataFrame) -> DataFrame:
    """Each undirected pair once."""
    return edges.select("repo_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _move(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, degree: np.ndarray, label: np.ndarray, may: np.ndarray, twice: float, resolution: float) -> np.ndarray:
    """One sweep: the labels after the nodes that may move have moved. a, b, w: links both ways without loops."""
    size = np.bincount(label, degree, n)
    pairs, at = np.unique(a * n + label[b], return_inverse=True)
    k = np.bincount(at, w)
    node, to = pairs // n, pairs % n
    inside = to == label[node]
    score = twice * k - resolution * degree[node] * (size[to] - np.where(inside, degree[node], 0.0))
    own = -resolution * degree * (size[label] - degree)
    own[node[inside]] = score[inside]
    order = np.lexsort((to, -score, node))
    first = order[np.append(True, node[order][1:] != node[order][:-1])] if len(order) else order
    best = first[may[node[first]] & (score[first] > own[node[first]])]
    new = label.copy()
    new[node[best]] = to[best]
    return new


def _quality(a: np.ndarray, b: np.ndarray, w: np.ndarray, loops: float, degree: np.ndarray, label: np.ndarray, twice: float, resolution: float) -> float:
    """4 m^2 times the modularity."""
    size = np.bincount(label, degree)
    return twice * (w[label[a] == label[b]].sum() + 2 * loops) - resolution * (size * size).sum()


def louvain_in_memory(names: list[str], src: np.ndarray, dst: np.ndarray, bits: np.ndarray, resolution: float) -> list:
    n = len(names)
    of = np.arange(n)  # community of each node, by the least node in it
    low, high = np.minimum(src, dst), np.maximum(src, dst)
    pairs, w = np.unique(low * max(n, 1) + high, return_counts=True)
    u, v, w = pairs // max(n, 1), pairs % max(n, 1), w.astype(float)
    twice = 2 * w.sum()
    here = np.arange(n)
    for _ in range(LEVELS):
        if not twice:
            break
        loop = u == v
        loops = float(w[loop].sum())
        degree = np.bincount(u, w, n) + np.bincount(v, w, n)
        a, b, ww = np.concatenate([u[~loop], v[~loop]]), np.concatenate([v[~loop], u[~loop]]), np.concatenate([w[~loop]] * 2)
        label, best, still = np.arange(n), np.arange(n), 0
        top = _quality(a, b, ww, loops, degree, label, twice, resolution)
        for sweep in range(SWEEPS):
            may = (bits.astype(np.int64) >> (sweep % local.BITS)) & 1 == 1
            new = _move(n, a, b, ww, degree, label, may, twice, resolution)
            moved, label = (new != label).any(), new
            still = 0 if moved else still + 1
            if moved and (q := _quality(a, b, ww, loops, degree, label, twice, resolution)) > top:
                top, best = q, label
            if still == 2:
                break
        # named after the least member
        least = np.full(n, n)
        np.minimum.at(least, best[here], here)
        joined = least[best]
        if (joined[here] == here).all():
            break
        of = joined[of]
        u, v = joined[u], joined[v]
        pairs, at = np.unique(np.minimum(u, v) * n + np.maximum(u, v), return_inverse=True)
        u, v, w = pairs // n, pairs % n, np.bincount(at, w)
        here = np.unique(joined[here])
    return [[names[i] for i in of]]


def _level(pairs: DataFrame, nodes: DataFrame, twice: DataFrame, resolution: float) -> DataFrame:
    """(repo_id, node, label) after the sweeps of one level. pairs: repo_id, u <= v, w; nodes: repo_id, node, bits."""
    ends = pairs.select("repo_id", F.explode(F.array(F.struct(C("u").alias("a"), C("v").alias("b")), F.struct(C("v").alias("a"), C("u").alias("b")))).alias("e"), "w")
    ends = keep(ends.select("repo_id", "e.a", "e.b", "w"), "ends")
    degree = ends.groupBy("repo_id", C("a").alias("node")).agg(F.sum("w").alias("degree"))
    both = keep(ends.where(C("a") != C("b")), "both")
    loops = keep(pairs.where(C("u") == C("v")).groupBy("repo_id").agg(F.sum("w").alias("loops")), "loops")
    state = nodes.join(degree, _KEY, "left").select(*_KEY, "bits", F.coalesce("degree", F.lit(0.0)).alias("degree"), C("node").alias("label"), C("node").alias("best"))

    def quality(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("repo_id", "label").agg(F.sum("degree").alias("d")).groupBy("repo_id").agg(F.sum(C("d") * C("d")).alias("dd"))
        of = lambda end: rows.select("repo_id", C("node").alias(end), C("label").alias(f"l_{end}"))
        inner = both.join(of("a"), ["repo_id", "a"]).join(of("b"), ["repo_id", "b"]).where(C("l_a") == C("l_b")).groupBy("repo_id").agg(F.sum("w").alias("inside"))
        q = twice.join(sizes, "repo_id").join(inner, "repo_id", "left").join(loops, "repo_id", "left")
        value = C("twice") * (F.coalesce("inside", F.lit(0.0)) + 2 * F.coalesce("loops", F.lit(0.0))) - resolution * C("dd")
        return q.select("repo_id", value.alias("q"))

    state = keep(state, "louvain")
    ends_at = keep(quality(state).select("repo_id", C("q").alias("top"), F.lit(0).alias("still")), "quality")
    done = None
    for sweep in range(SWEEPS):
        size = state.groupBy("repo_id", "label").agg(F.sum("degree").alias("size"))
        votes = both.join(state.select("repo_id", C("node").alias("b"), "label"), ["repo_id", "b"]).groupBy("repo_id", C("a").alias("node"), C("label").alias("to")).agg(F.sum("w").alias("k"))
        me = state.select(*_KEY, "bits", "degree", "label")
        scored = votes.join(me, _KEY).join(size.withColumnRenamed("label", "to"), ["repo_id", "to"]).join(small(twice), "repo_id")
        inside = C("to") == C("label")
        score = C("twice") * C("k") - resolution * C("degree") * (C("size") - F.when(inside, C("degree")).otherwise(0.0))
        best = scored.withColumn("score", score).groupBy(*_KEY).agg(F.min(F.struct((-C("score")).alias("s"), "to")).alias("m"), F.max(F.when(inside, C("score"))).alias("own"))
        new = state.join(best, _KEY, "left").join(size, ["repo_id", "label"])
        own = F.coalesce("own", -resolution * C("degree") * (C("size") - C("degree")))
        may = F.shiftright("bits", sweep % local.BITS).bitwiseAND(1) == 1
        goes = F.coalesce(may & (-C("m.s") > own), F.lit(False))
        new = new.select(*_KEY, "bits", "degree", F.when(goes, C("m.to")).otherwise(C("label")).alias("label"), "best", goes.alias("moved"))
        new = keep(new, "louvain")
        moved = new.groupBy("repo_id").agg(F.max("moved").alias("moved"))
        judged = ends_at.join(quality(new), "repo_id").join(moved, "repo_id")
        better = C("moved") & (C("q") > C("top"))
        judged = keep(judged.select("repo_id", F.greatest("top", "q").alias("top"), F.when(C("moved"), 0).otherwise(C("still") + 1).alias("still"), better.alias("better")), "quality")
        after = new.join(small(judged.select("repo_id", "better", "still")), "repo_id").withColumn("best", F.when(C("better"), C("label")).otherwise(C("best"))).drop("moved", "better")
        moving, after = new, keep(after, "louvain")
        forget(moving)
        over = after.where(C("still") == 2).select(*_KEY, C("best").alias("label"))
        done = over if done is None else done.unionByName(over)
        state = after.where(C("still") < 2).drop("still")
        ends_at = judged.where(C("still") < 2).drop("better")
        if not ends_at.limit(1).count():
            return done
    last = state.select(*_KEY, C("best").alias("label"))
    return last if done is None else done.unionByName(last)


def louvain_by_joins(edges: DataFrame, nodes: DataFrame, resolution: float) -> DataFrame:
    pairs = edges.groupBy("repo_id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    pairs = keep(pairs, "pairs")
    twice = keep(pairs.groupBy("repo_id").agg((2 * F.sum("w")).alias("twice")), "twice")
    of = keep(nodes.select(*_KEY, C("node").alias("community")), "communities")
    here = keep(nodes.select(*_KEY, local.bits("node").alias("bits")), "level")
    for _ in range(LEVELS):
        label = keep(_level(pairs, here, twice, resolution), "labels")
        names = label.groupBy("repo_id", "label").agg(F.min("node").alias("name"))
        joined = keep(label.join(names, ["repo_id", "label"]).select(*_KEY, "name"), "joined")
        if not joined.where(C("node") != C("name")).limit(1).count():
            break
        to = lambda end: joined.select("repo_id", C("node").alias(end), C("name").alias(f"n_{end}"))
        old = of
        of = keep(of.join(joined.select("repo_id", C("node").alias("community"), "name"), ["repo_id", "community"], "left").select(*_KEY, F.coalesce("name", "community").alias("community")), "communities")
        forget(old)
        merged = pairs.join(to("u"), ["repo_id", "u"]).join(to("v"), ["repo_id", "v"])
        pairs = keep(merged.groupBy("repo_id", F.least("n_u", "n_v").alias("u"), F.greatest("n_u", "n_v").alias("v")).agg(F.sum("w").alias("w")), "pairs")
        here = keep(joined.select("repo_id", C("name").alias("node")).distinct().withColumn("bits", local.bits("node")), "level")
    return of


def louvain(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, largest: int = local.LARGEST) -> DataFrame:
    """(repo_id, node, community): nodes divided for modularity; a community is named after its least node.

    The weight of two nodes is the number of edge rows between them in both directions; loops count too. A greater
    resolution gives smaller communities. Nodes without edges are communities of their own.
    """
    ranked = nodes.select(*_KEY, local.bits("node").cast("double").alias("size"))
    return local.split(edges, ranked, lambda *a: louvain_in_memory(*a, resolution), "community string", lambda e, n: louvain_by_joins(e, n.select(*_KEY), resolution), largest)


def modularity(edges: DataFrame, label: DataFrame) -> DataFrame:
    """(repo_id, modularity) of a division of the undirected graph, edge rows as weights, loops included."""
    of = lambda a: label.select("repo_id", C("node").alias(a), C("community").alias(f"c_{a}"))
    e = edges.join(of("src"), ["repo_id", "src"]).join(of("dst"), ["repo_id", "dst"])
    inside = e.groupBy("repo_id").agg(F.count(F.lit(1)).alias("m"), F.count_if(C("c_src") == C("c_dst")).alias("inside"))
    ends = e.select("repo_id", F.explode(F.array("c_src", "c_dst")).alias("c")).groupBy("repo_id", "c").agg(F.count(F.lit(1)).alias("d"))
    square = ends.groupBy("repo_id").agg(F.sum(C("d") * C("d")).alias("dd"))
    return inside.join(square, "repo_id").select("repo_id", (C("inside") / C("m") - C("dd") / (4 * C("m") * C("m"))).alias("modularity"))


def _counts(label: DataFrame, modules: DataFrame) -> DataFrame:
    return label.join(modules, _KEY).groupBy("repo_id", "community", "module").agg(F.count(F.lit(1)).alias("n"))


def dominant(label: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo_id, community, size, dominant, purity): most frequent module (a null one too), ties to the least; modules: (repo_id, node, module)."""
    first = F.min(F.struct((-C("n")).alias("n"), C("module").isNull().alias("u"), C("module").alias("m")))
    g = _counts(label, modules).groupBy("repo_id", "community").agg(F.sum("n").alias("size"), first.alias("d"))
    return g.select("repo_id", "community", "size", C("d.m").alias("dominant"), F.bround(-C("d.n") / C("size"), 3).alias("purity"), (-C("d.n")).alias("n_dominant"))


class Report:
    """Communities of two symbols or more: themselves, the calls between them, symbols that live elsewhere, totals.

    The division is that of ``louvain`` or a given one, ``label``: (repo_id, node, community).
    """

    def __init__(self, c: Catalog, resolution: float = 1.0, label: DataFrame | None = None) -> None:
        # pairs with the number of their edge rows
        self.calls = keep(c.call_rows.select("repo_id", "src", "dst", "n"), "calls")
        self.about = keep(c.internal_nodes.select("repo_id", C("hash").alias("node"), "name", "module", "file_path"), "about")
        if label is None:
            rows = self.calls.select("repo_id", "src", "dst", F.explode(F.sequence(F.lit(1), C("n").cast("int")))).drop("col")
            label = louvain(rows, self.about.select(*_KEY), resolution)
        every = keep(label, "communities")
        self.modules = self.about.select(*_KEY, "module")
        self.sized = keep(dominant(every, self.modules).where(C("size") > 1), "sizes")
        self.label = keep(every.join(self.sized.select("repo_id", "community"), ["repo_id", "community"], "left_semi"), "labels")

    def communities(self, top: int = 6) -> DataFrame:
        """Size, dominant module, purity and the ``top`` modules with their symbols (null as ''), largest first (``row_no``)."""
        n = _counts(self.label, self.modules)
        first = Window.partitionBy("repo_id", "community").orderBy(C("n").desc(), C("module").asc_nulls_last())
        some = n.withColumn("r", F.row_number().over(first)).where(C("r") <= top)
        listed = some.groupBy("repo_id", "community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "module", "n"))), lambda x: F.concat(F.coalesce(x["module"], F.lit("")), F.lit("="), x["n"].cast("string"))).alias("top_modules"))
        order = Window.partitionBy("repo_id").orderBy(C("size").desc(), "community")
        return self.sized.join(listed, ["repo_id", "community"]).select("repo_id", F.row_number().over(order).alias("row_no"), "community", "size", "dominant", "purity", "top_modules")

    def links(self) -> DataFrame:
        """(repo_id, a, b, count, weight): edge rows between two communities, a < b, and their share of the greatest number."""
        of = lambda end: self.label.select("repo_id", C("node").alias(end), C("community").alias(f"c_{end}"))
        e = self.calls.join(of("src"), ["repo_id", "src"]).join(of("dst"), ["repo_id", "dst"]).where(C("c_src") != C("c_dst"))
        n = e.groupBy("repo_id", F.least("c_src", "c_dst").alias("a"), F.greatest("c_src", "c_dst").alias("b")).agg(F.sum("n").alias("count"))
        n = keep(n, "links")
        most = n.groupBy("repo_id").agg(F.max("count").alias("most"))
        return n.join(small(most), "repo_id").select("repo_id", "a", "b", "count", F.bround(C("count") / C("most"), 3).alias("weight"))

    def misaligned(self, limit: int = 200) -> DataFrame:
        """Symbols whose module isn't the dominant one of a community at least half pure, by module and name; ``limit`` a snapshot."""
        home = self.label.join(self.sized, ["repo_id", "community"]).where(2 * C("n_dominant") >= C("size")).join(self.about, _KEY)
        away = home.where(~C("module").eqNullSafe(C("dominant")))
        order = Window.partitionBy("repo_id").orderBy(F.coalesce("module", F.lit("")), F.coalesce("name", F.lit("")), "node")
        rows = away.withColumn("row_no", F.row_number().over(order)).where(C("row_no") <= limit)
        return rows.select("repo_id", "row_no", C("node").alias("hash"), "name", C("module").alias("declared_module"), C("dominant").alias("inferred_module"), "community", "file_path")

    def totals(self) -> DataFrame:
        """(repo_id, community_count, total_nodes, alignment_score): the share of symbols whose module dominates their community."""
        g = self.sized.groupBy("repo_id").agg(F.count(F.lit(1)).alias("community_count"), F.sum("size").alias("total_nodes"), F.sum("n_dominant").alias("aligned"))
        return g.select("repo_id", "community_count", "total_nodes", F.bround(C("aligned") / C("total_nodes"), 3).alias("alignment_score"))
