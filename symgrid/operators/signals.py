"""The signals of the call graph itself, all of a snapshot in one go.

A snapshot of up to ``local.LARGEST`` edges is read by one task once; larger ones go through the same algorithms by joins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrid.operators import communities, graph, local
from symgrid.sources.tables import keep

C = F.col
_KEY = ["repo_id", "node"]
_OUT = "scc string, topological_depth int, reverse_topological_depth int, callers double, callees double, rank double, hub double, authority double, score double, community string"


def in_memory(names: list[str], src: np.ndarray, dst: np.ndarray, bits: np.ndarray, pivots: int) -> list:
    n = len(names)
    scc = local.scc(names, src, dst, bits)[0]
    heads = sorted(set(scc))
    number = {x: i for i, x in enumerate(heads)}
    of = np.array([number[x] for x in scc], dtype=np.int64)
    sizes = np.bincount(of, minlength=len(heads)).astype(float)
    pairs = np.unique(np.stack([of[src], of[dst]], 1), axis=0) if len(src) else np.zeros((0, 2), np.int64)
    a, b = pairs[pairs[:, 0] != pairs[:, 1]].T
    down = np.array(local.longest_depth(heads, a, b, sizes)[0], dtype=np.int32)
    up = np.array(local.longest_depth(heads, b, a, sizes)[0], dtype=np.int32)
    callees, callers = (np.array(local.path_counts(heads, x, y, sizes)[0]) for x, y in ((a, b), (b, a)))
    low, high = np.minimum(src, dst), np.maximum(src, dst)
    once = np.unique(low * max(n, 1) + high)
    label = communities.louvain_in_memory(names, once // max(n, 1), once % max(n, 1), bits, 1.0)[0]
    rank, (hub, authority) = local.pagerank(names, src, dst, bits)[0], local.hits(names, src, dst, bits)
    score = local.betweenness(names, src, dst, bits, pivots=pivots)[0]
    return [scc, down[of], up[of], callers[of], callees[of], rank, hub, authority, score, label]


def by_joins(edges: DataFrame, nodes: DataFrame, pivots: int) -> DataFrame:
    edges, nodes = keep(edges, "edges"), keep(nodes.select(*_KEY), "nodes")
    parts = keep(nodes.join(graph.scc_by_joins(edges), _KEY, "left").select(*_KEY, F.coalesce("scc", "node").alias("scc")), "scc")
    dag = keep(graph.condense(edges, parts), "dag")
    sizes = keep(parts.groupBy("repo_id", C("scc").alias("node")).agg(F.count(F.lit(1)).alias("size")), "sizes")
    heads, back = sizes.select(*_KEY), graph.reverse(dag)
    of = graph.longest_depth_by_joins(dag, heads).withColumnRenamed("depth", "topological_depth")
    of = of.join(graph.longest_depth_by_joins(back, heads).withColumnRenamed("depth", "reverse_topological_depth"), _KEY)
    of = of.join(graph.path_counts_by_joins(back, sizes).withColumnRenamed("n", "callers"), _KEY).join(graph.path_counts_by_joins(dag, sizes).withColumnRenamed("n", "callees"), _KEY)
    rows = parts.join(of.withColumnRenamed("node", "scc"), ["repo_id", "scc"])
    for more in (graph.pagerank_by_joins(edges, nodes), graph.hits_by_joins(edges, nodes), graph.betweenness_by_joins(edges, nodes, pivots), communities.louvain_by_joins(communities.unweighted(edges), nodes, 1.0)):
        rows = rows.join(more, _KEY)
    return rows.select(*_KEY, *[x.split()[0] for x in _OUT.split(", ")])


def signals(edges: DataFrame, nodes: DataFrame, pivots: int = 500, largest: int = local.LARGEST) -> DataFrame:
    """(repo_id, node, …) of every node: component, depths, ways in and out (its component counted), rank, hub, authority, betweenness, community.

    edges: distinct (repo_id, src, dst) between nodes (repo_id, node).
    """
    ranked = nodes.select(*_KEY, local.bits("node").cast("double").alias("size"))
    return local.split(edges, ranked, lambda *a: in_memory(*a, pivots), _OUT, lambda e, n: by_joins(e, n, pivots), largest)
