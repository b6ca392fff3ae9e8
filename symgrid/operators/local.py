"""Graph algorithms on one snapshot in memory, and how snapshots are brought to them."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgrid.sources.tables import keep, small

#: Edges of a snapshot up to which one task treats it (some 50 MB of arrays and lists at most).
LARGEST = 300_000
#: Rounds of pagerank and hits at most, the summed change a node that ends pagerank, the greatest change that ends hits.
ROUNDS, RANK_TOLERANCE, HUB_TOLERANCE = 200, 1e-8, 1e-8
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


#: Bits of a node's hash that give it a place among the nodes, alike in every way of computing.
BITS = 40


def bits(node: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), node), F.lit(1 << BITS))


def split(edges: DataFrame, nodes: DataFrame, fn: Callable, out: str, by_joins: Callable[[DataFrame, DataFrame], DataFrame], largest: int = LARGEST) -> DataFrame:
    """(repo_id, node, out…): ``fn`` on snapshots of at most ``largest`` edges, ``by_joins`` on the others.

    fn takes the sorted names of the nodes, edges as two arrays of their numbers, and the column size of nodes (1 if
    there is none); it gives one array or list for each column of ``out``.
    """
    size = "size" in nodes.columns
    large = keep(edges.groupBy("repo_id").count().where(F.col("count") > largest).select("repo_id"), "large")
    rows = nodes.select("repo_id", F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), (F.col("size") if size else F.lit(1)).cast("double").alias("size"))
    rows = rows.unionByName(edges.select("repo_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0.0).alias("size")))
    names = [x.split() for x in out.split(", ")]
    types = [pa.string(), pa.string(), *[_TYPES[t] for _, t in names]]

    def treat(repo: str | None, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        is_node = pc.is_null(t.column("b"))
        nodes_, ends = t.filter(is_node).sort_by("a"), t.filter(pc.invert(is_node))
        order = pc.unique(nodes_.column("a"))
        first = pc.index_in(order, value_set=nodes_.column("a"))
        sizes = nodes_.column("size").take(first).to_numpy()
        src, dst = (pc.index_in(ends.column(c), value_set=order).to_numpy() for c in ("a", "b"))
        known = ~(np.isnan(src) | np.isnan(dst)) if src.dtype.kind == "f" or dst.dtype.kind == "f" else slice(None)
        got = fn(order.to_pylist(), src[known].astype(np.int64), dst[known].astype(np.int64), sizes)
        columns = [pa.array([repo] * len(order), pa.string()), order.cast(pa.string()), *[pa.array(c, ty) for c, ty in zip(got, types[2:])]]
        return pa.RecordBatch.from_arrays(columns, names=["repo_id", "node", *[x for x, _ in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            repos = b.column(0)
            at = 0
            while at < b.num_rows:
                repo = repos[at].as_py()
                if held and repo != last:
                    yield treat(last, held)
                    held = []
                same = repos.slice(at)
                n = len(same) if same[-1].as_py() == repo else int(np.argmin(np.array([x == repo for x in same.to_pylist()])))
                held.append(b.slice(at, n))
                last, at = repo, at + n
        if held:
            yield treat(last, held)

    walked = rows.join(small(large), "repo_id", "left_anti").repartition("repo_id").sortWithinPartitions("repo_id").mapInArrow(run, f"repo_id string, node string, {out}")
    if not large.limit(1).count():
        return walked
    of = lambda df: df.join(small(large), "repo_id", "left_semi")
    return walked.unionByName(by_joins(of(edges), of(nodes)))


def _lists(n: int, src: np.ndarray, dst: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(src.tolist(), dst.tolist()):
        out[a].append(b)
    return out


def scc(names: list[str], src: np.ndarray, dst: np.ndarray, size: np.ndarray) -> list:
    """Components by one depth-first walk with low links; each named after its least member."""
    n, ways = len(names), _lists(len(names), src, dst)
    index, low, on, stack, name, count = [-1] * n, [0] * n, [False] * n, [], [0] * n, 0
    for start in range(n):
        if index[start] >= 0:
            continue
        work = [(start, iter(ways[start]))]
        index[start] = low[start] = count
        count += 1
        stack.append(start)
        on[start] = True
        while work:
            v, rest = work[-1]
            for w in rest:
                if index[w] < 0:
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    on[w] = True
                    work.append((w, iter(ways[w])))
                    break
                if on[w]:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on[w] = False
                        part.append(w)
                        if w == v:
                            break
                    for w in part:
                        name[w] = min(part)
    return [[names[x] for x in name]]


def _topological(n: int, ways: list[list[int]]) -> list[int]:
    waiting = [0] * n
    for w in ways:
        for x in w:
            waiting[x] += 1
    ready, order = deque(i for i in range(n) if not waiting[i]), []
    while ready:
        v = ready.popleft()
        order.append(v)
        for w in ways[v]:
            waiting[w] -= 1
            if not waiting[w]:
                ready.append(w)
    return order


def longest_depth(names: list[str], src: np.ndarray, dst: np.ndarray, size: np.ndarray) -> list:
    ways = _lists(len(names), src, dst)
    depth = [0] * len(names)
    for v in _topological(len(names), ways):
        for w in ways[v]:
            depth[w] = max(depth[w], depth[v] + 1)
    return [depth]


def path_counts(names: list[str], src: np.ndarray, dst: np.ndarray, size: np.ndarray) -> list:
    ways = _lists(len(names), src, dst)
    n = size.tolist()
    for v in reversed(_topological(len(names), ways)):
        n[v] += sum(n[w] for w in ways[v])
    return [n]


def reach_counts(names: list[str], src: np.ndarray, dst: np.ndarray, size: np.ndarray, block: int = 4096) -> list:
    """Summed size of the distinct nodes that each node reaches, itself included; ``block`` targets at a time, as bits of one number."""
    n = len(names)
    ways, counts = _lists(n, src, dst), np.zeros(n)
    order = _topological(n, ways)[::-1]
    for lo in range(0, n, block):
        hi = min(lo + block, n)
        sizes = size[lo:hi]
        reach = [0] * n
        for v in order:
            seen = 1 << (v - lo) if lo <= v < hi else 0
            for w in ways[v]:
                seen |= reach[w]
            reach[v] = seen
        plain = (sizes == 1).all()
        for v in range(n):
            if not reach[v]:
                continue
            if plain:
                counts[v] += reach[v].bit_count()
            else:
                bits = np.unpackbits(np.frombuffer(reach[v].to_bytes((hi - lo + 7) // 8, "little"), dtype=np.uint8), bitorder="little")
                counts[v] += sizes[bits[: hi - lo].astype(bool)].sum()
    return [counts]


def chains(names: list[str], src: np.ndarray, dst: np.ndarray, size: np.ndarray) -> list:
    """Head, place and length of the run of each node, and whether it is a circle; null for nodes of no run."""
    n = len(names)
    single = (np.bincount(src, minlength=n)[src] == 1) & (np.bincount(dst, minlength=n)[dst] == 1) & (src != dst)
    after, before = np.full(n, -1), np.full(n, -1)
    after[src[single]], before[dst[single]] = dst[single], src[single]
    head: list[str | None] = [None] * n
    place, length, circle = [None] * n, [None] * n, [None] * n
    nexts = after.tolist()

    def walk(start: int, round_: bool) -> None:
        way, at = [], start
        while at >= 0 and not (way and at == start):
            way.append(at)
            at = nexts[at]
        for i, v in enumerate(way):
            head[v], place[v], length[v], circle[v] = names[start], i, len(way), round_

    for v in np.flatnonzero((before < 0) & (after >= 0)).tolist():
        walk(v, False)
    for v in np.flatnonzero(after >= 0).tolist():  # what has no head is a circle, which begins at its least node
        if head[v] is None:
            walk(v, True)
    return [head, place, length, circle]


def pagerank(names: list[str], src: np.ndarray, dst: np.ndarray, size: np.ndarray) -> list:
    n = len(names)
    out = np.bincount(src, minlength=n)
    rank = np.full(n, 1 / n)
    for _ in range(ROUNDS):
        got = np.bincount(dst, rank[src] / out[src], minlength=n)
        new = 0.15 / n + 0.85 * (got + rank[out == 0].sum() / n)
        change, rank = np.abs(new - rank).sum(), new
        if change < n * RANK_TOLERANCE:
            break
    return [rank]


def hits(names: list[str], src: np.ndarray, dst: np.ndarray, size: np.ndarray) -> list:
    n = len(names)
    hub, auth = np.full(n, 1 / n), np.zeros(n)
    for _ in range(ROUNDS):
        auth = np.bincount(dst, hub[src], minlength=n)
        new = np.bincount(src, auth[dst], minlength=n)
        auth, new = auth / (auth.sum() or 1), new / (new.sum() or 1)
        change, hub = np.abs(new - hub).max(), new
        if change < HUB_TOLERANCE:
            break
    return [hub, auth]


def betweenness(names: list[str], src: np.ndarray, dst: np.ndarray, size: np.ndarray, pivots: int = 500, exact: int = 3000) -> list:
    """Paths counted level by level from each source, dependencies added up backwards. size orders the sources.

    All nodes are sources up to ``exact`` nodes, else ``pivots``. Many sources are walked together: a place is the number
    of the source in its batch times n plus the node.
    """
    n = len(names)
    by_src = np.argsort(src, kind="stable")
    ways, out = dst[by_src], np.bincount(src, minlength=n)
    first = np.cumsum(out) - out
    score = np.zeros(n)
    order = sorted(range(n), key=lambda i: (size[i], names[i]))
    sources = np.array(order if n <= exact else order[:pivots], dtype=np.int64)
    batch = max(1, 250_000 // max(n, 1))
    for at in range(0, len(sources), batch):
        some = sources[at : at + batch]
        level, paths = np.full(len(some) * n, -1, dtype=np.int32), np.zeros(len(some) * n)
        turn = np.zeros(len(some) * n, dtype=np.int64)
        starts = front = np.arange(len(some)) * n + some
        level[front], paths[front] = 0, 1
        steps, depth = [], 0
        while len(front):
            depth += 1
            node = front % n
            k = out[node]
            a = np.repeat(front, k)
            way = np.repeat(first[node] - (np.cumsum(k) - k), k) + np.arange(len(a))
            b = np.repeat(front - node, k) + ways[way]
            down = level[b] < 0
            a, b = a[down], b[down]
            level[b] = depth
            np.add.at(paths, b, paths[a])
            steps.append((a, b))
            turn[b] = np.arange(len(b))
            front = b[turn[b] == np.arange(len(b))]
        gain = np.zeros(len(some) * n)
        for a, b in reversed(steps):
            np.add.at(gain, a, paths[a] / paths[b] * (1 + gain[b]))
        gain[starts] = 0
        score += gain.reshape(len(some), n).sum(axis=0)
    if n > 2 and len(sources):
        score *= n / len(sources) / ((n - 1) * (n - 2))
    return [np.floor(score * 1e6 + 0.5) / 1e6]
