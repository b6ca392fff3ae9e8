"""Quality of drawn graphs: where things lie, what hides what, how far a drawing follows the graph's own structure.

A drawing is one scenario: nodes (scenario, id, grp, x, y, r) and edges (scenario, source, target). Scenarios are spread
over tasks; each is measured in memory with arrays, pairs in blocks. Only measurements that are asked for are made.
Orders that the input leaves open are those of the ids. Nodes without a group are of no group; edges to unknown nodes
count where a share of all edges is given, and draw nothing.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

C = F.col
#: Rows of a block of pairs; larger blocks leave the cache.
BLOCK = 192
#: Nodes from which steps are counted at once; a multiple of 64.
SOURCES = 512
GOLDEN = math.pi * (3 - math.sqrt(5))
#: Parts of the quality score with their weights.
WEIGHTS = {"edge_visibility": 25, "no_overlap": 20, "few_crossings": 15, "low_stress": 20, "gestalt_cohesion": 10, "blob_integrity": 10}


def axis_spans(p: np.ndarray) -> tuple[float, float, float]:
    """Spans along the main axis of points and across it, and their ratio: 10 at most, 10 for what is thinner than 1."""
    if len(p) < 2:
        return 0.0, 0.0, 1.0
    d = p - p.mean(0)
    sxx, syy, sxy = (d[:, 0] ** 2).sum(), (d[:, 1] ** 2).sum(), (d[:, 0] * d[:, 1]).sum()
    a = 0.5 * math.atan2(2 * sxy, sxx - syy)
    major, minor = np.ptp(d @ [math.cos(a), math.sin(a)]), np.ptp(d @ [-math.sin(a), math.cos(a)])
    return float(major), float(minor), 10.0 if minor < 1 else min(10.0, float(major / minor))


def linearity(p: np.ndarray) -> dict:
    """Of points in order: elongation, and the share of inner points where the way turns by less than 30 degrees."""
    if len(p) < 2:
        return {"ratio": 1.0, "straightness": 1.0}
    step = np.diff(p, axis=0)
    a = np.arctan2(step[:, 1], step[:, 0])
    turn = np.abs(np.diff(a))
    turn = np.degrees(np.where(turn > math.pi, 2 * math.pi - turn, turn))
    return {"ratio": axis_spans(p)[2], "straightness": float((turn < 30).mean()) if len(turn) else 1.0}


def crosses(p1: np.ndarray, p2: np.ndarray, p3: np.ndarray, p4: np.ndarray) -> np.ndarray:
    """Whether segments p1-p2 and p3-p4 cross within, not within a hundredth of their ends; parallel ones don't."""
    d1, d2, d = p2 - p1, p4 - p3, p3 - p1
    denominator = d1[..., 0] * d2[..., 1] - d1[..., 1] * d2[..., 0]
    parallel = np.abs(denominator) < 1e-10
    denominator = np.where(parallel, 1.0, denominator)
    t = (d[..., 0] * d2[..., 1] - d[..., 1] * d2[..., 0]) / denominator
    u = (d[..., 0] * d1[..., 1] - d[..., 1] * d1[..., 0]) / denominator
    return ~parallel & (t > 0.01) & (t < 0.99) & (u > 0.01) & (u < 0.99)


def count_crossings(a: np.ndarray, b: np.ndarray, ends: np.ndarray, weights: np.ndarray | None = None) -> tuple[int, int]:
    """Pairs of segments a-b without a common end that ``crosses``, and the sum of the weights of both over these pairs.

    Two segments cross if each, shortened by a hundredth at either end, has its ends on different sides of the other's
    line. Sides come from products of matrices; where one is too near to a line to tell, ``crosses`` decides.
    """
    d = b - a
    kept = np.nonzero(np.isfinite(d).all(1) & (d != 0).any(1))[0]  # a point is parallel to all
    a, b, d, ends = a[kept], b[kept], d[kept], ends[kept]
    w = np.zeros(len(kept), np.int64) if weights is None else weights[kept]
    if len(a) < 2:
        return 0, 0
    middle = a.mean(0)
    p, q = a - middle, b - middle
    # what rounding may do to a side, with room to spare; also covers what ``crosses`` takes for parallel
    blur = np.maximum(1e-10, 1e-12 * np.hypot(d[:, 0], d[:, 1]) * max(np.abs(a).max(), np.abs(b).max(), np.abs(p).max(), np.abs(q).max()))
    line = np.stack([-d[:, 1], d[:, 0], d[:, 1] * p[:, 0] - d[:, 0] * p[:, 1]], 1) / blur[:, None]
    one = np.ones(len(p))
    first, last = (np.stack([*x.T, one]) for x in (p + 0.01 * d, q - 0.01 * d))
    count, weight = 0, 0

    def sides(i: slice, j: slice) -> tuple[np.ndarray, np.ndarray]:
        """Whether lines i part segments j, and where that is open."""
        s, t = line[i] @ first[:, j], line[i] @ last[:, j]
        apart = s * t < 0
        np.abs(s, out=s)
        np.abs(t, out=t)
        return apart, np.minimum(s, t, out=s) < 1

    for lo in range(0, len(a), BLOCK):
        i = slice(lo, lo + BLOCK)
        for at in range(lo, len(a), BLOCK):
            j = slice(at, at + BLOCK)
            hit, doubt = sides(i, j)
            hit2, doubt2 = (hit, doubt) if at == lo else sides(j, i)
            hit, doubt = hit & hit2.T, doubt | doubt2.T
            if at == lo:
                hit, doubt = np.triu(hit, 1), np.triu(doubt, 1)
            if doubt.any():
                x, y = np.nonzero(doubt)
                k, m = x + lo, y + at
                hit[x, y] = crosses(a[k], b[k], a[m], b[m]) & (ends[k][:, :, None] != ends[m][:, None]).all((1, 2))
            count += int(np.count_nonzero(hit))
            if weights is not None:
                h = hit.astype(np.float32)
                weight += int(w[i] @ h.sum(1).astype(np.int64)) + int(w[j] @ h.sum(0).astype(np.int64))
    return count, weight


def gini(values: np.ndarray) -> float:
    if not len(values) or not values.sum():
        return 0.0
    s = np.sort(values)
    return float(abs(((2 * np.arange(len(s)) - len(s) + 1) * s).sum() / (len(s) * s.sum())))


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the hull, counter-clockwise from the least point; fewer than three points are returned as they are."""
    if len(points) < 3:
        return list(points)
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(some: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in some:
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    order = sorted(points)
    return half(order) + half(order[::-1])


def expand(hull: list[tuple[float, float]], by: float) -> list[tuple[float, float]]:
    """Corners moved away from their mean."""
    if not hull:
        return hull
    cx, cy = (sum(v) / len(hull) for v in zip(*hull))
    out = []
    for x, y in hull:
        far = math.hypot(x - cx, y - cy) or 1.0
        out.append((x + (x - cx) / far * by, y + (y - cy) / far * by))
    return out


def inside(x: float, y: float, polygon: list[tuple[float, float]], near: float = 30.0) -> bool:
    """Whether a point lies in a polygon; one of fewer than three corners is a disc around their middle."""
    if len(polygon) < 3:
        return bool(polygon) and math.hypot(x - sum(p[0] for p in polygon) / len(polygon), y - sum(p[1] for p in polygon) / len(polygon)) < near
    hit = False
    for (ax, ay), (bx, by) in zip(polygon, polygon[-1:] + polygon[:-1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit = not hit
    return hit


class Drawing:
    """One scenario. ``links`` are pairs of ids, ``ends`` those of known nodes as numbers."""

    def __init__(self, ids: list[str], groups: list[str | None], at: np.ndarray, r: np.ndarray, links: list[tuple[str, str]]) -> None:
        order = sorted(range(len(ids)), key=ids.__getitem__)
        self.ids = [ids[i] for i in order]
        self.groups = [groups[i] or None for i in order]
        self.at, self.r = np.asarray(at, float).reshape(-1, 2)[order], np.asarray(r, float)[order]
        number = {x: i for i, x in enumerate(self.ids)}
        self.n_links = len(links)
        known = [(number[a], number[b]) for a, b in links if a in number and b in number]
        self.ends = np.array(known, dtype=np.int64).reshape(-1, 2)
        self.n = len(self.ids)
        names = sorted({g for g in self.groups if g})
        place = {g: i for i, g in enumerate(names)}
        self._found: dict[tuple, dict] = {}
        self.names, self.group = names, np.array([place.get(g, -1) for g in self.groups], dtype=np.int64)

    @cached_property
    def lengths(self) -> np.ndarray:
        a, b = self.ends.T
        return np.hypot(*(self.at[a] - self.at[b]).T) if len(self.ends) else np.zeros(0)

    @cached_property
    def gaps(self) -> np.ndarray:
        """What is seen of each edge between the rims of its ends."""
        return self.lengths - self.r[self.ends[:, 0]] - self.r[self.ends[:, 1]]

    @cached_property
    def middles(self) -> np.ndarray:
        n = np.bincount(self.group[self.group >= 0], minlength=len(self.names))
        sums = np.zeros((len(self.names), 2))
        np.add.at(sums, self.group[self.group >= 0], self.at[self.group >= 0])
        return sums / n[:, None] if len(self.names) else sums

    def radii(self, least: float, margin: np.ndarray | float = 0.0) -> np.ndarray:
        """Of each group the greatest distance of a member (and its margin) from the middle."""
        out = np.full(len(self.names), least, dtype=float)
        own = self.group >= 0
        far = np.hypot(*(self.at[own] - self.middles[self.group[own]]).T) + (margin[own] if isinstance(margin, np.ndarray) else margin)
        np.maximum.at(out, self.group[own], far)
        return out

    def _far(self, i: np.ndarray | slice, j: np.ndarray | slice) -> np.ndarray:
        """Distances of nodes i (rows) from nodes j."""
        x, y = self.at[i, 0][:, None] - self.at[j, 0], self.at[i, 1][:, None] - self.at[j, 1]
        x *= x
        y *= y
        x += y
        return np.sqrt(x, out=x)

    @cached_property
    def _pairs(self) -> dict:
        """Of all pairs of nodes: overlaps and the deepest one, and distances within groups and others, as sums and numbers."""
        count, deepest, sums, counts = 0, 0.0, [0.0, 0.0], [0, 0]
        own = np.where(self.group < 0, -1 - np.arange(self.n), self.group)
        for lo in range(0, self.n, BLOCK):
            for at in range(lo, self.n, BLOCK):
                i, j = slice(lo, lo + BLOCK), slice(at, at + BLOCK)
                far, same = self._far(i, j), own[i, None] == own[j]
                depth = (self.r[i, None] + self.r[j]) - far
                if at == lo:
                    upper = np.triu_indices(len(far), 1)
                    far, same, depth = far[upper], same[upper], depth[upper]
                count += int(np.count_nonzero(depth > 0))
                deepest = max(deepest, float(depth.max(initial=0.0)))
                for k, some in enumerate((same, ~same)):
                    sums[k] += float(far.sum(where=some))
                    counts[k] += int(np.count_nonzero(some))
        return {"count": count, "deepest": deepest, "sums": sums, "counts": counts}

    def edge_visibility(self, threshold: float = 8.0) -> dict:
        n = self.n_links
        seen = self.gaps > threshold
        return {"ratio": float(seen.sum() / n) if n else 1.0, "avg_gap": float(self.gaps.sum() / n) if n else 0.0, "min_gap": float(self.gaps.min()) if len(self.gaps) else 0.0}

    def node_overlap(self) -> dict:
        count, deepest = self._pairs["count"], self._pairs["deepest"]
        pairs = self.n * (self.n - 1) / 2
        return {"ratio": count / pairs if pairs else 0.0, "count": count, "max_overlap": deepest}

    def edge_crossings(self) -> dict:
        m = len(self.ends)
        count = count_crossings(self.at[self.ends[:, 0]], self.at[self.ends[:, 1]], self.ends)[0]
        pairs = m * (m - 1) / 2
        return {"count": count, "ratio": count / pairs if pairs else 0.0, "normalised": count / m if m else 0.0}

    @cached_property
    def _ways(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes with edges, the start of each one's neighbours, and the neighbours; an edge counts in both directions, repeated ones once."""
        a, b = np.concatenate([self.ends, self.ends[:, ::-1]]).T
        a, b = np.divmod(np.unique(a * self.n + b), self.n) if len(a) else (a, b)
        linked, first = np.unique(a, return_index=True)
        return linked, first, b

    def _steps(self, lo: int, hi: int) -> np.ndarray:
        """Least numbers of edges, in any direction, from the nodes lo to hi (columns) to all (rows); 0 for none.

        Each source is a bit, so one pass over the edges is a step from 64 of them at once. The digits of the numbers
        are gathered as bits too.
        """
        linked, first, to = self._ways
        i = np.arange(hi - lo)
        seen = np.zeros((-(-len(i) // 64), self.n), np.uint64)
        seen[i // 64, i + lo] = np.uint64(1) << (i % 64).astype(np.uint64)
        front, digits, depth = seen.copy(), [], 0
        while len(linked):
            depth += 1
            new = np.zeros_like(seen)
            for k, row in enumerate(front):
                new[k, linked] = np.bitwise_or.reduceat(row[to], first)
            new &= ~seen
            if not new.any():
                break
            seen |= new
            for k in range(depth.bit_length()):
                if k == len(digits):
                    digits.append(np.zeros_like(seen))
                if depth >> k & 1:
                    digits[k] |= new
            front = new
        kind = np.uint8 if len(digits) <= 8 else np.uint32
        out = np.zeros((self.n, hi - lo), kind)
        for k, x in enumerate(digits):
            bits = np.unpackbits(np.ascontiguousarray(x.T).astype("<u8").view(np.uint8), axis=1, count=hi - lo, bitorder="little")
            out |= bits.astype(kind, copy=False) << kind(k)
        return out

    def layout_stress(self, ideal: float = 120.0, within: bool = False) -> dict:
        """How far distances are from the number of edges between two nodes times an edge's ideal length."""
        if ("stress", ideal) not in self._found:
            self._found["stress", ideal] = self._stress(ideal)
        stress, pairs = self._found["stress", ideal][within]
        return {"stress": stress, "per_edge": stress / pairs if pairs else 0.0}

    def _stress(self, ideal: float) -> tuple[tuple[float, int], tuple[float, int]]:
        """Sums and numbers of pairs, of all and of those in one group."""
        sums, counts = [0.0, 0.0], [0, 0]
        for lo in range(0, self.n, SOURCES):
            hi = min(lo + SOURCES, self.n)
            steps = self._steps(lo, hi)
            for at in range(lo, self.n, BLOCK):  # rows above are pairs of an earlier block
                rows = np.arange(at, min(at + BLOCK, self.n))
                d = steps[rows]
                ok = d > 0
                if at < hi:
                    ok &= rows[:, None] > np.arange(lo, hi)
                same = ok & (self.group[rows, None] == self.group[lo:hi])
                want = np.maximum(d, 1) * float(ideal)
                off = self._far(rows, slice(lo, hi))
                off -= want
                off /= want
                off *= off
                for k, some in enumerate((ok, same)):
                    sums[k] += float(off.sum(where=some))
                    counts[k] += int(np.count_nonzero(some))
        return (sums[0], counts[0]), (sums[1], counts[1])

    @cached_property
    def neighbours(self) -> list[set[int]]:
        out: list[set[int]] = [set() for _ in range(self.n)]
        for a, b in self.ends.tolist():
            out[a].add(b)
            out[b].add(a)
        return out

    def hub_centrality(self, least: int = 3) -> dict:
        """Mean distance of hubs from the middle of their neighbours in the group, as a share of the neighbours' mean distance."""
        linked, first, w = self._ways
        v = np.repeat(linked, np.diff([*first, len(w)]))
        own = self.group[v] == self.group[w]
        v, w = v[own], w[own]
        k = np.bincount(v, minlength=self.n)
        hubs = np.nonzero(k >= least)[0]
        if not len(hubs):
            return {"hubs": 0, "avg_normalised": 0.0}
        mean = lambda x: (np.bincount(v, x, self.n)[hubs]) / k[hubs]
        far = mean(np.hypot(*(self.at[w] - self.at[v]).T))
        off = np.hypot(mean(self.at[w, 0]) - self.at[hubs, 0], mean(self.at[w, 1]) - self.at[hubs, 1])
        errors = np.where(far != 0, off / np.where(far != 0, far, 1), 0.0)
        return {"hubs": len(hubs), "avg_normalised": float(errors.mean())}

    def blob_integrity(self) -> dict:
        """Share of nodes that no other group's middle is nearer to than their own."""
        if len(self.names) < 2:
            return {"ratio": 1.0}
        own = np.nonzero(self.group >= 0)[0]
        kept = 0
        for lo in range(0, len(own), BLOCK):
            i = own[lo : lo + BLOCK]
            far = np.hypot(self.at[i, 0][:, None] - self.middles[:, 0], self.at[i, 1][:, None] - self.middles[:, 1])
            kept += int((far >= far[np.arange(len(i)), self.group[i]][:, None]).all(1).sum())
        return {"ratio": float(kept / self.n)}

    def blob_separation(self) -> dict:
        """Room between the discs of groups; null where there are fewer than two."""
        if len(self.names) < 2:
            return {"min_clearance": None, "avg_clearance": None, "separation_ratio": None, "overlapping": 0}
        i, j = np.triu_indices(len(self.names), 1)
        r = self.radii(1.0)
        room = np.hypot(*(self.middles[i] - self.middles[j]).T) - r[i] - r[j]
        worst = int(room.argmin())
        return {"min_clearance": float(room.min()), "avg_clearance": float(room.mean()), "separation_ratio": float(room[worst] / (r[i] + r[j])[worst]), "overlapping": int((room < 0).sum())}

    def gestalt_proximity(self) -> dict:
        """Mean distance within groups as a share of that of other pairs."""
        sums, counts = self._pairs["sums"], self._pairs["counts"]
        within = sums[0] / counts[0] if counts[0] else 0.0
        between = sums[1] / counts[1] if counts[1] else math.inf
        ratio = within / between if between > 0 else 0.0
        return {"within": within, "between": None if between == math.inf else between, "ratio": ratio, "cohesion": max(0.0, 1 - ratio)}

    def angular_resolution(self, threshold: float = 15.0) -> dict:
        """Least angles between the edges at a node."""
        a, b = self.ends.T
        dx, dy = (self.at[b] - self.at[a]).T
        v, t = np.concatenate([a, b]), np.concatenate([np.arctan2(dy, dx), np.arctan2(-dy, -dx)])
        order = np.lexsort((t, v))
        v, t = v[order], t[order]
        _, first, k = np.unique(v, return_index=True, return_counts=True)
        if not (k > 1).any():
            return {"min_angle": 180.0, "avg_min_angle": 180.0, "poor": 0}
        turn = np.append(t[1:], 0.0) - t
        last = first + k - 1
        turn[last] = t[first] - t[last] + 2 * math.pi
        least = np.degrees(np.minimum.reduceat(turn, first)[k > 1])
        return {"min_angle": float(least.min()), "avg_min_angle": float(least.mean()), "poor": int((least < threshold).sum())}

    def edge_length_uniformity(self) -> dict:
        x = self.lengths
        if not len(x):
            return {"mean": 0.0, "cv": 0.0, "min": 0.0, "max": 0.0}
        return {"mean": float(x.mean()), "cv": float(x.std() / x.mean()) if x.mean() else 0.0, "min": float(x.min()), "max": float(x.max())}

    def cross_edge_visibility(self, threshold: float = 8.0) -> dict:
        a, b = self.ends.T
        crossing = self.group[a] != self.group[b]
        n, seen = int(crossing.sum()), int((crossing & (self.gaps > threshold)).sum())
        return {"ratio": seen / n if n else 1.0, "count": n, "visible": seen}

    def node_size_variation(self) -> dict:
        return {"cv": float(self.r.std() / self.r.mean()) if self.n and self.r.mean() else 0.0, "mean": float(self.r.mean()) if self.n else 0.0}

    def prominent_visibility(self, top: int = 5) -> dict:
        """Share of the largest nodes that overlap no other."""
        if not self.n:
            return {"ratio": 1.0}
        some = np.argsort(-self.r, kind="stable")[:top]
        hidden = 0
        for v in some:
            near = np.hypot(*(self.at - self.at[v]).T) < self.r + self.r[v]
            near[v] = False
            hidden += bool(near.any())
        return {"ratio": (len(some) - hidden) / len(some)}

    @cached_property
    def corridors(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of groups with edges between them, and the number of these."""
        g = self.group[self.ends]
        g = np.sort(g[(g[:, 0] != g[:, 1]) & (g >= 0).all(1)], axis=1)
        return np.unique(g, axis=0, return_counts=True) if len(g) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))

    def corridor_crossings(self) -> dict:
        """Crossings of the lines between groups without a common group, plain and by the edges on them."""
        pairs, w = self.corridors
        none = {"crossing": 0, "pairs": 0, "ratio": 0.0, "weighted_ratio": 0.0}
        if len(self.names) < 3 or len(pairs) < 2:
            return none
        count, weight = count_crossings(self.middles[pairs[:, 0]], self.middles[pairs[:, 1]], pairs, w)
        # two lines have at most one group in common, so pairs with one are counted by group
        ends, n = np.bincount(pairs.reshape(-1)), len(pairs)
        own = np.zeros(len(ends), np.int64)
        np.add.at(own, pairs, w[:, None])
        total = n * (n - 1) // 2 - int((ends * (ends - 1) // 2).sum())
        total_weight = (n - 1) * int(w.sum()) - int((np.maximum(ends - 1, 0) * own).sum())
        return {"crossing": count, "pairs": total, "ratio": count / total if total else 0.0, "weighted_ratio": weight / total_weight if total_weight else 0.0}

    def edge_routing(self, clear: float = 25.0) -> dict:
        """Share of edges between groups whose line passes no third group's disc in its middle part."""
        pairs, w = self.corridors
        if len(self.names) < 3 or not len(pairs):
            return {"ratio": 1.0, "violating": 0, "pairs": len(pairs) if len(self.names) >= 3 else 0}
        r = self.radii(20.0, self.r + 8)
        a, d = self.middles[pairs[:, 0]], self.middles[pairs[:, 1]] - self.middles[pairs[:, 0]]
        length2 = (d**2).sum(1)
        blocked = np.zeros(len(pairs), bool)
        for lo in range(0, len(pairs), BLOCK):
            i = np.arange(lo, min(lo + BLOCK, len(pairs)))
            dx, dy = d[i, 0][:, None], d[i, 1][:, None]
            x, y = self.middles[:, 0] - a[i, 0][:, None], self.middles[:, 1] - a[i, 1][:, None]
            t = np.clip((x * dx + y * dy) / np.maximum(length2[i], 1e-12)[:, None], 0, 1)
            x -= t * dx
            y -= t * dy
            near = (t >= 0.15) & (t <= 0.85) & (np.sqrt(x * x + y * y) < r + clear)
            near[i - lo, pairs[i, 0]] = near[i - lo, pairs[i, 1]] = False
            blocked[i] = near.any(1) & (length2[i] >= 1)
        return {"ratio": float((w.sum() - w[blocked].sum()) / w.sum()), "violating": int(blocked.sum()), "pairs": len(pairs)}

    @cached_property
    def chains(self) -> list[list[int]]:
        """Runs of three nodes or more of at most two neighbours, from an end with one."""
        degree = [len(x) for x in self.neighbours]
        seen: set[int] = set()
        out = []
        for v in range(self.n):
            if v in seen or degree[v] != 1:
                continue
            way, before, at = [v], -1, v
            seen.add(v)
            while True:
                ways = sorted(w for w in self.neighbours[at] if w != before and degree[w] <= 2)
                if not ways or ways[0] in seen:
                    break
                before, at = at, ways[0]
                way.append(at)
                seen.add(at)
                if degree[at] != 2:
                    break
            if len(way) >= 3:
                out.append(way)
        return out

    def _of(self, measure: str, key: str, *args: float) -> object:
        """One value of a measurement, which is made once for all of its values."""
        if (measure, args) not in self._found:
            self._found[measure, args] = getattr(self, measure)(*args)
        return self._found[measure, args][key]

    def quality(self, ideal: float = 120.0) -> dict:
        parts = {
            "edge_visibility": self._of("edge_visibility", "ratio"),
            "no_overlap": 1 - min(1.0, self._of("node_overlap", "ratio") * 20),
            "few_crossings": 1 - min(1.0, self._of("edge_crossings", "normalised")),
            "low_stress": 1 - min(1.0, self._of("layout_stress", "per_edge", ideal) / 2),
            "gestalt_cohesion": self._of("gestalt_proximity", "cohesion"),
            "blob_integrity": self._of("blob_integrity", "ratio"),
        }
        score = sum(v * WEIGHTS[k] for k, v in parts.items()) / sum(WEIGHTS.values()) * 100
        return {"score": math.floor(score * 10 + 0.5) / 10, **parts}

    @cached_property
    def lines(self) -> list[dict]:
        return [linearity(self.at[c]) for c in self.chains]

    @cached_property
    def degrees(self) -> np.ndarray:
        return np.bincount(self.ends.reshape(-1), minlength=self.n)

    def _angles(self) -> list[float]:
        step = self.at[self.ends[:, 1]] - self.at[self.ends[:, 0]]
        return np.degrees(np.arctan2(step[:, 1], step[:, 0])).tolist()

    def facts(self, ideal: float = 120.0, only: Iterable[str] | None = None) -> dict:
        """Measurements, one value or list a column of ``FACTS``: all, or those of ``only``."""
        mean = lambda k: float(np.mean([x[k] for x in self.lines])) if self.lines else 1.0
        of = self._of
        columns = {
            "n_nodes": lambda: self.n,
            "module_count": lambda: len(set(self.groups)),
            "cross_edge_ratio": lambda: of("cross_edge_visibility", "count") / self.n_links if self.n_links else 0.0,
            "edge_visibility": lambda: of("edge_visibility", "ratio"),
            "avg_gap": lambda: of("edge_visibility", "avg_gap"),
            "min_gap": lambda: of("edge_visibility", "min_gap"),
            "node_overlap": lambda: of("node_overlap", "ratio"),
            "overlapping_pairs": lambda: of("node_overlap", "count"),
            "max_overlap": lambda: of("node_overlap", "max_overlap"),
            "edge_crossing_count": lambda: of("edge_crossings", "count"),
            "edge_crossing_ratio": lambda: of("edge_crossings", "ratio"),
            "edge_crossings": lambda: of("edge_crossings", "normalised"),
            "global_stress": lambda: of("layout_stress", "per_edge", ideal),
            "layout_stress": lambda: of("layout_stress", "per_edge", ideal, True),
            "hubs": lambda: of("hub_centrality", "hubs"),
            "hub_centrality_error": lambda: of("hub_centrality", "avg_normalised"),
            "chains": lambda: len(self.lines),
            "chain_elongation": lambda: mean("ratio"),
            "chain_straightness": lambda: mean("straightness"),
            "blob_integrity": lambda: of("blob_integrity", "ratio"),
            "module_separation": lambda: of("blob_separation", "min_clearance"),
            "avg_clearance": lambda: of("blob_separation", "avg_clearance"),
            "separation_ratio": lambda: of("blob_separation", "separation_ratio"),
            "overlapping_groups": lambda: of("blob_separation", "overlapping"),
            "within_distance": lambda: of("gestalt_proximity", "within"),
            "between_distance": lambda: of("gestalt_proximity", "between"),
            "gestalt_cohesion": lambda: of("gestalt_proximity", "cohesion"),
            "min_angle": lambda: of("angular_resolution", "min_angle"),
            "avg_min_angle": lambda: of("angular_resolution", "avg_min_angle"),
            "poor_angles": lambda: of("angular_resolution", "poor"),
            "edge_length": lambda: of("edge_length_uniformity", "mean"),
            "edge_length_cv": lambda: of("edge_length_uniformity", "cv"),
            "cross_edge_visibility": lambda: of("cross_edge_visibility", "ratio"),
            "cross_edge_count": lambda: of("cross_edge_visibility", "count"),
            "node_size_cv": lambda: of("node_size_variation", "cv"),
            "prominent_visibility": lambda: of("prominent_visibility", "ratio"),
            "blob_edge_routing": lambda: of("edge_routing", "ratio"),
            "blocked_corridors": lambda: of("edge_routing", "violating"),
            "corridor_crossings": lambda: of("corridor_crossings", "crossing"),
            "inter_module_crossings": lambda: of("corridor_crossings", "weighted_ratio"),
            "quality_score": lambda: of("quality", "score", ideal),
            "degree_mean": lambda: float(self.degrees.mean()) if self.n else 0.0,
            "degree_max": lambda: int(self.degrees.max(initial=0)),
            "degree_gini": lambda: gini(self.degrees),
            "degrees": lambda: self.degrees.tolist(),
            "edge_angles": self._angles,
            "points": lambda: [{"x": x, "y": y, "g": g} for (x, y), g in zip(self.at.tolist(), self.groups)],
            "chain_points": lambda: [[{"x": x, "y": y} for x, y in self.at[c].tolist()] for c in self.chains],
        }
        return {k: columns[k]() for k in (columns if only is None else only)}


_INTS = {"n_nodes", "module_count", "overlapping_pairs", "edge_crossing_count", "hubs", "chains", "overlapping_groups", "poor_angles", "cross_edge_count", "blocked_corridors", "corridor_crossings", "degree_max"}
_NESTED = {"degrees": "array<int>", "edge_angles": "array<double>", "points": "array<struct<x:double,y:double,g:string>>", "chain_points": "array<array<struct<x:double,y:double>>>"}
_ARROW = {
    "degrees": pa.list_(pa.int32()),
    "edge_angles": pa.list_(pa.float64()),
    "points": pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("g", pa.string())])),
    "chain_points": pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))),
}
_EMPTY = Drawing([], [], np.zeros((0, 2)), np.zeros(0), [])
#: Columns of facts with their types.
FACTS = {k: _NESTED.get(k, "int" if k in _INTS else "double") for k in _EMPTY.facts()}


def by_scenario(nodes: DataFrame, edges: DataFrame, treat: Callable[[str, Drawing], list[dict]], shape: dict[str, str], arrow: dict[str, pa.DataType]) -> DataFrame:
    """(scenario, …) of what ``treat`` gives for each scenario, which one task holds."""
    rows = nodes.select("scenario", C("id").alias("a"), F.lit(None).cast("string").alias("b"), "grp", C("x").cast("double"), C("y").cast("double"), F.coalesce(C("r").cast("double"), F.lit(6.0)).alias("r"))
    none = F.lit(None)
    rows = rows.unionByName(edges.select("scenario", C("source").alias("a"), C("target").alias("b"), none.cast("string").alias("grp"), *[none.cast("double").alias(x) for x in "xyr"]))

    def one(scenario: str, t: pa.Table) -> Iterator[pa.RecordBatch]:
        d = t.to_pydict()
        node = [i for i, b in enumerate(d["b"]) if b is None and d["x"][i] is not None]
        links = [(a, b) for a, b in zip(d["a"], d["b"]) if b is not None]
        pick = lambda c: [d[c][i] for i in node]
        drawing = Drawing(pick("a"), pick("grp"), np.array([pick("x"), pick("y")]).T, np.array(pick("r")), links)
        found = treat(scenario, drawing)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([scenario] * len(found), pa.string()), *[pa.array([r[k] for r in found], ty) for k, ty in arrow.items()]], names=["scenario", *arrow])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            names = b.column(0).to_pylist()
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if held and names[lo] != last:
                    yield from one(last, pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(lo, hi - lo))
                last = names[lo]
        if held:
            yield from one(last, pa.Table.from_batches(held))

    out = ", ".join(f"{k} {v}" for k, v in {"scenario": "string", **shape}.items())
    # by number, as few bytes of rows are much work: the planner would put them all into a task or two
    tasks = 8 * nodes.sparkSession.sparkContext.defaultParallelism
    return rows.where(C("scenario").isNotNull()).repartition(tasks, "scenario").sortWithinPartitions("scenario").mapInArrow(run, out)


def facts(nodes: DataFrame, edges: DataFrame, ideal: float = 120.0, only: list[str] | None = None) -> DataFrame:
    """(scenario, …) with the columns of ``FACTS``, or those of ``only``: measurements of each drawing.

    Nodes without a place are left out; a null radius is 6. Distances that need two groups are null without them.
    """
    shape = {k: FACTS[k] for k in (FACTS if only is None else only)}
    arrow = {k: _ARROW.get(k, pa.int32() if k in _INTS else pa.float64()) for k in shape}
    return by_scenario(nodes, edges, lambda _, d: [d.facts(ideal, shape)], shape, arrow)


#: Names of recorded measurements, as paths in their JSON.
_RECORDED = {
    "module_count": "moduleCount", "cross_edge_ratio": "crossEdgeRatio", "edge_visibility": "edgeVisibility.ratio", "avg_gap": "edgeVisibility.avgGap",
    "min_gap": "edgeVisibility.minGap", "node_overlap": "nodeOverlap.ratio", "max_overlap": "nodeOverlap.maxOverlap", "edge_crossing_count": "edgeCrossings.count",
    "edge_crossing_ratio": "edgeCrossings.ratio", "edge_crossings": "edgeCrossings.normalised", "global_stress": "layoutStress.perEdge", "layout_stress": "intraModuleStress.perEdge",
    "hub_centrality_error": "hubCentrality.avgNormalised", "chain_elongation": "chainLinearity.ratio", "chain_straightness": "chainLinearity.straightness",
    "blob_integrity": "blobIntegrity.ratio", "module_separation": "blobSeparation.minClearance", "gestalt_cohesion": "gestaltProximity.cohesion",
    "min_angle": "angularResolution.minAngle", "avg_min_angle": "angularResolution.avgMinAngle", "edge_length": "edgeLengthUniformity.mean", "edge_length_cv": "edgeLengthUniformity.cv",
    "cross_edge_visibility": "crossModuleEdgeVisibility.ratio", "cross_edge_count": "crossModuleEdgeVisibility.count", "node_size_cv": "nodeSizeVariation.cv",
    "prominent_visibility": "prominentNodeVisibility.ratio", "blob_edge_routing": "blobEdgeRouting.ratio", "inter_module_crossings": "interModuleCrossings.weightedRatio",
    "quality_score": "qualityScore.score", "degree_mean": "degreeDist.mean", "degree_max": "degreeDist.max", "degree_gini": "degreeDist.gini", "degrees": "degreeDist.values",
    "edge_angles": "edgeAngles", "points": "nodeList", "chain_points": "chainNodePos",
}


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Recorded measurements, one JSON file a scenario, which is named after the file. What a file lacks is null."""
    leaves: dict[str, dict[str, str]] = defaultdict(dict)
    for k, where in _RECORDED.items():
        head, _, tail = where.partition(".")
        leaves[head][tail] = FACTS[k]
    shape = ", ".join(f"{head} {types['']}" if "" in types else f"{head} struct<{', '.join(f'{t}: {v}' for t, v in types.items())}>" for head, types in leaves.items())
    rows = spark.read.schema(shape).json(path, multiLine=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1)
    return rows.select(name.alias("scenario"), *[C(v).alias(k) for k, v in _RECORDED.items()], F.size("nodeList").alias("n_nodes"))


# where to put things


def circular_order(groups: list[str], weights: dict[tuple[str, str], int]) -> list[str]:
    """An order round a circle with few crossings of the lines between groups, counted by the edges on both.

    Up to eight groups the best order of all, the first group staying where it is; beyond, neighbours are swapped as
    long as that helps.
    """
    if len(groups) <= 2:
        return list(groups)
    near: dict[str, dict[str, int]] = defaultdict(dict)
    for (a, b), w in weights.items():
        near[a][b] = near[b][a] = w

    def cost(order: list[str]) -> int:
        at, total = {g: i for i, g in enumerate(order)}, 0
        lines = [(*sorted((at[a], at[b])), w) for (a, b), w in weights.items() if a in at and b in at]
        for i, (lo, hi, w) in enumerate(lines):
            for x, y, v in lines[i + 1 :]:
                if len({lo, hi, x, y}) == 4 and (lo < x < hi) != (lo < y < hi):
                    total += w + v
        return total

    if len(groups) <= 8:
        return min(([groups[0], *rest] for rest in itertools.permutations(groups[1:])), key=cost)
    order, better = list(groups), True
    at = {g: i for i, g in enumerate(order)}
    while better:
        better = False
        for i in range(1, len(order) - 1):
            a, b = order[i], order[i + 1]
            # swapping neighbours changes only the crossings of a line at one with a line at the other
            change = 0
            for x, w in near[a].items():
                for y, v in near[b].items():
                    if x != y and b != x and a != y and x in at and y in at:
                        lo, hi = sorted((i, at[x]))
                        crossing = (lo < i + 1 < hi) != (lo < at[y] < hi)
                        change += -(w + v) if crossing else w + v
            if change < 0:
                order[i], order[i + 1] = b, a
                at[a], at[b] = i + 1, i
                better = True
    return order


def circular_orders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scenario, grp, place): the order of the groups round a circle, from 0."""

    def treat(_: str, d: Drawing) -> list[dict]:
        pairs, w = d.corridors
        weights = {(d.names[a], d.names[b]): int(k) for (a, b), k in zip(pairs.tolist(), w)}
        return [{"grp": g, "place": i} for i, g in enumerate(circular_order(d.names, weights))]

    return by_scenario(nodes, edges, treat, {"grp": "string", "place": "int"}, {"grp": pa.string(), "place": pa.int32()})


def place(members: DataFrame, orders: DataFrame | None = None, step: float = 24.0) -> DataFrame:
    """members (scenario, id, grp, r) with x, y: groups round a circle, members of each on a spiral by id.

    The circle is as large as the groups' discs need; groups follow ``orders`` or else their names. Nulls in grp are left out.
    """
    rows = members.where(C("grp").isNotNull() & C("scenario").isNotNull())
    at = orders if orders is not None else rows.select("scenario", "grp").distinct().withColumn("place", F.row_number().over(Window.partitionBy("scenario").orderBy("grp")) - 1)
    sized = rows.groupBy("scenario", "grp").agg(F.count(F.lit(1)).alias("k")).join(at, ["scenario", "grp"])
    whole = sized.groupBy("scenario").agg(F.count(F.lit(1)).alias("groups"), (F.sum(F.sqrt("k")) * step * 2 / (2 * math.pi)).alias("spread"))
    angle = 2 * math.pi * C("place") / C("groups")
    placed = sized.join(whole, "scenario").select("scenario", "grp", (F.cos(angle) * C("spread")).alias("cx"), (F.sin(angle) * C("spread")).alias("cy"))
    j = F.row_number().over(Window.partitionBy("scenario", "grp").orderBy("id")) - 1
    turned = rows.withColumn("j", j).join(placed, ["scenario", "grp"])
    out = lambda c, f: F.round(C(c) + F.sqrt("j") * step * f(C("j") * GOLDEN), 6)
    return turned.select("scenario", "id", "grp", "r", out("cx", F.cos).alias("x"), out("cy", F.sin).alias("y"))
