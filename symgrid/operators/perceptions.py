"""What a viewer makes of a drawing: raw readings of its facts, composed scores, archetypes, limits and conformance."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgrid.operators.layout import convex_hull

C = F.col
RAW = [
    "module_count", "module_separation", "blob_integrity", "gestalt_cohesion", "blob_edge_routing", "inter_module_crossings",
    "cross_edge_visibility", "cross_edge_count", "cross_edge_ratio", "edge_visibility", "chain_elongation", "chain_straightness",
    "hub_centrality_error", "node_size_cv", "node_overlap", "edge_crossings", "layout_stress", "degree_gini", "hub_degree_ratio",
    "degree_entropy", "edge_angle_entropy", "graph_aspect_ratio", "spatial_compactness", "silhouette_by_module",
    "spatial_cluster_purity", "chain_r2",
]
#: A drawing's lists, and the readings that need them.
_LISTS = ["module_count", "degrees", "edge_angles", "points", "chain_points"]
_READ = ["degree_entropy", "edge_angle_entropy", "graph_aspect_ratio", "spatial_compactness", "silhouette_by_module", "spatial_cluster_purity", "chain_r2"]


def entropy(values: list[int]) -> float:
    """Entropy of the values' frequencies as a share of that of all different ones."""
    counts = np.array(list(Counter(values).values()), float)
    if len(counts) <= 1:
        return 0.0
    p = counts / counts.sum()
    return float(-(p * np.log2(p + 1e-12)).sum() / math.log2(len(values)))


def angle_entropy(angles: list[float], bins: int = 18) -> float:
    """Entropy of directions in bins of 20 degrees, from 0 to 1; 1 for fewer than two edges."""
    n = np.histogram(angles, bins=bins, range=(-180, 180))[0] if len(angles) > 1 else np.zeros(1)
    if not n.sum():
        return 1.0
    p = n[n > 0] / n.sum()
    return float(min(1.0, -(p * np.log2(p)).sum() / math.log2(bins)))


def spread(points: np.ndarray) -> tuple[float, float]:
    """Sample variances along the main axis and across it."""
    low, high = np.linalg.eigvalsh(np.cov(points.T))
    return float(high), float(max(low, 0.0))


def silhouette(points: np.ndarray, groups: np.ndarray, block: int = 128) -> float:
    """Mean over points of (distance to the nearest other group - own) / the greater; 0 for a point alone in its group."""
    g = np.unique(groups, return_inverse=True)[1]
    order = np.argsort(g, kind="stable")
    points, g = points[order], g[order]
    size = np.bincount(g)
    first = np.cumsum(size) - size
    out = np.zeros(len(points))
    for lo in range(0, len(points), block):
        i = np.arange(lo, min(lo + block, len(points)))
        far, y = points[i, 0][:, None] - points[:, 0], points[i, 1][:, None] - points[:, 1]
        far *= far
        y *= y
        far += y
        np.sqrt(far, out=far)
        sums = np.add.reduceat(far, first, axis=1)
        own = g[i]
        a = sums[np.arange(len(i)), own] / np.maximum(size[own] - 1, 1)
        mean = sums / size
        mean[np.arange(len(i)), own] = np.inf
        b = mean.min(1)
        top = np.maximum(a, b)
        out[i] = np.where((size[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
    return float(out.mean())


def _nearest(points: np.ndarray, middle: np.ndarray, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Of each point the nearest middle, the first of equal ones, and the distance of the second nearest."""
    own, second = np.zeros(len(points), np.int64), np.full(len(points), np.inf)
    for lo in range(0, len(points), block):
        p = points[lo : lo + block]
        d, y = p[:, 0][:, None] - middle[:, 0], p[:, 1][:, None] - middle[:, 1]
        d *= d
        y *= y
        d += y
        own[lo : lo + block] = i = d.argmin(1)
        d[np.arange(len(p)), i] = np.inf
        second[lo : lo + block] = np.sqrt(d.min(1))
    return own, second


def k_means(points: np.ndarray, k: int, starts: int = 10, seed: int = 42) -> np.ndarray:
    """Clusters of least squared distance of several starts, each spread out by distance.

    A point is compared with all middles only if these have moved so far that another one may be the nearest.
    """
    rng, best, least = np.random.default_rng(seed), np.zeros(len(points), int), np.inf
    scale = np.abs(points).max(initial=1.0)
    for _ in range(starts):
        middle = np.empty((k, 2))
        middle[0] = points[rng.integers(len(points))]
        d = ((points - middle[0]) ** 2).sum(1)
        for i in range(1, k):
            total = d.sum()
            middle[i] = points[rng.choice(len(points), p=d / total if total else None)]
            np.minimum(d, ((points - middle[i]) ** 2).sum(1), out=d)
        own, second = _nearest(points, middle)
        for step in range(300):
            if step:
                second -= np.where(own == moved.argmax(), np.partition(moved, -2)[-2] if k > 1 else 0.0, moved.max())
                near = np.hypot(*(points - middle[own]).T)
                again = np.nonzero(near >= second - 1e-9 * scale)[0]  # more than rounding
                own[again], second[again] = _nearest(points[again], middle)
            n = np.bincount(own, minlength=k)
            new = np.stack([np.bincount(own, x, k) for x in points.T], 1) / np.maximum(n, 1)[:, None]
            new[n == 0] = middle[n == 0]
            if np.allclose(new, middle):
                break
            moved, middle = np.hypot(*(new - middle).T), new
        cost = ((points - middle[own]) ** 2).sum()
        if cost < least:
            best, least = own.copy(), cost
    return best


def rand_index(a: np.ndarray, b: np.ndarray) -> float:
    """Adjusted for chance: 1 for equal divisions, about 0 for unrelated ones."""
    _, a = np.unique(a, return_inverse=True)
    _, b = np.unique(b, return_inverse=True)
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    pairs = lambda x: (x * (x - 1) / 2).sum()
    both, rows, columns, n = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), len(a) * (len(a) - 1) / 2
    chance, top = rows * columns / n, (rows + columns) / 2
    return 1.0 if top == chance else float((both - chance) / (top - chance))


def read_lists(modules: int, degrees: list[int], angles: list[float], points: list[dict], chains: list[list[dict]]) -> list[float]:
    """The readings ``_READ`` of one drawing. What can't be told of so few points is 1."""
    at = np.array([[p["x"], p["y"]] for p in points], float).reshape(-1, 2)
    groups = np.array([p["g"] or "" for p in points])
    aspect, compact, sil, pure = 1.0, 1.0, 1.0, 1.0
    if len(at) >= 3:
        high, low = spread(at)
        aspect = math.sqrt(high / (low + 1e-6))
    if len(at) >= 4:
        hull = convex_hull([tuple(p) for p in at.tolist()])
        area = abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(hull, hull[1:] + hull[:1]))) / 2
        compact = 1.0 if area == 0 else min(1.0, area / (np.ptp(at[:, 0]) * np.ptp(at[:, 1]) + 1e-6))
    if modules >= 2 and len(at) >= max(4, modules + 1):
        many = len(set(groups)) > 1
        sil = silhouette(at, groups) if many else 0.0
        pure = max(0.0, rand_index(groups, k_means(at, modules)))
    straight = []
    for c in chains:
        if len(c) >= 3:
            high, low = spread(np.array([[p["x"], p["y"]] for p in c], float))
            straight.append(high / (high + low) if high + low else 0.0)
    return [entropy(degrees), angle_entropy(angles), aspect, compact, sil, pure, float(np.mean(straight)) if straight else 1.0]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of flat columns and the lists that ``read_lists`` wants last: its readings in place of the lists."""
    for b in batches:
        flat, lists = b.columns[: -len(_LISTS)], b.columns[-len(_LISTS) :]
        for i in range(b.num_rows):  # one drawing's lists at a time
            row = [c[i].as_py() for c in lists]
            found = read_lists(*[v if v is not None else 1 if j == 0 else [] for j, v in enumerate(row)])
            yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in flat], *[pa.array([v], pa.float64()) for v in found]], names=[*b.schema.names[: len(flat)], *_READ])


def raw(facts: DataFrame) -> DataFrame:
    """(scenario, …) with the columns of ``RAW``. A separation or a chain that there isn't reads 0 and 1."""
    given = {"module_count": 1, "module_separation": 0.0, "chain_elongation": 1.0, "chain_straightness": 1.0, "cross_edge_ratio": 0.0, "blob_edge_routing": 1.0, "inter_module_crossings": 0.0, "degree_gini": 0.0}
    own = [F.coalesce(C(k), F.lit(v)).alias(k) for k, v in given.items()]
    rest = [k for k in RAW if k not in given and k not in _READ and k != "hub_degree_ratio"]
    ratio = F.coalesce("degree_max", F.lit(0)) / F.coalesce(F.nullif("degree_mean", F.lit(0.0)), F.lit(1.0))
    flat = [C("scenario"), *own, *[C(k) for k in rest], ratio.alias("hub_degree_ratio")]
    rows = facts.where(C("scenario").isNotNull())
    # the flat columns go along with the lists: a join would have every drawing measured twice
    shape = ", ".join([*(f"{n} {t}" for n, t in rows.select(*flat).dtypes), *(f"{c} double" for c in _READ)])
    return rows.select(*flat, *[C(c).alias(f"l_{c}") for c in _LISTS]).mapInArrow(_read, shape).select("scenario", *RAW)


#: Columns of facts that readings come from.
NEEDED = [*dict.fromkeys([*(k for k in RAW if k not in _READ and k != "hub_degree_ratio"), "degree_max", "degree_mean", *_LISTS])]


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def composed(r: DataFrame) -> DataFrame:
    """Fifteen scores made of readings, added as columns."""
    sil, elongation = (C("silhouette_by_module") + 1) / 2, _clamp(C("chain_elongation") / 3)
    separation = C("module_separation")
    first = {
        "chain_quality": C("chain_r2") * elongation * C("chain_straightness"),
        "hub_clarity": C("degree_gini") * (1 - C("hub_centrality_error")),
        "module_clarity": sil * C("blob_integrity") * (1 - C("cross_edge_ratio")),
        "readability": C("edge_visibility") * (1 - C("node_overlap")) * (1 - C("edge_crossings")),
        "layout_efficiency": C("spatial_compactness") * (1 - _clamp(C("layout_stress") / 5)) * C("edge_visibility"),
        "structural_complexity": F.log1p(C("cross_edge_count") * C("module_count") * C("cross_edge_ratio")),
        "coupling_tension": C("cross_edge_ratio") * F.greatest(F.lit(0.0), 1 - separation / 80),
        "isolation_risk": 1 - C("gestalt_cohesion"),
        "visual_entropy": (C("edge_angle_entropy") + C("degree_entropy")) / 2,
        "degree_imbalance": C("degree_gini") * F.least(F.lit(1.0), C("hub_degree_ratio") / 10),
        "hub_prominence": C("hub_degree_ratio") * (1 - C("hub_centrality_error")) * C("degree_gini"),
        "blob_health": C("blob_integrity") * F.when(C("module_count") < 2, 1.0).when(separation > 0, separation / (separation + 30)).otherwise(0.0),
        "spatial_disorder": 1 - sil,
    }
    second = {
        "chain_hub_conflict": F.abs(C("chain_quality") - C("hub_clarity")),
        "information_density": C("structural_complexity") * (1 + C("node_size_cv")) / (C("edge_visibility") + 0.01),
    }
    return r.withColumns(first).withColumns(second)


def archetypes(p: DataFrame) -> DataFrame:
    """Five shapes that a drawing may have, each 1.0 or 0.0."""
    rules = {
        "chain": (C("chain_elongation") >= 2.0) & (C("degree_gini") <= 0.30) & (C("chain_r2") >= 0.85),
        "hub": (C("degree_gini") >= 0.45) & (C("hub_degree_ratio") >= 3.0) & (C("hub_centrality_error") <= 0.45),
        "modular": (C("module_count") >= 2) & (C("blob_integrity") >= 0.82) & (C("silhouette_by_module") >= 0.25),
        "hairball": (C("edge_crossings") >= 0.40) & (C("node_overlap") >= 0.05),
        "spaghetti": (C("cross_edge_ratio") >= 0.25) & (C("module_count") >= 2) & (C("module_separation") <= 20.0),
    }
    return p.withColumns({f"archetype_{k}": v.cast("double") for k, v in rules.items()})


def limits(p: DataFrame) -> DataFrame:
    """What a reading would have to be at least for a score, and the best score there can be; infinite where none is enough.

    In closed form: the least value of a range at which a product reaches its goal.
    """
    least = lambda goal, factor, lo, hi: F.when((factor > 0) & (goal / F.nullif(factor, F.lit(0.0)) <= hi), F.greatest(F.lit(lo), goal / F.nullif(factor, F.lit(0.0)))).otherwise(F.lit(math.inf))
    whole = C("blob_integrity") * (1 - C("cross_edge_ratio"))
    half, chain = whole / 2, _clamp(C("chain_elongation") / 3) * C("chain_straightness")
    return p.withColumns({
        "required_silhouette": least(0.5 - half, half, -1.0, 1.0),
        "required_chain_r2": least(F.lit(0.70), chain, 0.0, 1.0),
        "module_clarity_ceiling": F.when(whole > 0, F.least(F.lit(1.0), whole)).otherwise(whole),
        "chain_quality_ceiling": chain,
    })


def _at_least(name: str, goal: float, scale: float = 1.0) -> tuple[Column, Column]:
    return C(name) >= goal, (goal - C(name)) / scale


def _at_most(name: str, goal: float) -> tuple[Column, Column]:
    return C(name) <= goal, C(name) - goal


def _if(condition: Column, rule: tuple[Column, Column]) -> tuple[Column, Column]:
    return ~condition | rule[0], rule[1]


def standards() -> list[tuple[float, tuple[Column, Column]]]:
    """What a drawing should meet: weight, whether it does, and how far it is off."""
    modular = C("module_count") >= 2
    return [
        (1.0, _at_least("edge_visibility", 0.65)),
        (1.0, _at_most("node_overlap", 0.15)),
        (1.0, _at_most("edge_crossings", 0.65)),
        (1.0, _at_most("layout_stress", 2.5)),
        (0.8, _at_least("gestalt_cohesion", 0.30)),
        (1.2, _if(modular, _at_least("blob_integrity", 0.75))),
        (1.2, _if(modular, _at_least("module_separation", 10.0, 100.0))),
        (1.0, _if(modular, _at_least("silhouette_by_module", 0.10))),
        (0.8, _if(modular, _at_least("spatial_cluster_purity", 0.10))),
        (1.0, _if(C("chain_elongation") >= 1.4, _at_least("chain_r2", 0.60))),
        (1.0, _if(C("chain_r2") >= 0.60, _at_least("chain_elongation", 1.40))),
        (1.0, _if(C("degree_gini") >= 0.40, _at_most("hub_centrality_error", 0.45))),
        (1.0, _if(C("cross_edge_count") >= 2, _at_least("cross_edge_visibility", 0.60))),
        (0.6, _at_least("spatial_compactness", 0.20)),
        (0.6, _at_least("degree_entropy", 0.20)),
        (1.2, _at_least("readability", 0.35)),
        (1.0, _at_least("module_clarity", 0.05)),
        (0.8, _if(C("chain_elongation") >= 1.0, _at_least("chain_quality", 0.20))),
        (1.0, _at_least("blob_health", 0.40)),
        (0.8, _at_most("information_density", 4.0)),
    ]


def conformance(p: DataFrame) -> DataFrame:
    """Adds the number, sum and worst of weighted violations, and the share of weights met."""
    rules = F.array(*[F.struct(F.lit(w).alias("w"), ok.alias("ok"), (off * w).cast("double").alias("off")) for w, (ok, off) in standards()])
    broken = F.filter(rules, lambda r: ~r["ok"])
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, r: a + f(r))
    return p.withColumns({
        "worst_violation": F.coalesce(F.array_max(F.transform(broken, lambda r: r["off"])), F.lit(0.0)),
        "violation_count": F.size(broken).cast("double"),
        "violation_score": total(broken, lambda r: r["off"]),
        "layout_conformance": total(rules, lambda r: F.when(r["ok"], r["w"]).otherwise(0.0)) / total(rules, lambda r: r["w"]),
    })


def perceptions(facts: DataFrame) -> DataFrame:
    """(scenario, …): 26 readings, 15 scores, 5 archetypes, 4 limits and 4 numbers of conformance of each drawing."""
    return conformance(limits(archetypes(composed(raw(facts)))))


def judge(p: DataFrame, rules: list[tuple[str, str | None, str]]) -> DataFrame:
    """(scenario, viewer, satisfied, score, violations) by rules (viewer, condition or None, demand), both SQL over the readings.

    A rule whose condition doesn't hold is met. score is the share of rules met, violations are the demands that aren't.
    """
    by: dict[str, list[Column]] = {}
    for viewer, condition, demand in rules:
        ok = F.expr(demand) if condition is None else ~F.expr(condition) | F.expr(demand)
        text = demand if condition is None else f"{condition} => {demand}"
        by.setdefault(viewer, []).append(F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(text).alias("text")))
    views = []
    for viewer, each in by.items():
        broken = F.transform(F.filter(F.array(*each), lambda r: ~r["ok"]), lambda r: r["text"])
        views.append(F.struct(F.lit(viewer).alias("viewer"), (F.size(broken) == 0).alias("satisfied"), (1 - F.size(broken) / len(each)).alias("score"), broken.alias("violations")))
    if not views:
        return p.select("scenario", F.lit("").alias("viewer"), F.lit(True).alias("satisfied"), F.lit(1.0).alias("score"), F.array().cast("array<string>").alias("violations")).limit(0)
    return p.select("scenario", F.explode(F.array(*views)).alias("v")).select("scenario", "v.*")


def averages(judged: DataFrame) -> DataFrame:
    """(viewer, scenarios, satisfied, mean_score) over all drawings."""
    return judged.groupBy("viewer").agg(F.count(F.lit(1)).alias("scenarios"), F.count_if("satisfied").alias("satisfied"), F.round(F.avg("score"), 6).alias("mean_score"))


