"""Problem 4: clusters of records that are alike in a few numbers.

Records are first counted by cell of a grid, so copies and dense groups become few weighted items; the number of cells
depends on the space that is filled, not on the rows. An item's set has the grid points in a ball around it, so sets of
near items have a high Jaccard similarity. MinHash bands over these sets give candidate pairs, the exact Jaccard
similarity verifies them, and connected components of the links form groups. Bands miss some pairs; since the set of a
cell is known from its place, the pairs that they may miss are looked up exactly. A component wider than a group may be
is loose: each of its items goes to the medoid of highest degree that it reaches by ascending links.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.operators.components import components
from symgrid.operators.rows import latest
from symgrid.sources.tables import keep, small

_OFFSET = 1 << 20


@dataclass(frozen=True)
class Grid:
    """How alike the records of a group are. All lengths but ``cell`` are in cells.

    cell: width of a cell in the units of the coordinates. reach: greatest distance of linked cells; records of linked
    cells are at most reach + sqrt(3) cells apart. ball: radius of an item's ball of points. bands, rows: MinHash.
    exact: whether pairs within reach that no band brings together are looked up too. widest: width above which a
    component is loose. least_degree: records within reach of a medoid at least, else its records are of no group.

    The defaults fit groups of radius 0.45 with middles 1.3 apart and other records 0.8 from every middle: two groups are
    0.4 apart at least, a group and other records 0.35, and a group is 9 cells wide.
    """

    cell: float = 0.1
    reach: float = 2.0
    ball: float = 4.0
    bands: int = 24
    rows: int = 3
    exact: bool = True
    widest: int = 10
    least_degree: int = 5

    def jaccard(self, d: np.ndarray) -> np.ndarray:
        """Exact Jaccard similarity of the point sets of items that lie d (n x 3, in cells) apart."""
        ball = _ball(self.ball)
        common = ((ball[None, :, :] - d[:, None, :]) ** 2).sum(2) <= self.ball**2
        n = common.sum(1)
        return n / (2 * len(ball) - n)

    @property
    def least_similarity(self) -> float:
        """The similarity of items ``reach`` apart: the least of those that are to be linked."""
        return float(self.jaccard(_ball(self.reach)).min())

    def number(self, *coordinates: Column) -> Column:
        """Number of the cell of three coordinates; 21 bits each, i.e. a million cells either way, beyond which the outermost holds."""
        x, y, z = [F.least(F.lit(_OFFSET - 1), F.greatest(F.lit(-_OFFSET), F.floor(c / self.cell))).cast("long") + _OFFSET for c in coordinates]
        return F.shiftleft(x, 42) + F.shiftleft(y, 21) + z


@functools.cache
def _ball(radius: float) -> np.ndarray:
    r = int(radius)
    grid = np.stack(np.meshgrid(*[np.arange(-r, r + 1)] * 3, indexing="ij"), -1).reshape(-1, 3)
    return grid[(grid**2).sum(1) <= radius**2].astype(np.int64)


def _unpack(ids: np.ndarray) -> np.ndarray:
    return np.stack([ids >> 42, (ids >> 21) & (2**21 - 1), ids & (2**21 - 1)], 1) - _OFFSET


def _pack(places: np.ndarray) -> np.ndarray:
    p = places + _OFFSET
    return (p[..., 0] << 42) + (p[..., 1] << 21) + p[..., 2]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _bands(grid: Grid) -> _Task:
    """(item, bucket) for each band: MinHash over the points of the item's ball."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = _ball(grid.ball)
        with np.errstate(over="ignore"):
            seeds = _mix(np.arange(1, grid.bands * grid.rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            for b in batches:
                for at in range(0, b.num_rows, 2000):
                    ids = b.column(0).slice(at, 2000).to_numpy()
                    codes = _mix(_pack(_unpack(ids)[:, None, :] + ball[None]).astype(np.uint64))
                    least = np.stack([_mix(codes ^ s).min(1) for s in seeds], 1).reshape(len(ids), grid.bands, grid.rows)
                    bucket = np.zeros((len(ids), grid.bands), np.uint64) + np.arange(grid.bands, dtype=np.uint64)
                    for r in range(grid.rows):
                        bucket = _mix(bucket * np.uint64(31) ^ least[:, :, r])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, grid.bands)), pa.array(bucket.reshape(-1).view(np.int64))], names=["item", "bucket"])

    return run


def _around(grid: Grid) -> _Task:
    """(a, b): each item with the cells within reach whose number is greater, filled or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = _ball(grid.reach)
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                ids = b.column(0).slice(at, 20_000).to_numpy()
                x, y = np.repeat(ids, len(near)), _pack(_unpack(ids)[:, None, :] + near[None]).reshape(-1)
                ok = y > x
                yield pa.RecordBatch.from_arrays([pa.array(x[ok]), pa.array(y[ok])], names=["a", "b"])

    return run


def _verify(grid: Grid) -> _Task:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = grid.least_similarity - 1e-12
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                x, y = (b.column(i).slice(at, 20_000).to_numpy() for i in (0, 1))
                # few distances are different, so each is compared once
                d, which = np.unique(_unpack(x) - _unpack(y), axis=0, return_inverse=True)
                ok = (grid.jaccard(d) >= least)[which.reshape(-1)]
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[ok]), pa.array(y[ok])], names=["a", "b"])

    return run


def candidates(items: DataFrame, grid: Grid) -> DataFrame:
    """(a, b), a < b: pairs of items that share a band."""
    bands = items.select("item").repartition(F.col("item")).mapInArrow(_bands(grid), "item long, bucket long")
    # by sort and merge: the planner doesn't know that Python multiplied the rows, and might broadcast them
    x, y = bands.hint("merge").alias("x"), bands.alias("y")
    pairs = x.join(y, "bucket").where(F.col("x.item") < F.col("y.item"))
    return pairs.select(F.col("x.item").alias("a"), F.col("y.item").alias("b")).distinct()


def links(items: DataFrame, grid: Grid) -> DataFrame:
    """(a, b), a < b: pairs of items of at least the similarity of items within reach."""
    found = candidates(items, grid).mapInArrow(_verify(grid), "a long, b long")
    if not grid.exact:
        return found
    near = items.select("item").mapInArrow(_around(grid), "a long, b long")
    there = items.select(F.col("item").alias("b"))
    missed = near.hint("merge").join(there, "b", "left_semi").join(found.hint("merge"), ["a", "b"], "left_anti").select("a", "b")
    return found.unionByName(missed.mapInArrow(_verify(grid), "a long, b long"))


def records(node_features: DataFrame) -> DataFrame:
    """(repo_id, hash, x, y, z) of the counting rows with all three values; null, NaN and what has no logarithm are no values."""
    names = ["pagerank", "hub_score", "utility_score"]
    rows = latest(node_features, ["repo_id", "hash"], "computed_at", names)
    for c in names:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c))
    at = [F.log10(F.col("pagerank") + 1e-6), F.log10(F.col("hub_score") + 1e-6), F.col("utility_score") / 5]
    rows = rows.select("repo_id", "hash", *[a.alias(c) for a, c in zip(at, "xyz")])
    return rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def groups(items: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """(item, n, group_id, degree, medoid) of weighted items (item, n); group_id is null for items of no group.

    degree is the weight of an item and all linked ones; the medoid is the item of a group with the highest degree,
    ties to the least item, and gives the group its id. An empty table gives no rows.
    """
    items = keep(items.select("item", "n"), "items")
    link = keep(links(items, grid), "links")
    both = link.unionByName(link.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both.join(items.select(F.col("item").alias("b"), "n"), "b").groupBy(F.col("a").alias("item")).agg(F.sum("n").alias("around"))
    comp = components(link, "a", "b").withColumnRenamed("id", "item")
    degree = F.col("n") + F.coalesce("around", F.lit(0))
    known = items.join(around, "item", "left").join(comp, "item", "left").select("item", "n", degree.alias("degree"), F.coalesce("component", "item").alias("component"))
    known = keep(known, "components")
    place = [F.shiftright("item", 42), F.shiftright("item", 21).bitwiseAND(2**21 - 1), F.col("item").bitwiseAND(2**21 - 1)]
    spans = known.groupBy("component").agg(*[(F.max(p) - F.min(p)).alias(f"w{i}") for i, p in enumerate(place)])
    wide = keep(spans.where(F.greatest("w0", "w1", "w2") > grid.widest).select("component"), "wide")
    loose = keep(known.join(small(wide), "component", "left_semi").select("item", "degree"), "loose")
    above = both.join(loose.select(F.col("item").alias("b"), F.col("degree").alias("d")), "b").groupBy(F.col("a").alias("item")).agg(F.max(F.struct("d", (-F.col("b")).alias("b"))).alias("best"))
    higher = F.struct(F.col("best.d").alias("d"), F.col("best.b").alias("b")) > F.struct(F.col("degree").alias("d"), (-F.col("item")).alias("b"))
    climb = loose.join(above, "item", "left").select("item", F.when(higher, -F.col("best.b")).otherwise(F.col("item")).alias("to"))
    split = components(climb, "item", "to").select(F.col("id").alias("item"), F.col("component").alias("part"))
    parted = known.join(split, "item", "left").select("item", "n", "degree", F.coalesce("part", "component").alias("part"))
    parted = keep(parted, "parts")
    top = parted.groupBy("part").agg(F.max(F.struct("degree", (-F.col("item")).alias("i"))).alias("m")).where(F.col("m.degree") >= grid.least_degree)
    named = parted.join(top.select("part", (-F.col("m.i")).alias("group_id")), "part", "left")
    return named.select("item", "n", "degree", "group_id", F.coalesce(F.col("item") == F.col("group_id"), F.lit(False)).alias("medoid"))


def cluster(node_features: DataFrame, grid: Grid = Grid()) -> tuple[DataFrame, DataFrame]:
    """The records, with their item, and the groups of their items."""
    rows = records(node_features).withColumn("item", grid.number(F.col("x"), F.col("y"), F.col("z")))
    rows = keep(rows, "records")
    return rows, keep(groups(rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")), grid), "groups")


def membership(node_features: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """(repo_id, hash, group_id) of each record; null for those of no group."""
    rows, of = cluster(node_features, grid)
    return rows.join(small(of.select("item", "group_id")), "item", "left").select("repo_id", "hash", "group_id")


def summary(node_features: DataFrame, typical: int = 3, grid: Grid = Grid()) -> DataFrame:
    """(group_id, n_records, typical): size and the records nearest to the group's mean, of those in its medoid's cell."""
    rows, of = cluster(node_features, grid)
    sized = of.where(F.col("group_id").isNotNull()).groupBy("group_id").agg(F.sum("n").alias("n_records"))
    inside = rows.join(small(of.select("item", "group_id").where("group_id IS NOT NULL")), "item")
    middle = keep(inside.groupBy("group_id").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"]), "middles")
    near = inside.where(F.col("item") == F.col("group_id")).join(small(middle), "group_id")
    far = sum((F.col(c) - F.col(f"m{c}")) ** 2 for c in "xyz")
    # the rank limit is applied before the shuffle, so a group leaves a few rows a task
    first = near.withColumn("far", F.round(far, 12)).withColumn("r", F.row_number().over(Window.partitionBy("group_id").orderBy("far", "repo_id", "hash"))).where(F.col("r") <= typical)
    listed = first.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "repo_id", "hash"))), lambda s: F.concat_ws(" ", s["repo_id"], s["hash"])).alias("typical"))
    return sized.join(listed, "group_id").select("group_id", "n_records", "typical")


def probes_together(node_features: DataFrame, probes: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """(probe_a, probe_b), probe_a < probe_b: probes whose records lie in the same group. probes is a short list of records.

    Records are read once: each item is counted along with the probes in it.
    """
    mine = probes.select("probe_id", "repo_id", "hash").distinct()
    rows = records(node_features).join(small(mine.groupBy("repo_id", "hash").agg(F.collect_list("probe_id").alias("probes"))), ["repo_id", "hash"], "left")
    rows = rows.withColumn("item", grid.number(F.col("x"), F.col("y"), F.col("z")))
    items = keep(rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.flatten(F.collect_list("probes")).alias("probes")), "probed")
    wanted = items.where(F.size("probes") > 0).select("item", F.explode("probes").alias("probe_id"))
    of = groups(items, grid).where(F.col("group_id").isNotNull()).select("item", "group_id")
    mine = keep(of.join(small(wanted), "item").select("probe_id", "group_id").distinct(), "probes")
    a, b = mine.withColumnRenamed("probe_id", "probe_a"), mine.withColumnRenamed("probe_id", "probe_b")
    return a.join(b, "group_id").where(F.col("probe_a") < F.col("probe_b")).select("probe_a", "probe_b").distinct()
