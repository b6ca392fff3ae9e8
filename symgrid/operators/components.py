"""Connected components of links, by union-find in each task and alternating large and small stars between tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrid.sources.tables import forget, keep

#: Links up to which one task unites all of them (some 100 MB of arrays). More are first contracted in many tasks.
ONE_TASK = 2_000_000
#: Links that a task holds at once.
HELD = 500_000
_SHAPE = "u long, v long"


def unite(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of links and the least end that each is connected to."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    of = np.arange(len(ids))
    while True:
        x, y = of[a], of[b]
        open_ = x != y
        if not open_.any():
            return ids, ids[of]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(of, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = of[of]
            if (up == of).all():
                break
            of = up


def contract(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of a task to one link from each end to the least end it is connected to; ``whole`` unites all of the task's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def united() -> tuple[np.ndarray, np.ndarray]:
            t = pa.Table.from_batches(held)
            ids, least = unite(t.column(0).to_numpy(), t.column(1).to_numpy())
            return ids[ids != least], least[ids != least]

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= HELD:
                u, v = united()
                star = pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                if whole or len(u) < HELD // 2:  # what is contracted meets the next links
                    held = [star]
                else:
                    yield star
                    held = []
        if held:
            u, v = united()
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(rest).distinct()


def components(links: DataFrame, a: str, b: str, one_task: int = ONE_TASK, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every end of a link; ends are whole numbers, component is the least one in it.

    Null ends and links of an id to itself connect nothing, the latter's id is still listed. Each task first contracts
    its own links. What is left is united in one task where it has at most ``one_task`` links, which bounds that task,
    else by rounds of stars, each contracted again; their number grows with the logarithm of the longest path. Both
    ways give the same components. Each round is written to the shared folder and the one before it deleted; joins
    carry one row an id on one side, so a hub only makes a skewed partition that adaptive execution splits.
    """
    ends = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    ends = keep(ends, "ends")
    e = keep(ends.where(F.col("u") != F.col("v")).mapInArrow(contract(False), _SHAPE), "links")
    before = None
    for _ in range(most_rounds):
        # links are stars once a round changes nothing
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")).first()
        if now == before:
            break
        old, before = e, now
        if now.n <= one_task:
            e = keep(e.coalesce(1).mapInArrow(contract(True), _SHAPE), "stars")
            forget(old)
            break
        e = keep(_small_star(_large_star(e.mapInArrow(contract(False), _SHAPE))), "stars")
        forget(old)
    else:
        raise RuntimeError("components did not settle")
    ids = ends.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return ids.join(e.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
