"""Problem 3: the first N items of every group, by merging sorted runs.

Each partition is sorted by group and order: a run. A run gives at most N items of a group and then seeks to the next
group, so a group with a third of all rows leaves N rows a run. The cut runs are sent to buckets by group and lie there
in the shuffle's files, sorted by group, run and order. A bucket is read one group at a time: a loser tree merges the
runs of the group and, after N outputs, the reader seeks to the next group. So a task holds the rows of one group, at
most N for each run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class LoserTree:
    """Merges sorted sequences: ``key`` is that of the least head, ``pop`` takes it and replays its path to the top."""

    def __init__(self, runs: list[list]) -> None:
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.k, self.lost = k, [-1] * max(k, 1)
        winners = [*[-1] * k, *range(k)]
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if self._before(b, a):
                a, b = b, a
            winners[node], self.lost[node] = a, b
        self.top = winners[1] if k else -1

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head(a), self.head(b)
        return y is None or (x is not None and (x, a) < (y, b))

    def head(self, run: int):
        at, rows = self.at[run], self.runs[run]
        return rows[at] if at < len(rows) else None

    def pop(self, to: int | None = None):
        """The least item; its run moves one on, or to position ``to``."""
        run = self.top
        item = self.head(run)
        self.at[run] = self.at[run] + 1 if to is None else to
        node = (run + self.k) // 2
        while node:
            if self._before(self.lost[node], run):
                run, self.lost[node] = self.lost[node], run
            node //= 2
        self.top = run
        return item


def merge_group(runs: list[list[tuple]], n: int) -> Iterator[tuple]:
    """The first n items of sorted runs."""
    tree = LoserTree(runs)
    for _ in range(n):
        if tree.top < 0 or tree.head(tree.top) is None:
            return
        yield tree.pop()


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row differs from the one before it in some column; the first row does."""
    n = len(columns[0])
    new = np.ones(n, dtype=bool)
    if n > 1:
        new[1:] = np.logical_or.reduce([pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in columns])
    return new


def _cut(n: int, group: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the first n rows of each group in sorted batches and seeks to the next one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(c) for c in group]
            first = np.flatnonzero(_starts(columns))
            lengths = np.diff(np.append(first, b.num_rows))
            place = np.arange(b.num_rows) - np.repeat(first, lengths)
            if [c[0].as_py() for c in columns] == last:
                place[: lengths[0]] += seen
            last, seen = [c[-1].as_py() for c in columns], int(place[-1]) + 1
            if (at := np.flatnonzero(place < n)).size:
                yield b.take(pa.array(at)) if at.size < b.num_rows else b

    return cut


def _merge(n: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by group, run and order in; (group…, rank, tie) of the first n of each group out."""
    types = [*[pa.string()] * len(names), pa.int32(), pa.string()]
    out_names = [*names, "r", "t"]

    def treat(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        columns = [t.column(c).combine_chunks() for c in ("h", *names)]
        new_group = _starts(columns)
        new_run = new_group | _starts([t.column("run").combine_chunks()])
        groups = np.append(np.flatnonzero(new_group), t.num_rows)
        runs = np.append(np.flatnonzero(new_run), t.num_rows)
        at_run = np.searchsorted(runs, groups)
        score, tie = t.column("s").to_numpy(), t.column("t").combine_chunks()
        keep_, rank = [], []
        for i in range(len(groups) - 1):
            lo, hi = groups[i], groups[i + 1]
            some = runs[at_run[i] : at_run[i + 1] + 1]
            if len(some) == 2:  # one run: it is in order
                top = range(lo, min(hi, lo + n))
            else:
                keys = list(zip(score[lo:hi].tolist(), tie.slice(lo, hi - lo).to_pylist(), range(lo, hi)))
                top = [x[2] for x in merge_group([keys[a - lo : b - lo] for a, b in zip(some, some[1:])], n)]
            keep_ += top
            rank += range(1, len(top) + 1)
        taken = t.take(pa.array(keep_, pa.int64()))
        columns = [*[taken.column(c).combine_chunks() for c in names], pa.array(rank, pa.int32()), taken.column("t").combine_chunks()]
        return pa.RecordBatch.from_arrays([c.cast(ty) for c, ty in zip(columns, types)], names=out_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(c) for c in ("h", *names)]
            first = np.flatnonzero(_starts(columns))
            ends = [held[-1].column(c)[-1].as_py() for c in ("h", *names)] if held else None
            same = ends == [c[0].as_py() for c in columns]
            # all groups but the last are whole once the next one begins
            cut = int(first[-1])
            if cut or (held and not same):
                whole = [*held, b.slice(0, cut)]
                yield treat(pa.Table.from_batches(whole))
                held = [b.slice(cut)]
            else:
                held.append(b)
        if held:
            yield treat(pa.Table.from_batches(held))

    return run


def top_n(df: DataFrame, group: list[str], score: str, tie: str, n: int, buckets: int | None = None) -> DataFrame:
    """(group…, rank_no, tie) of the n rows of each group with the greatest ``score``, then the least ``tie`` (by bytes).

    group and tie are strings, score a double. Rows with null or NaN score or a null in group or tie are left out;
    rows alike in group, score and tie are items of their own, in any order. Other columns are dropped, so names
    can't clash. n < 1 or an empty table gives no rows. -0.0 equals 0.0. Groups are told by all of their columns; their
    hash only leads them to buckets.
    """
    names = [f"g{i}" for i in range(len(group))]
    value = F.col(score).cast("double") + F.lit(0.0)
    ok: Column = value.isNotNull() & ~F.isnan(value) & F.col(tie).isNotNull()
    for g in group:
        ok &= F.col(g).isNotNull()
    rows = df.where(ok).select(*[F.col(g).alias(a) for g, a in zip(group, names)], (-value).alias("s"), F.col(tie).alias("t"))
    rows = rows.withColumn("h", F.xxhash64(*names))
    shape = ", ".join([*(f"{a} string" for a in names), "s double", "t string", "h long"])
    runs = rows.sortWithinPartitions("h", *names, "s", "t").mapInArrow(_cut(n, ["h", *names]), shape).withColumn("run", F.spark_partition_id())
    by = ["h", *names]
    bucketed = runs.repartition(*([buckets] if buckets else []), *by).sortWithinPartitions(*by, "run", "s", "t")
    merged = bucketed.mapInArrow(_merge(n, names), ", ".join([*(f"{a} string" for a in names), "r int", "t string"]))
    return merged.select(*[F.col(a).alias(g) for g, a in zip(group, names)], F.col("r").alias("rank_no"), F.col("t").alias(tie))
