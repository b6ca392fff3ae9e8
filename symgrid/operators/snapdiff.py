"""Problem 7: what changed between consecutive full snapshots.

All snapshots of a project are sorted together by key, so equal keys of all of them lie side by side. Chunks of the
sorted keys end where a key's own hash says so: an inserted key changes its own chunk only. Chunks whose digest is the
same in a snapshot and the one before it are discarded; rows of the others are joined by key and classified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.sources.tables import BROADCAST_ROWS, keep, small

#: Keys of a chunk on average.
CHUNK_KEYS = 64


def complete_exports(snapshots: DataFrame) -> DataFrame:
    """(project, repo_id, ord): the complete exports, numbered from 1 by ``exported_at`` (ties by repo_id) within a project."""
    once = snapshots.where(F.col("export_state") == "complete").groupBy("project", "repo_id").agg(F.max("exported_at").alias("at"))
    return once.select("project", "repo_id", F.row_number().over(Window.partitionBy("project").orderBy("at", "repo_id")).alias("ord"))


def content(hash_: str) -> F.Column:
    """What a symbol's hash says of its body: the part after the first colon; of ``ext:`` or without a colon all of it."""
    h = F.col(hash_)
    return F.when(h.startswith("ext:") | ~h.contains(":"), h).otherwise(F.expr(f"substring({hash_}, instr({hash_}, ':') + 1)"))


def node_entries(nodes: DataFrame) -> DataFrame:
    """(entity, repo_id, key_1, key_2, value): by module and name the latest row, then the greatest hash; null keys left out."""
    rows = nodes.where(F.col("module").isNotNull() & F.col("name").isNotNull()).groupBy("repo_id", F.col("module").alias("key_1"), F.col("name").alias("key_2")).agg(F.max(F.struct("loaded_at", "hash")).alias("r"))
    return rows.select(F.lit("node").alias("entity"), "repo_id", "key_1", "key_2", F.col("r.hash").alias("hash")).withColumn("value", content("hash")).drop("hash")


def module_edge_entries(module_edges: DataFrame) -> DataFrame:
    """As ``node_entries``, by caller and callee module; the value is the count, a null count is the lowest."""
    rows = module_edges.where(F.col("caller_module").isNotNull() & F.col("callee_module").isNotNull()).groupBy("repo_id", F.col("caller_module").alias("key_1"), F.col("callee_module").alias("key_2")).agg(F.max(F.struct("loaded_at", "edge_count")).alias("r"))
    return rows.select(F.lit("module_edge").alias("entity"), "repo_id", "key_1", "key_2", F.col("r.edge_count").cast("string").alias("value"))


def _number_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends to each row of a sorted partition the number of its chunk. Reads ``h`` (hash of the key), ``part``."""
    last, chunk = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        h = b.column("h").to_numpy()
        before = np.concatenate([[h[0] if last is None else last], h[:-1]])
        steps = np.cumsum((h != before) & (h % CHUNK_KEYS == 0)) + chunk
        last, chunk = h[-1], int(steps[-1])
        ids = steps + b.column("part").to_numpy().astype("int64") * (1 << 36)
        keep_ = [i for i, n in enumerate(b.schema.names) if n not in ("h", "part")]
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep_], pa.array(ids, pa.int64())], names=[*[b.schema.names[i] for i in keep_], "chunk"])


def changes(entries: DataFrame, exports: DataFrame) -> DataFrame:
    """(entity, repo_id, key_1, key_2, change) of each export after the first of its project against the one before it.

    entries: (entity, repo_id, key_1, key_2, value), at most one row a key; exports: of ``complete_exports``. change is
    added, removed (under the later export's repo_id) or changed; null values are equal to each other only.
    """
    exports = keep(exports, "exports")
    rows = entries.join(small(exports), "repo_id").select("entity", "project", "ord", "key_1", "key_2", "value", F.xxhash64("entity", "project", "key_1", "key_2").alias("h"))
    by = ["entity", "project", "key_1", "key_2"]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by, "ord").withColumn("part", F.spark_partition_id())
    rows = keep(rows.mapInArrow(_number_chunks, "entity string, project string, ord int, key_1 string, key_2 string, value string, chunk long"), "chunks")
    place = ["entity", "project", "chunk"]
    null = F.col("value").isNull()
    x, y = F.xxhash64("key_1", "key_2", "value", null), F.xxhash64(F.lit(1), "value", null, "key_2", "key_1")
    digest = rows.groupBy(*place, "ord").agg(F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(x).alias("x"), F.bit_xor(y).alias("y")).alias("d"))
    # each digest speaks for its own export, and as the old side for the next one
    last = exports.groupBy("project").agg(F.max("ord").alias("last"))
    side = lambda o, new: F.struct(o.alias("o"), F.lit(new).alias("new"))
    sides = digest.withColumn("s", F.explode(F.array(side(F.col("ord"), True), side(F.col("ord") + 1, False)))).drop("ord")
    sides = sides.join(small(last), "project").where((F.col("s.o") > 1) & (F.col("s.o") <= F.col("last")))
    pair = sides.groupBy(*place, F.col("s.o").alias("later")).agg(F.max(F.when(F.col("s.new"), F.col("d"))).alias("a"), F.max(F.when(~F.col("s.new"), F.col("d"))).alias("b"))
    unmatched = keep(pair.where(~F.col("a").eqNullSafe(F.col("b"))).select(*place, "later"), "unmatched")
    # rows of other chunks go no further: only what differs takes part in the join by key
    wanted = unmatched.withColumn("s", F.explode(F.array(side(F.col("later"), True), side(F.col("later") - 1, False)))).select(*place, "later", F.col("s.o").alias("ord"), F.col("s.new").alias("new"))
    opened = rows.join(small(wanted, 2 * BROADCAST_ROWS), [*place, "ord"])
    pick = lambda new: F.max(F.when(F.col("new") == new, F.struct("value")))
    both = opened.groupBy("entity", "project", F.col("later").alias("ord"), "key_1", "key_2").agg(pick(True).alias("a"), pick(False).alias("b"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a.value").eqNullSafe(F.col("b.value")), "changed")
    return both.withColumn("change", change).where(F.col("change").isNotNull()).join(small(exports), ["project", "ord"]).select("entity", "repo_id", "key_1", "key_2", "change")
