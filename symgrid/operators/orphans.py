"""Problem 2: references to symbols that their snapshot lacks.

References are counted by (repo_id, hash) first, so a symbol referred to by millions of rows is one row. The few
heavy ones (each at least ``1 / HEAVY`` of all references, hence at most ``HEAVY``) are looked up in nodes by a
broadcast of bounded size; the rest meet nodes in a shuffled anti-join on (repo_id, hash). Both results are united.
The counted references are written once to the shared folder, since both branches and their total read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrid.operators.rows import is_reference
from symgrid.sources.tables import keep, small

#: A reference is heavy if it has at least this fraction of all reference rows; so there are at most HEAVY heavy ones.
HEAVY = 4096
KINDS = [("edges", "caller_hash"), ("edges", "callee_hash"), ("inheritance", "parent_hash")]


def references(edges: DataFrame, inheritance: DataFrame) -> DataFrame:
    """(repo_id, ref_hash, n0, n1, n2): rows by kind of reference. Null, empty and ``unresolved:`` hashes are none."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = [F.struct(F.col(c).alias("h"), F.lit(k).alias("k")) for k, c in enumerate(("caller_hash", "callee_hash"))]
    of_edges = edges.select("repo_id", F.explode(F.array(*ends)).alias("r")).select("repo_id", "r.h", "r.k")
    every = of_edges.unionByName(inheritance.select("repo_id", F.col("parent_hash").alias("h"), F.lit(2).alias("k"))).where(is_reference("h"))
    return every.groupBy("repo_id", F.col("h").alias("ref_hash")).agg(*[F.sum(F.when(F.col("k") == i, one).otherwise(none)).alias(f"n{i}") for i in range(3)])


def present(nodes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(repo_id, ref_hash) of the rows that were loaded before their snapshot was closed; repeats are left in."""
    closed = snapshots.groupBy("repo_id").agg(F.max("closed_at").alias("closed_at"))
    return nodes.select("repo_id", "hash", "loaded_at").join(small(closed), "repo_id").where(F.col("loaded_at") <= F.col("closed_at")).select("repo_id", F.col("hash").alias("ref_hash"))


def orphans(edges: DataFrame, inheritance: DataFrame, nodes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(table_name, column_name, repo_id, ref_hash, n_rows): the distinct references without a row in nodes.

    A snapshot missing from ``snapshots`` has no closing time, so all its references are orphans; so are those with a
    null repo_id. Extra columns of the inputs are ignored.
    """
    refs = keep(references(edges, inheritance), "references")
    there = present(nodes, snapshots)
    total = F.col("n0") + F.col("n1") + F.col("n2")
    limit = max(1.0, (refs.agg(F.sum(total)).first()[0] or 0) / HEAVY)
    key = ["repo_id", "ref_hash"]
    heavy = refs.where(total >= limit)
    found = there.join(F.broadcast(heavy.select(*key)), key, "left_semi").distinct()
    lost = heavy.join(F.broadcast(found), key, "left_anti").unionByName(refs.where(total < limit).join(there, key, "left_anti"))
    rows = F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_rows")) for i, (t, c) in enumerate(KINDS)])
    some = lost.select(*key, F.explode(F.filter(rows, lambda r: r["n_rows"] > 0)).alias("r"))
    return some.select("r.table_name", "r.column_name", *key, "r.n_rows")
