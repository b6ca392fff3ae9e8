"""Which of several deliveries of a row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """One row for each ``keys``: the one with the latest ``time``, ties to the greatest ``columns``.

    A null time is the earliest. Rows with null keys are kept as a key of their own. Aggregated before the shuffle,
    so many deliveries of one key don't gather in one task.
    """
    row = F.struct(F.col(time).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    return df.groupBy(*keys).agg(F.max(row).alias("r")).select(*keys, *[F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)])


def latest_parents(inheritance: DataFrame) -> DataFrame:
    """The counting row of each (repo_id, child_hash): latest ``loaded_at``, then the smallest ``parent_hash``, nulls last.

    Rows without a child are no rows of a hierarchy and are left out.
    """
    late = F.expr("timestamp_ntz'9999-01-01' - coalesce(cast(loaded_at AS timestamp_ntz), timestamp_ntz'0001-01-01')")
    first = F.min(F.struct(late.alias("t"), F.col("parent_hash").isNull().alias("n"), F.col("parent_hash").alias("p")))
    return inheritance.where(F.col("child_hash").isNotNull()).groupBy("repo_id", "child_hash").agg(first.alias("r")).select("repo_id", "child_hash", F.col("r.p").alias("parent_hash"))


def is_reference(c: Column | str) -> Column:
    """Whether a hash column names a symbol: not null, not empty, no ``unresolved:`` placeholder."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce((c != "") & ~c.startswith("unresolved:"), F.lit(False))
