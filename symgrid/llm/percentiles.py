"""Problem 5: exact percentiles of groups, by a full distributed sort with counts of each partition.

Values are first counted by group and value; such counts of several days or projects add up (``merge``), so the
results of parts give those of all together with an error of zero. The counted values are sorted over all partitions by
group and value, so a large group spans many partitions. The counts of each group in each partition give its offset
there; the partitions that hold a wanted position are read again for the neighbouring order statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.sources.tables import keep


def counts(df: DataFrame, group: list[str], value: str, missing: float | None = -1.0) -> DataFrame:
    """(group…, value, n): the state that merges. Null, NaN and ``missing`` are no values; null groups are groups."""
    v = F.col(value).cast("double")
    ok = v.isNotNull() & ~F.isnan(v)
    if missing is not None:
        ok &= v != missing
    return df.where(ok).select(*group, (v + F.lit(0.0)).alias("value")).groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))


def merge(state: DataFrame, group: list[str]) -> DataFrame:
    """The state by fewer columns or of united states."""
    return state.groupBy(*group, "value").agg(F.sum("n").alias("n"))


def percentiles(state: DataFrame, group: list[str], qs: list[float]) -> DataFrame:
    """(group…, n, q, value): for each q in [0, 1] the value at q * (n - 1) of the sorted values, interpolated linearly.

    A group without values gives no row. Equal values are one weighted row, so ties cost nothing. Infinite values are
    values; between two infinite neighbours the lower is given. Group columns may not be called value, n or q.
    """
    g = [f"g{i}" for i in range(len(group))]
    rows = state.select(*[F.col(c).alias(a) for c, a in zip(group, g)], "value", "n")
    # null-safe order of groups: the sort puts nulls first, which is all that is needed
    rows = keep(rows.repartitionByRange(*g, "value").sortWithinPartitions(*g, "value").withColumn("part", F.spark_partition_id()), "sorted")
    key = F.xxhash64(*[x for a in g for x in (F.col(a), F.col(a).isNull())]) if g else F.lit(0).cast("long")
    by_part = rows.groupBy(*g, "part").agg(F.sum("n").alias("here")).withColumn("k", key)
    w = Window.partitionBy(*g)
    offsets = by_part.withColumn("start", F.sum("here").over(w.orderBy("part")) - F.col("here")).withColumn("total", F.sum("here").over(w))
    at = lambda q: F.lit(float(q)) * (F.col("total") - 1)
    wanted = F.array_distinct(F.array(*[f(at(q)).cast("long") for q in qs for f in (F.floor, F.ceil)]))
    offsets = offsets.withColumn("at", F.filter(wanted, lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("here")))).where(F.size("at") > 0)
    # (group, part) is one stretch of one sorted partition, so this window is bounded by a partition
    same = [F.col(f"r.{a}").eqNullSafe(F.col(f"o.{a}")) for a in g]
    on = F.col("r.part") == F.col("o.part")
    for s in same:
        on &= s
    # both sides grow with the groups and sorted files are far smaller than their rows, so neither may be broadcast
    opened = rows.alias("r").join(offsets.alias("o").hint("merge"), on).select(*[F.col(f"r.{a}") for a in g], F.col("r.part"), "value", "n", "start", "total", "at")
    end = F.sum("n").over(Window.partitionBy(*g, "part").orderBy("value")) + F.col("start")
    hits = opened.withColumn("end", end).withColumn("p", F.explode(F.expr("filter(at, p -> p < end and p >= end - n)")))
    found = hits.groupBy(*g, "total").agg(F.map_from_entries(F.collect_list(F.struct("p", "value"))).alias("m"))
    quantile = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col("m")[F.floor(at(q)).cast("long")].alias("lo"), F.col("m")[F.ceil(at(q)).cast("long")].alias("hi"), (at(q) - F.floor(at(q))).alias("f")) for q in qs]))
    found = found.withColumn("x", quantile)
    value = F.when((F.col("x.f") == 0) | (F.col("x.lo") == F.col("x.hi")), F.col("x.lo")).otherwise(F.col("x.lo") + (F.col("x.hi") - F.col("x.lo")) * F.col("x.f"))
    return found.select(*[F.col(a).alias(c) for c, a in zip(group, g)], F.col("total").alias("n"), F.col("x.q").alias("q"), value.alias("value"))
