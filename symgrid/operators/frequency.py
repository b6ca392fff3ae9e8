"""Problem 1: results for every key where a few keys hold most rows.

Rows are first counted by key *and* value, which spreads a hot key over its values, and repeated values of it become
one weighted row before the shuffle. Counts, distinct counts, modes and percentiles of a key then come from the
weighted values; the second grouping is pre-aggregated on the map side to one row for each key and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.sources.tables import keep

#: Distinct values of a key's band that one task puts in order; larger bands are split into so many parts.
IN_TASK, PARTS = 500_000, 1024


def compress(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n) of each pair; null keys and values are kept as such."""
    return df.select(F.col(key).alias("key"), F.col(value).alias("value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def profile(freq: DataFrame) -> DataFrame:
    """Of each key: rows, distinct non-null values, the most frequent value (ties: the smallest) and its rows.

    Null keys are left out. A key of only null values has 0 distinct values and a null mode.
    """
    mode = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("value").alias("v"))))
    return (
        freq.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct"), mode.alias("m"))
        .select("key", "n_rows", "n_distinct", F.col("m.v").alias("mode_value"), (-F.col("m.n")).alias("mode_rows"))
    )


def heavy_keys(df: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """(key, n_rows, n_distinct, …) of the keys that hold at least ``share`` of all rows, null keys included in "all"."""
    total = df.count()
    return profile(compress(df, key, value)).where(F.col("n_rows") >= F.lit(share) * F.lit(total))


def _position(q: float) -> Column:
    return F.lit(float(q)) * (F.col("total") - 1)


def _wanted(bands: DataFrame, by: list[str], order: str, start: Column) -> DataFrame:
    """Bands (by, order, rows, at, …) with the number of rows before them and the wanted positions that lie in them."""
    before = start + F.coalesce(F.sum("rows").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = bands.withColumn("before", before)
    inside = F.filter("at", lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("rows")))
    return placed.withColumn("at", inside).where(F.size("at") > 0)


def percentiles(freq: DataFrame, qs: list[float], in_task: int = IN_TASK) -> DataFrame:
    """(key, n, p_<q>…): linearly interpolated percentiles of weighted numeric values, exact.

    Null values and keys don't count; a key without values gives no row. Values of a key are spread over bands of
    like magnitude: only counts of bands are summed by key (at most 130 a key), and only the band that holds a wanted
    position is opened. A band of more than ``in_task`` distinct values is split into ``PARTS`` of equal width again and
    again, so no task sums up more than that many values in order, however many a key has. The large bands are at most
    all distinct values / ``in_task``, which bounds their broadcast.
    """
    x = F.col("value").cast("double")
    rows = freq.where(F.col("key").isNotNull() & x.isNotNull() & ~F.isnan(x)).select("key", x.alias("value"), "n")
    magnitude = F.floor(F.greatest(F.lit(-32.0), F.least(F.lit(32.0), F.log2(F.abs("value"))))) + 33
    rows = keep(rows.withColumn("band", F.when(F.col("value") == 0, 0).otherwise(F.signum("value") * magnitude).cast("long")), "weighted")
    size = [F.sum("n").alias("rows"), F.count(F.lit(1)).alias("values"), F.min("value").alias("lo"), F.max("value").alias("hi")]
    bands = rows.groupBy("key", "band").agg(*size).withColumn("total", F.sum("rows").over(Window.partitionBy("key")))
    positions = F.array_distinct(F.array(*[f(_position(q)).cast("long") for q in qs for f in (F.floor, F.ceil)]))
    named = lambda df: df.withColumn("band", F.col("band").cast("string"))
    state, rows = keep(named(_wanted(bands.withColumn("at", positions), ["key"], "band", F.lit(0))), "bands"), named(rows)
    opened = None
    while True:
        fit = state.where((F.col("values") <= in_task) | (F.col("lo") == F.col("hi")))
        part = rows.join(fit.select("key", "band", "before", "total", "at"), ["key", "band"])
        opened = part if opened is None else opened.unionByName(part)
        large = state.where((F.col("values") > in_task) & (F.col("lo") < F.col("hi")))
        if not large.limit(1).count():
            break
        place = F.least(F.lit(PARTS - 1), F.floor((F.col("value") / F.lit(2.0) - F.col("lo") / F.lit(2.0)) / (F.col("hi") / F.lit(2.0) - F.col("lo") / F.lit(2.0)) * PARTS)).cast("long")
        inner = rows.join(F.broadcast(large.select("key", "band", "lo", "hi", "before", "total", "at")), ["key", "band"]).withColumn("part", place)
        inner = keep(inner.select("key", "band", "part", "value", "n", "before", "total", "at"), "inner")
        parts = inner.groupBy("key", "band", "part", F.col("before").alias("start"), "total", "at").agg(*size)
        state = _wanted(parts, ["key", "band"], "part", F.col("start"))
        # a part is named after its band, apart from those of other rounds
        name = F.concat_ws("/", "band", "part")
        state = keep(state.select("key", name.alias("band"), "rows", "values", "lo", "hi", "total", "at", "before"), "bands")
        rows = inner.select("key", "value", "n", name.alias("band"))
    end = F.sum("n").over(Window.partitionBy("key", "band").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    hit = opened.withColumn("end", end).withColumn("hit", F.expr("filter(at, p -> p < end and p >= end - n)")).where(F.size("hit") > 0)
    found = hit.select("key", "total", F.explode("hit").alias("p"), "value").groupBy("key", "total").agg(F.map_from_entries(F.collect_list(F.struct("p", "value"))).alias("m"))
    out = []
    for q in qs:
        at = _position(q)
        lo, hi = F.col("m")[F.floor(at).cast("long")], F.col("m")[F.ceil(at).cast("long")]
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(f"p_{round(q * 100):02d}"))
    return found.select("key", F.col("total").alias("n"), *out)
