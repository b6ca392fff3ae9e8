"""Problem 9: records of several sources mixed to target weights.

Each record has a place in [0, 2^60) by a hash of its key. Tokens are summed by source and bucket of places; the bucket
in which a source's budget ends is split again, level by level, until the threshold lies between two records. A record
is taken once more than its source's full rounds if its place is below the threshold: a filter, without a sort. Budgets
and thresholds are tables, one row a source, so there may be any number of sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.sources.tables import forget, keep, small

BITS, LEVEL_BITS = 60, 10


def budgets(tokens: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Of each source with a positive weight: target_weight, max_repeats, available, total, budget, full rounds and the rest of the budget.

    Weights are those of sources that have tokens, scaled to 1; of repeated targets the greatest weight, then the
    greatest cap counts. Null caps are 1, a cap under 1 takes a source out. ``total`` defaults to the greatest size at
    which every source reaches its share within its cap; with a greater one, sources stop at their caps.
    """
    wanted = targets.where(F.col("source").isNotNull() & (F.col("target_weight") > 0)).groupBy("source").agg(F.max(F.struct("target_weight", "max_repeats")).alias("t"))
    wanted = wanted.select("source", F.col("t.target_weight").cast("double").alias("target_weight"), F.coalesce("t.max_repeats", F.lit(1)).cast("int").alias("max_repeats"))
    sums = tokens.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    rows = keep(wanted.join(sums, "source", "left").withColumn("available", F.when(F.col("max_repeats") >= 1, F.coalesce("n", F.lit(0))).otherwise(0)).drop("n"), "targets")
    there = rows.where(F.col("available") > 0)
    scale = there.agg(F.sum("target_weight")).first()[0] or 1.0
    if total is None:
        total = there.agg(F.min(F.col("available") * F.col("max_repeats") * scale / F.col("target_weight"))).first()[0] or 0.0
    share = F.floor(F.lit(float(total)) * F.col("target_weight") / F.lit(float(scale)) + 1e-6)
    budget = F.when(F.col("available") > 0, F.least(share, F.col("available") * F.col("max_repeats"))).otherwise(0).cast("long")
    some = rows.withColumns({"total": F.lit(int(total)).cast("long"), "budget": budget})
    n = F.nullif("available", F.lit(0))
    rounds = F.coalesce(F.floor(F.col("budget") / n), F.lit(0)).cast("long")
    return some.withColumn("rounds", rounds).withColumn("rest", F.col("budget") - F.col("rounds") * F.col("available"))


def thresholds(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, below): the place below which records of each source fit into its rest; the next record would exceed it.

    Each level sums the tokens of 1024 buckets of the boundary bucket of each source that is still open. A source is
    settled once its boundary bucket has records at one place only, as its threshold lies before them then.
    """
    open_ = keep(plan.where(F.col("available") > 0).select("source", F.lit(0).cast("long").alias("lo"), "rest"), "open")
    closed = None
    for level in range(BITS // LEVEL_BITS):
        width = BITS - LEVEL_BITS * (level + 1)
        inside = placed.join(small(open_), "source").where(F.shiftright("place", width + LEVEL_BITS) == F.shiftright("lo", width + LEVEL_BITS))
        sums = [F.sum("n_tokens").alias("n"), F.min("place").alias("first"), F.max("place").alias("last")]
        buckets = inside.groupBy("source", "rest", F.shiftright("place", width).alias("bucket")).agg(*sums)
        # at most 1024 buckets a source
        upto = buckets.withColumn("end", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")))
        boundary = F.struct("bucket", (F.col("rest") - F.col("end") + F.col("n")).alias("left"), "first", "last")
        found = upto.groupBy("source").agg(F.min(F.when(F.col("end") > F.col("rest"), boundary)).alias("b"))
        old, state = open_, keep(open_.select("source").join(found, "source", "left").select("source", "b"), "level")
        # without a boundary all records fit
        below = F.when(F.col("b").isNull(), F.lit(1 << BITS).cast("long")).when(F.col("b.first") == F.col("b.last"), F.col("b.first"))
        part = state.select("source", below.alias("below")).where(F.col("below").isNotNull())
        closed = part if closed is None else closed.unionByName(part)
        more = state.where(F.col("b.first") < F.col("b.last")).select("source", F.shiftleft(F.col("b.bucket"), width).alias("lo"), F.col("b.left").alias("rest"))
        open_ = keep(more, "open")
        forget(old)
        if not open_.limit(1).count():
            break
    return closed.unionByName(open_.select("source", F.col("lo").alias("below")))


def mix(tokens: DataFrame, targets: DataFrame, key: str = "doc_id", total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, shares). tokens: (key, source, n_tokens), read several times.

    selection: (key, source, n_tokens, repeats) of the records used at least once. Records with equal keys of a source
    share a place and are taken or left together; records without tokens are used like others; those with a null
    source, a null key's place being that of its hash, or a source without target are left out. shares: source,
    target_weight, max_repeats, available, budget, the total that budgets are shares of, tokens and share really
    reached; sources without records reach 0.
    """
    plan = keep(budgets(tokens, targets, total), "budgets")
    placed = tokens.select(key, "source", "n_tokens", F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col(key).cast("string")), 64 - BITS).alias("place"))
    of = keep(plan.join(thresholds(placed, plan), "source", "left").withColumn("below", F.coalesce("below", F.lit(0))), "limits")
    rounds = placed.join(small(of.select("source", "rounds", "below", "max_repeats")), "source")
    repeats = F.least(F.col("max_repeats"), (F.col("rounds") + (F.col("place") < F.col("below")).cast("long")).cast("int"))
    used = rounds.withColumn("repeats", repeats).where(F.col("repeats") > 0).select(key, "source", "n_tokens", "repeats")
    reached = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    every = reached.agg(F.sum("tokens").alias("all"))
    shares = of.join(reached, "source", "left").join(F.broadcast(every), F.lit(True), "left")  # one row
    return used, shares.select("source", "target_weight", "max_repeats", "available", "budget", "total", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("share"))
