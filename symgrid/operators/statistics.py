"""Statistics and models over the features of symbols."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.sources.catalog import Catalog
from symgrid.sources.tables import keep

C = F.col
FEATURES = [
    "scc_size", "scc_cross_module", "topological_depth", "reverse_topological_depth", "transitive_callers", "transitive_callees",
    "betweenness_centrality", "pagerank", "hub_score", "authority_score", "clustering_coeff", "xmod_fan_in", "xmod_fan_out",
    "xmod_call_ratio", "dominant_callee_frac", "utility_score", "stability_rank", "complexity_pct", "middleman_score",
    "community_alignment", "caller_count", "callee_count", "complexity",
]
#: Rows that a t-SNE projection takes at most: it compares all with all, on the driver.
MOST_PROJECTED = 2_000


def symbols(c: Catalog) -> DataFrame:
    """Internal symbols that have features, with both."""
    own = ["name", "module", "caller_count", "callee_count", "complexity"]
    return c.internal_nodes.select("repo_id", "hash", *own).join(c.features, ["repo_id", "hash"])


def _number(c: str) -> Column:
    return F.coalesce(F.nanvl(C(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def matrix(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """The columns as doubles, null and NaN as 0."""
    return df.withColumns({c: _number(c) for c in columns})


def varying(df: DataFrame, columns: list[str] = FEATURES) -> list[str]:
    """Columns of a matrix that aren't constant."""
    spread = df.agg(*[(F.max(c) > F.min(c)).alias(c) for c in columns]).first()
    return [c for c in columns if spread[c]]


def correlations(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """(a, b, r) of each pair of columns, in one pass over the data; null where a column is constant."""
    m = matrix(df, columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    # sums of doubles: one aggregate, no shuffle but of one row a task
    row = m.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    r = lambda i: F.round(F.nullif(F.nanvl(f"r{i}", F.lit(9.0)), F.lit(9.0)), 4)
    one = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(i).alias("r")) for i, (a, b) in enumerate(pairs)]))
    return row.select(one.alias("x")).select("x.a", "x.b", "x.r")


def redundant(pairs: DataFrame, least: float = 0.85) -> DataFrame:
    """Pairs of ``correlations`` that say nearly the same, strongest first (``row_no``)."""
    strong = pairs.where(F.abs("r") >= least)
    # at most a few hundred pairs
    return strong.withColumn("row_no", F.row_number().over(Window.orderBy(F.abs("r").desc(), "a", "b")))


def discriminability(df: DataFrame, group: str, reference: str, columns: list[str] = FEATURES) -> DataFrame:
    """(grp, feature, mean, d): |mean - mean of the reference| / (population deviation of the reference + 1e-9)."""
    m = matrix(df, columns)
    wide = m.groupBy(C(group).alias("grp")).agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), C(f"{c}.m").alias("m"), C(f"{c}.s").alias("s")) for c in columns]))
    rows = wide.select("grp", each.alias("x")).select("grp", "x.feature", "x.m", "x.s")
    ref = rows.where(C("grp") == reference).select("feature", C("m").alias("rm"), C("s").alias("rs"))
    d = F.abs(C("m") - C("rm")) / (C("rs") + 1e-9)
    return rows.where(C("grp") != reference).join(F.broadcast(ref), "feature").select("grp", "feature", F.round("m", 4).alias("mean"), F.round(d, 4).alias("d"))


def discriminating(found: DataFrame) -> DataFrame:
    """(row_no, feature, max_d): features by their greatest effect in any group."""
    best = found.groupBy("feature").agg(F.max("d").alias("max_d"))
    return best.withColumn("row_no", F.row_number().over(Window.orderBy(C("max_d").desc(), "feature")))


def principal_components(df: DataFrame, k: int = 10, columns: list[str] = FEATURES) -> dict:
    """Explained shares, their running sum, loadings, the five strongest features of each component, and scores.

    Columns are standardised by their population deviation; constant ones are dropped. Of each component the strongest
    loading is positive. At least two rows are needed.
    """
    m = matrix(df, columns)
    n, used = m.count(), varying(m, columns) if columns else []
    if n < 2 or not used:
        raise ValueError("two rows and a column that varies are needed")
    v = VectorAssembler(inputCols=used, outputCol="raw").transform(m)
    v = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(v).transform(v)
    model = PCA(k=min(k, len(used), n), inputCol="scaled", outputCol="scores").fit(v)
    load = model.pc.toArray()
    flip = [1.0 if load[abs(load[:, i]).argmax(), i] > 0 else -1.0 for i in range(load.shape[1])]
    shares = model.explainedVariance.toArray().tolist()
    loadings = [{c: float(load[j, i] * flip[i]) for j, c in enumerate(used)} for i in range(load.shape[1])]
    # the scaler divides by the sample deviation
    scale = (n / (n - 1)) ** 0.5
    signed = F.transform(F.arrays_zip(vector_to_array("scores").alias("x"), F.array(*[F.lit(f * scale) for f in flip]).alias("f")), lambda z: F.round(z["x"] * z["f"], 4))
    return {
        "columns": used,
        "dropped": [c for c in columns if c not in used],
        "explained": shares,
        "cumulative": np.cumsum(shares).tolist(),
        "loadings": loadings,
        "top_features": [sorted(x, key=lambda c: -abs(x[c]))[:5] for x in loadings],
        "scores": model.transform(v).withColumn("scores", signed),
    }


#: Which rows a comparison is made on.
SUBSETS: dict[str, Column] = {
    "all": lambda: F.lit(True),
    "callers_only": lambda: _number("caller_count") > 0,
    "xmod_only": lambda: (_number("xmod_fan_in") > 0) | (_number("xmod_fan_out") > 0),
    "deep_only": lambda: _number("topological_depth") >= 2,
}


def pooled(df: DataFrame, group: str, clean: str, subset: str = "all") -> DataFrame:
    """Rows of all groups with ``label``: 0 for the clean group, 1 for the others."""
    return df.where(SUBSETS[subset]()).withColumn("label", (C(group) != clean).cast("double"))


def importances(df: DataFrame, label: str = "label", columns: list[str] = FEATURES, trees: int = 200, folds: int = 5, seed: int = 42) -> dict:
    """Random-forest importances with balanced weights, and accuracy on folds that have each label's share. label is 0 or 1.

    Rows are dealt to folds in the order of their hash within each label.
    """
    m = matrix(df, columns).withColumn("label", C(label).cast("double"))
    used = varying(m, columns)
    sizes = {r["label"]: r["count"] for r in m.groupBy("label").count().collect()}  # two rows
    n = sum(sizes.values())
    if len(sizes) < 2 or n < 10:
        raise ValueError("two classes and ten rows are needed")
    weight = F.when(C("label") == 1, n / (2 * sizes[1.0])).otherwise(n / (2 * sizes[0.0]))
    data = VectorAssembler(inputCols=used, outputCol="features").transform(m)
    place = F.xxhash64(F.lit(seed), *[C(c) for c in used], *[c for c in ("repo_id", "hash") if c in df.columns])
    # a random-like deal: the fold of a row is that of its hash, so both labels are spread evenly
    data = keep(data.select("features", "label", weight.alias("weight"), F.pmod(place, F.lit(folds)).cast("int").alias("fold")), "forest")
    forest = RandomForestClassifier(numTrees=trees, seed=seed, weightCol="weight")
    held = []
    for i in range(folds):
        right = forest.fit(data.where(C("fold") != i)).transform(data.where(C("fold") == i))
        held.append(right.agg(F.avg((C("prediction") == C("label")).cast("double"))).first()[0] or 0.0)
    found = forest.fit(data.drop("fold")).featureImportances.toArray()
    ranked = sorted(zip(used, map(float, found)), key=lambda x: (-x[1], x[0]))
    return {"importances": dict(ranked), "accuracy": float(np.mean(held)), "deviation": float(np.std(held)), "n_clean": sizes[0.0], "n_other": sizes[1.0]}


def compare_subsets(df: DataFrame, group: str, clean: str, **how: int) -> dict[str, dict]:
    """``importances`` on each subset: accuracy, class sizes, five strongest features; the message where a subset can't be used."""
    out = {}
    for name in SUBSETS:
        try:
            got = importances(pooled(df, group, clean, name), **how)
            out[name] = {**{k: v for k, v in got.items() if k != "importances"}, "top_features": list(got["importances"])[:5]}
        except ValueError as e:
            out[name] = {"error": str(e)}
    return out


def cumulative(df: DataFrame, order: str, value: str, name: str = "end") -> DataFrame:
    """Adds the running sum of ``value`` over all rows by ``order``, without bringing all rows to one task.

    The rows are sorted over all partitions; sums of partitions, one row each, give where each begins.
    """
    rows = keep(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()), "ordered")
    parts = rows.groupBy("part").agg(F.sum(value).alias("here"))
    before = parts.select("part", (F.sum("here").over(Window.orderBy("part")) - C("here")).alias("before"))
    inside = F.sum(value).over(Window.partitionBy("part").orderBy(order))
    return rows.join(F.broadcast(before), "part").withColumn(name, inside + C("before")).drop("part", "before")


def mean_ranks(df: DataFrame, value: str) -> DataFrame:
    """(v, n, rank) of each distinct value: equal ones share their mean rank. Null and NaN are no values."""
    f = df.where(C(value).isNotNull() & ~F.isnan(C(value).cast("double"))).groupBy(C(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return cumulative(f, "v", "n").select("v", "n", (C("end") - (C("n") - 1) / 2).alias("rank"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(rho, n): correlation of the mean ranks of the rows that have both values."""
    both = keep(df.select(C(a).cast("double").alias("a"), C(b).cast("double").alias("b")).where(C("a").isNotNull() & C("b").isNotNull() & ~F.isnan("a") & ~F.isnan("b")), "pairs")
    of = lambda c: mean_ranks(both, c).select(C("v").alias(c), C("rank").alias(f"r_{c}"))
    ranked = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).join(of("a"), "a").join(of("b"), "b")
    s = lambda x: F.sum(C("n") * x)
    row = ranked.agg(F.sum("n").alias("n"), s(C("r_a")).alias("x"), s(C("r_b")).alias("y"), s(C("r_a") * C("r_b")).alias("xy"), s(C("r_a") * C("r_a")).alias("xx"), s(C("r_b") * C("r_b")).alias("yy"))
    cov, va, vb = C("xy") - C("x") * C("y") / C("n"), C("xx") - C("x") * C("x") / C("n"), C("yy") - C("y") * C("y") / C("n")
    return row.select((cov / F.nullif(F.sqrt(va * vb), F.lit(0.0))).alias("rho"), "n")


def mann_whitney(df: DataFrame, value: str, label: str) -> DataFrame:
    """(u, n1, n0, z): rank-sum statistic of label 1 against 0, with its normal score; equal values share their mean rank."""
    rows = df.where(C(value).isNotNull() & ~F.isnan(C(value).cast("double")))
    by = rows.groupBy(C(value).cast("double").alias("v")).agg(F.sum((C(label) == 1).cast("long")).alias("n1"), F.sum((C(label) == 0).cast("long")).alias("n0"))
    f = cumulative(by.withColumn("n", C("n1") + C("n0")), "v", "n")
    t = C("n").cast("double")
    s = f.agg(F.sum(C("n1") * (C("end") - (C("n") - 1) / 2)).alias("r"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.sum(t * t * t - t).alias("ties"))
    u = C("r") - C("n1") * (C("n1") + 1) / 2
    n = (C("n1") + C("n0")).cast("double")
    spread = F.sqrt(C("n1") * C("n0") / 12 * (n + 1 - C("ties") / (n * (n - 1))))
    return s.select(u.alias("u"), "n1", "n0", ((u - C("n1") * C("n0") / 2) / F.nullif(spread, F.lit(0.0))).alias("z"))


def tsne(x: np.ndarray, perplexity: float = 30.0, seed: int = 42, rounds: int = 500) -> np.ndarray:
    """Exact t-SNE of standardised rows in two dimensions."""
    n = len(x)
    far = np.maximum(((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T), 0)
    p = np.zeros((n, n))
    for i in range(n):  # the width at which a row's neighbours have the wanted perplexity
        d, lo, hi, beta = np.delete(far[i], i), 0.0, np.inf, 1.0
        for _ in range(50):
            w = np.exp(-(d - d.min()) * beta)
            entropy = np.log(w.sum()) + beta * ((d - d.min()) * w).sum() / w.sum()
            if abs(entropy - np.log(perplexity)) < 1e-5:
                break
            lo, hi = (beta, hi) if entropy > np.log(perplexity) else (lo, beta)
            beta = beta * 2 if hi == np.inf else (lo + hi) / 2
        p[i, np.arange(n) != i] = w / w.sum()
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    rng = np.random.default_rng(seed)
    y, move, gain = rng.normal(scale=1e-4, size=(n, 2)), np.zeros((n, 2)), np.ones((n, 2))
    for r in range(rounds):
        near = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
        np.fill_diagonal(near, 0)
        pull = (p * (12 if r < 100 else 1) - np.maximum(near / near.sum(), 1e-12)) * near
        slope = 4 * (pull.sum(1)[:, None] * y - pull @ y)
        gain = np.maximum(np.where(np.sign(slope) != np.sign(move), gain + 0.2, gain * 0.8), 0.01)
        move = (0.5 if r < 100 else 0.8) * move - max(n / 48, 50) * gain * slope
        y = y + move
        y -= y.mean(0)
    return y


def projection(df: DataFrame, method: str = "tsne", columns: list[str] = FEATURES, perplexity: float = 30.0, most: int = MOST_PROJECTED) -> DataFrame:
    """(repo_id, hash, name, module, x, y): symbols in the plane, by their first two components or by t-SNE.

    t-SNE compares all rows with all and takes at most ``most``; above that it raises, and components are the way.
    Four rows and two columns that vary are needed. The perplexity is at most a third of the rows, two at least.
    """
    about = ["repo_id", "hash", "name", "module"]
    m = matrix(df, columns)
    if method == "pca":
        got = principal_components(df, 2, columns)["scores"]
        return got.select(*about, C("scores")[0].alias("x"), C("scores")[1].alias("y"))
    used, n = varying(m, columns), m.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows")
    if n < 4 or len(used) < 2:
        raise ValueError("four rows and two columns that vary are needed")
    t = m.orderBy("repo_id", "hash").select(*about, *used).toPandas()
    x = t[used].to_numpy(float)
    y = tsne((x - x.mean(0)) / x.std(0), min(perplexity, max(2, n // 3)))
    return df.sparkSession.createDataFrame([(*r, float(a), float(b)) for r, (a, b) in zip(t[about].itertuples(index=False, name=None), y.round(4))], "repo_id string, hash string, name string, module string, x double, y double")


def report(c: Catalog, group: str, clean: str, trees: int = 200, folds: int = 5, project: bool = False) -> dict:
    """All of it as one small dictionary: components of each group, importances by subset, effects, correlations.

    ``group`` is a column of the symbols, such as repo_id; the groups are listed on the driver, their rows are not.
    """
    df = keep(symbols(c).withColumn("project", F.split("repo_id", "@")[0]), "symbols")
    names = sorted(r[0] for r in df.select(group).where(C(group).isNotNull()).distinct().toLocalIterator())
    if len(names) < 2:
        raise ValueError("two groups are needed")
    out: dict = {"groups": names, "total": df.count(), "components": {}}
    for g in names:
        try:
            got = principal_components(df.where(C(group) == g), 5)
            out["components"][g] = {"cumulative": got["cumulative"][-1], "top_features": got["top_features"][0]}
        except ValueError as e:
            out["components"][g] = {"error": str(e)}
    out["importances"] = compare_subsets(df, group, clean, trees=trees, folds=folds)
    out["effects"] = [r.asDict() for r in discriminating(discriminability(df, group, clean)).orderBy("row_no").collect()]
    out["redundant"] = [r.asDict() for r in redundant(correlations(df)).orderBy("row_no").collect()]
    if project:
        out["points"] = [r.asDict() for r in projection(df).collect()]
    return out


def write_report(found: dict, path: str) -> None:
    """A report as JSON."""
    with open(path, "w") as f:
        json.dump(found, f, indent=2, default=str)
