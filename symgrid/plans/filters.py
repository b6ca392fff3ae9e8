"""Filters on pivots and graphs."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

C = F.col
_COMPARE = re.compile(r"([><=!]=?)\s*([\d.]+)")
_RANGE = re.compile(r"(!?)([\d.]+)\.\.([\d.]+)")
#: Fixed value: what tells test code among the values of a row's dimensions.
TESTS = r"\b(tests?|spec[s.]|e2e|mock[s]?|stub[s]?|fixture[s]?)\b|__tests__|[._/-]test[._/-]|[._/-]spec[._/-]"


def match_expression(value: Column, text: str | None) -> Column:
    """``> 3``, ``<= 2.5``, ``= 1``, ``!= 1`` or ``! 1``, ``1..5`` with both ends, ``!1..5``.

    Null values pass; so does all with an empty or unknown expression, signed numbers included.
    """
    text = (text or "").strip()
    compare, between = _COMPARE.fullmatch(text), _RANGE.fullmatch(text)
    try:
        if between:
            inside = value.between(float(between[2]), float(between[3]))
            cond = ~inside if between[1] else inside
        elif compare:
            n = F.lit(float(compare[2]))
            by = {">": value > n, ">=": value >= n, "<": value < n, "<=": value <= n, "=": value == n, "==": value == n, "!": value != n, "!=": value != n}
            cond = by[compare[1]]
        else:
            return F.lit(True)
    except ValueError:  # a number with two points
        return F.lit(True)
    return value.isNull() | cond


def exclude(dim: Column, values: list[str]) -> Column:
    return ~F.coalesce(dim.cast("string"), F.lit("")).isin(values) if values else F.lit(True)


def include(dim: Column, values: list[str]) -> Column:
    return F.coalesce(dim.cast("string"), F.lit("")).isin(values) if values else F.lit(True)


def _valid(pattern: str) -> bool:
    """Whether the engine that runs the pattern takes it."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is None:
            re.compile(pattern)
        else:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:
        return False
    return True


def match_regex(dim: Column, pattern: str | None) -> Column:
    """Case-insensitive; one leading ``!`` negates; an empty or invalid pattern passes."""
    pattern = pattern or ""
    negate = pattern.startswith("!")
    p = pattern[1:] if negate else pattern
    if not p or not _valid(p):
        return F.lit(True)
    hit = F.coalesce(dim.cast("string"), F.lit("")).rlike(f"(?i){p}")
    return ~hit if negate else hit


def parse_filters(text: str | None) -> list[dict]:
    """Filters as JSON; what is no JSON is no filter."""
    try:
        return json.loads(text) if text else []
    except ValueError:
        return []


def filter_condition(filters: list[dict], dims: list[str], depth: int) -> Column:
    """Whether a row at ``depth`` (1 …) of a pivot over ``dims`` passes all filters.

    {kind: dim, field, mode: include | exclude | regex, values | pattern} and {kind: measure, mkey, expr}. A dimension
    that rows of this depth don't have passes an include or regex filter; an exclude filter sees it as ''. Unknown kinds
    and modes pass.
    """
    cond = F.lit(True)
    for f in filters:
        if f.get("kind") == "measure":
            cond &= match_expression(C(f["mkey"]), f.get("expr"))
        elif f.get("kind") == "dim":
            there = f["field"] in dims[:depth]
            value = C(f["field"]) if there else F.lit("")
            if f.get("mode") == "exclude":
                cond &= exclude(value, f.get("values", []))
            elif there and f.get("mode") == "include":
                cond &= include(value, f.get("values", []))
            elif there and f.get("mode") == "regex":
                cond &= match_regex(value, f.get("pattern"))
    return cond


def hide_tests(dims: list[str], depth: int, pattern: str = TESTS) -> Column:
    """Rows without a dimension value that looks like test code."""
    values = F.array(*[F.coalesce(C(d).cast("string"), F.lit("")) for d in dims[:depth]])
    return ~F.exists(values, lambda v: v.rlike(f"(?i){pattern}"))


def filter_pivot(tree: DataFrame, dims: list[str], filters: list[dict], without_tests: bool = False) -> DataFrame:
    """Rows of a pivot tree (``depth``, dims, measures) that pass and, above the leaves, keep at least one child that does."""
    by_depth = F.when(F.lit(False), F.lit(True))
    for depth in range(1, len(dims) + 1):
        cond = filter_condition(filters, dims, depth)
        by_depth = by_depth.when(C("depth") == depth, cond & hide_tests(dims, depth) if without_tests else cond)
    return filter_tree(tree, dims, by_depth)


def any_term(text: Column, terms: str) -> Column:
    """Comma-separated terms, one of which the text must hold in any case."""
    wanted = [t.strip().lower() for t in terms.split(",") if t.strip()]
    return reduce(lambda a, b: a | b, [F.lower(text).contains(t) for t in wanted]) if wanted else F.lit(True)


def filter_tree(tree: DataFrame, dims: list[str], condition: Column) -> DataFrame:
    """Rows of a pivot tree that pass and, above the leaves, keep at least one child that does."""
    kept = tree.where((C("depth") == len(dims)) & condition)
    out = kept
    for depth in range(len(dims) - 1, 0, -1):
        keys = ["repo_id", *dims[:depth]]
        alive = kept.select(*keys).distinct()
        rows = tree.where((C("depth") == depth) & condition).alias("p")
        same = reduce(lambda a, b: a & b, [C(f"p.{k}").eqNullSafe(C(f"c.{k}")) for k in keys])
        kept = rows.join(alive.alias("c"), same, "left_semi")
        out = out.unionByName(kept)
    return out


def valid_edges(edges: DataFrame, nodes: DataFrame, a: str = "source", b: str = "target", key: str = "id") -> DataFrame:
    for end in (a, b):
        edges = edges.join(nodes.select("repo_id", C(key).alias(end)), ["repo_id", end], "left_semi")
    return edges


def thin_edges(edges: DataFrame, least: int = 1, top: int | None = None) -> DataFrame:
    """Edges of at least a weight, then the heaviest ``top`` of each source, ties by target."""
    e = edges.where(C("weight") >= least)
    if top is None:
        return e
    w = Window.partitionBy("repo_id", "source").orderBy(C("weight").desc(), "target")
    return e.withColumn("row_no", F.row_number().over(w)).where(C("row_no") <= top).drop("row_no")


def without_isolated(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    ends = edges.select("repo_id", C("source").alias(key)).union(edges.select("repo_id", C("target").alias(key))).distinct()
    return nodes.join(ends, ["repo_id", key], "left_semi")


def boundary_edges(edges: DataFrame, chosen: list[str]) -> DataFrame:
    """Edges with exactly one end among the chosen groups."""
    return edges.where(C("source").isin(chosen) != C("target").isin(chosen))


def blob_selection(nodes: DataFrame, edges: DataFrame, chosen: list[str], level: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes (repo_id, id, group_path) whose group down to ``level`` is chosen, and the edges with exactly one end in them."""
    group = F.array_join(F.slice("group_path", 1, level + 1), "::")
    inside = nodes.where(group.isin(chosen))
    ids = inside.select("repo_id", "id").distinct()
    e = edges
    for end in ("source", "target"):
        e = e.join(ids.select("repo_id", C("id").alias(end), F.lit(True).alias(f"in_{end}")), ["repo_id", end], "left")
    cut = e.where(C("in_source").isNull() != C("in_target").isNull())
    return inside, cut.select("repo_id", "source", "target", "weight")


def crossing_view(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between different outermost groups and the nodes at their ends. nodes: (repo_id, id, group_path)."""
    of = lambda end: nodes.select("repo_id", C("id").alias(end), C("group_path")[0].alias(f"g_{end}")).distinct()
    e = edges.join(of("source"), ["repo_id", "source"]).join(of("target"), ["repo_id", "target"])
    e = e.where(C("g_source") != C("g_target")).select("repo_id", "source", "target", "weight")
    return without_isolated(nodes, e), e
