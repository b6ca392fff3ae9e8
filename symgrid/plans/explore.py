"""The semantic layer: dimensions, percentile buckets, measures, roll-ups, induced graphs, symbol tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.functions.scalars import blend_colours, dirname, symbol
from symgrid.plans import filters
from symgrid.sources.catalog import NODE_COLUMNS, SCHEMA_COLUMNS, Catalog, internal
from symgrid.sources.tables import keep, small

C = F.col
#: Symbols that a view without dimensions shows of a snapshot.
SYMBOLS = 500
DIMENSIONS: dict[str, Callable[[], Column]] = {
    "module": lambda: C("module"),
    "class": lambda: F.coalesce("class_name", F.lit("(top-level)")),
    "risk": lambda: C("risk"),
    "kind": lambda: C("kind"),
    "symbol": lambda: symbol(C("module"), C("name")),
    "file": lambda: C("file_path"),
    "directory": lambda: dirname(C("file_path")),
    "dead": lambda: F.when(C("caller_count") == 0, "dead").otherwise("alive"),
    "high_risk": lambda: F.when(C("risk").isin("high", "critical"), "high-risk").otherwise("normal"),
    "in_cycle": lambda: F.when(F.coalesce("scc_size", F.lit(1)) > 1, "in-cycle").otherwise("clean"),
    "community": lambda: C("community_dominant_mod"),
    "framework": lambda: F.coalesce(F.nullif("framework_entry_point", F.lit("")), F.lit("none")),
    "async": lambda: F.when(C("is_async") == 1, "async").otherwise("sync"),
    "exported": lambda: F.when(C("is_exported") == 1, "exported").otherwise("internal"),
}
ENRICHED = {"in_cycle", "community"}
NEEDS_SCHEMA = {"framework", "async", "exported"}
#: Dimensions of which edges have one at either end.
EDGE_DIMENSIONS = ["module", "class", "risk", "kind", "symbol", "file", "directory", "framework", "async", "exported", "community"]
BUCKETS: dict[str, tuple[Callable[[], Column], bool]] = {
    "caller_count": (lambda: C("caller_count"), False),
    "callee_count": (lambda: C("callee_count"), False),
    "complexity": (lambda: C("complexity"), False),
    "dead_ratio": (lambda: F.when(C("caller_count") == 0, 0.0).otherwise(1.0), False),
    "high_risk_ratio": (lambda: F.when(C("risk").isin("high", "critical"), 1.0).otherwise(0.0), False),
    "in_cycle_ratio": (lambda: F.when(F.coalesce("scc_size", F.lit(1)) > 1, 1.0).otherwise(0.0), True),
    "pagerank": (lambda: C("pagerank"), True),
    "utility": (lambda: C("utility_score"), True),
    "xmod_fan_in": (lambda: C("xmod_fan_in"), True),
    "betweenness": (lambda: C("betweenness_centrality"), True),
}
MODES = {"median": ["low", "high"], "quartile": [f"Q{i}" for i in range(1, 5)], "decile": [f"D{i}" for i in range(1, 11)]}
FIELDS: dict[str, tuple[str, str, bool]] = {
    "caller_count": ("caller_count", "int", False),
    "callee_count": ("callee_count", "int", False),
    "complexity": ("complexity", "int", False),
    "utility": ("utility_score", "float", True),
    "pagerank": ("pagerank", "float", True),
    "xmod_fan_in": ("xmod_fan_in", "int", True),
    "topo_depth": ("topological_depth", "int", True),
    "betweenness": ("betweenness_centrality", "float", True),
}
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "avg": lambda x: F.round(F.avg(x.cast("double")), 4),
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "count": F.count,
    "stddev": lambda x: F.round(F.coalesce(F.stddev_pop(x), F.lit(0.0)), 4),
}
_share = lambda cond: F.round(F.sum(F.when(cond, 1.0).otherwise(0.0)) / F.nullif(F.count(F.lit(1)), F.lit(0)), 3)
SPECIALS: dict[str, tuple[Callable[[], Column], str, bool]] = {
    "symbol_count": (lambda: F.count(F.lit(1)), "int", False),
    "dead_ratio": (lambda: _share(C("caller_count") == 0), "ratio", False),
    "high_risk_ratio": (lambda: _share(C("risk").isin("high", "critical")), "ratio", False),
    "in_cycle_ratio": (lambda: _share(F.coalesce("scc_size", F.lit(1)) > 1), "ratio", True),
}
_FIELD_OF_SPECIAL = {"symbol_count": lambda: F.lit(1), "dead_ratio": DIMENSIONS["dead"], "high_risk_ratio": DIMENSIONS["high_risk"], "in_cycle_ratio": DIMENSIONS["in_cycle"]}


def parse_measure(token: str) -> tuple[str, str | None] | None:
    """('special', None) as (token, None), 'field:agg' as (field, agg); None for what is unknown."""
    if token in SPECIALS:
        return token, None
    name, _, agg = token.partition(":")
    return (name, agg) if name in FIELDS and agg in AGGREGATES else None


def alias(token: str) -> str:
    return token.replace(":", "_").replace(".", "_")


def measure_type(token: str) -> str:
    name, agg = parse_measure(token) or ("", None)
    if agg is None:
        return SPECIALS[name][1]
    return "int" if agg == "count" else "float" if agg in ("avg", "stddev") else FIELDS[name][1]


#: Dimensions that aren't shown by their own name.
DIMENSION_LABELS = {"dead": "dead/alive", "high_risk": "high-risk", "in_cycle": "in-cycle"}


def parse_dimension(token: str) -> tuple[str, str | None] | None:
    """(name, None) of a plain dimension, (field, mode) of a bucketed one; None for what is unknown."""
    if token in DIMENSIONS:
        return token, None
    name, _, mode = token.partition(":")
    return (name, mode) if name in BUCKETS and mode in MODES else None


def parse_list(text: str | None, default: list[str] = ()) -> list[str]:
    """Tokens parted by commas, empty ones left out."""
    return [x.strip() for x in text.split(",") if x.strip()] if text else list(default)


def dimension_label(token: str) -> str:
    """What a dimension is shown as: its name, of a bucketed one with the mode; unknown ones as they are."""
    name, mode = parse_dimension(token) or (token, None)
    return f"{name.replace('_', ' ')} ({mode})" if mode else DIMENSION_LABELS.get(name, name)


def measure_label(token: str) -> str:
    """What a measure is shown as: its field or name without the aggregate."""
    return token.partition(":")[0].replace("_", " ")


def metadata() -> dict:
    """What may be asked for."""
    return {"dimensions": list(DIMENSIONS), "bucket_fields": list(BUCKETS), "bucket_modes": {k: len(v) for k, v in MODES.items()}, "fields": {k: v[1] for k, v in FIELDS.items()}, "aggregates": list(AGGREGATES), "specials": {k: v[1] for k, v in SPECIALS.items()}}


def with_class(nodes: DataFrame) -> DataFrame:
    """class_name: the innermost class of the same file whose lines hold the symbol's; ties to the earliest end, then the hash."""
    cls = nodes.where(C("kind") == "class").select("repo_id", "file_path", C("line_start").alias("cs"), C("line_end").alias("ce"), C("name").alias("cn"), C("hash").alias("ch"))
    inside = nodes.select("repo_id", "hash", "file_path", "line_start", "line_end").join(cls, ["repo_id", "file_path"]).where((C("line_start") >= C("cs")) & (C("line_end") <= C("ce")))
    best = inside.groupBy("repo_id", "hash").agg(F.min(F.struct((-C("cs")).alias("s"), C("ce").alias("e"), C("ch").alias("h"), C("cn").alias("class_name"))).alias("b")).select("repo_id", "hash", "b.class_name")
    return nodes.join(best, ["repo_id", "hash"], "left")


def thresholds(rows: DataFrame, value: Column, k: int) -> DataFrame:
    """(repo_id, cuts): the elements floor(n i / k) + 1 of each snapshot's sorted values, i = 1 … k - 1.

    Values are counted first, so the window runs over distinct values. A snapshot without values has no row.
    """
    freq = rows.select("repo_id", value.cast("double").alias("v")).where(C("v").isNotNull()).groupBy("repo_id", "v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("repo_id")
    freq = freq.withColumn("end", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    hits = freq.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(k - 1)))).where((F.floor(C("n") * C("i") / k) < C("end")) & (F.floor(C("n") * C("i") / k) >= C("end") - C("c")))
    return hits.groupBy("repo_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("cuts"))


@dataclass
class Pivot:
    """What a pivot view shows. ``rows`` is None if no dimension or no measure is left."""

    rows: DataFrame | None
    dimensions: list[str]
    measures: list[str]
    types: dict[str, str]
    enriched: bool
    edges: DataFrame
    leaf_edges: DataFrame
    totals: DataFrame | None


@dataclass
class Explore:
    """A pivot over a catalog. Unknown dimensions and measures, and those whose data is missing, are dropped silently."""

    catalog: Catalog
    dimensions: list[str] = field(default_factory=lambda: ["module"])
    measures: list[str] = field(default_factory=lambda: ["symbol_count", "dead_ratio", "caller_count:avg"])
    kinds: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        c, self.asked = self.catalog, list(self.dimensions)
        ok = lambda d: (d in DIMENSIONS and (d not in ENRICHED or c.has_features) and (d not in NEEDS_SCHEMA or c.has_schema)) or (":" in d and d.split(":")[0] in BUCKETS and d.split(":")[1] in MODES and (c.has_features or not BUCKETS[d.split(":")[0]][1]))
        self.dimensions = [d for d in self.dimensions if ok(d)]
        self.measures = [m for m in self.measures if (p := parse_measure(m)) and (c.has_features or not (FIELDS[p[0]][2] if p[1] else SPECIALS[p[0]][2]))]

    def _enriched(self) -> bool:
        """Features are joined only where something asks for them."""
        dims = any(d in ENRICHED or (":" in d and BUCKETS[d.split(":")[0]][1]) for d in self.dimensions)
        return dims or any((FIELDS[p[0]][2] if p[1] else SPECIALS[p[0]][2]) for m in self.measures if (p := parse_measure(m)))

    def rows(self, extra: bool = False) -> DataFrame:
        """Symbols with a column d_<i> for each dimension."""
        df = self.catalog.enriched if extra or self._enriched() else self.catalog.internal_nodes
        if "class" in self.dimensions:
            df = with_class(df)
        if self.kinds:
            df = df.where(C("kind").isin(self.kinds))
        for i, d in enumerate(self.dimensions):
            if ":" in d:
                name, mode = d.split(":")
                value, labels = BUCKETS[name][0](), MODES[mode]
                # one row a snapshot, kept so that its count doesn't run it again
                cuts = keep(thresholds(df, value, len(labels)), "cuts")
                df = df.join(small(cuts), "repo_id", "left")
                case = F.when(F.lit(False), labels[0])
                for j, label in enumerate(labels[:-1]):
                    case = case.when(value < C("cuts")[j], label)
                df = df.withColumn(f"d_{i}", case.otherwise(labels[-1])).drop("cuts")
            else:
                df = df.withColumn(f"d_{i}", DIMENSIONS[d]())
        return df

    def _aggregates(self) -> list[Column]:
        out = []
        for m in self.measures:
            name, agg = parse_measure(m)  # type: ignore[misc]
            out.append((AGGREGATES[agg](C(FIELDS[name][0])) if agg else SPECIALS[name][0]()).alias(alias(m), metadata={"measure_type": measure_type(m)}))
        return out

    def pivot(self) -> DataFrame:
        """repo_id, the dimensions, the measures, one row for each combination."""
        keys = [C(f"d_{i}").alias(alias(d)) for i, d in enumerate(self.dimensions)]
        return self.rows().groupBy("repo_id", *keys).agg(*self._aggregates())

    def tree(self) -> DataFrame:
        """All levels at once: depth (1 …), the dimensions down to it (null below), the measures.

        One roll-up of one scan; ``depth`` tells null values of a dimension from the levels above it.
        """
        n = len(self.dimensions)
        names = [f"d_{i}" for i in range(n)]
        df = self.rows()
        grouped = df.groupingSets([[C("repo_id"), *[C(x) for x in names[: k + 1]]] for k in range(n)], C("repo_id"), *[C(x) for x in names]).agg(F.grouping_id().alias("gid"), *self._aggregates())
        depth = F.lit(n) - F.bit_count("gid")
        return grouped.select("repo_id", depth.cast("int").alias("depth"), *[C(x).alias(alias(d)) for x, d in zip(names, self.dimensions)], *[alias(m) for m in self.measures])

    def ordered_tree(self) -> DataFrame:
        """The tree with ``place``: that of a row among the children of its parent, those of most symbols first, then by value."""
        tree = self.tree()
        names = [alias(d) for d in self.dimensions]
        depth = C("depth")
        parent = [F.when(depth > i + 1, C(x)) for i, x in enumerate(names)]
        own = F.coalesce(*[F.when(depth == i + 1, C(x).cast("string")) for i, x in enumerate(names)])
        by = [C("symbol_count").desc()] if "symbol_count" in self.measures else []
        w = Window.partitionBy("repo_id", "depth", *parent).orderBy(*by, own.asc_nulls_first())
        return tree.withColumn("place", F.row_number().over(w))

    def leaves(self, tree: DataFrame) -> DataFrame:
        """The innermost rows of a tree."""
        return tree.where(C("depth") == len(self.dimensions))

    def group_key(self, level: int) -> Column:
        """The values down to a level (0 …) as one text; null values are ''."""
        return F.concat_ws("::", *[F.coalesce(C(alias(d)).cast("string"), F.lit("")) for d in self.dimensions[: level + 1]])

    def graph_nodes(self, size: str = "symbol_count", colour: str | None = None, tree: DataFrame | None = None) -> DataFrame:
        """(repo_id, id, group_path, radius, shade, colour): the innermost rows of a pivot as nodes of a graph.

        id is the innermost value; if it lies in several groups, the row of greatest size counts, ties to the least group.
        radius grows with the root of the size's share of the greatest one, from 4 to 22. shade, from 0 to 1, is the place
        of the colour measure between its least and greatest finite value; half without a colour measure.
        """
        names = [alias(d) for d in self.dimensions]
        rows = self.leaves(self.tree() if tree is None else tree).where(C(names[-1]).isNotNull())
        path = F.array(*[C(x).cast("string") for x in names[:-1]]) if len(names) > 1 else F.array().cast("array<string>")
        value = F.coalesce(C(alias(size)).cast("double"), F.lit(0.0))
        shown = C(alias(colour)).cast("double") if colour else F.lit(None).cast("double")
        finite = F.when(shown.isNotNull() & ~F.isnan(shown) & (F.abs(shown) < float("inf")), shown)
        rows = rows.select("repo_id", C(names[-1]).cast("string").alias("id"), path.alias("group_path"), value.alias("size"), shown.alias("shown"), finite.alias("finite"))
        spans = rows.groupBy("repo_id").agg(F.greatest(F.lit(1.0), F.max("size")).alias("most"), F.min("finite").alias("lo"), F.max("finite").alias("hi"))
        spans = spans.withColumn("hi", F.when(C("hi") == C("lo"), C("lo") + 1).otherwise(C("hi")))
        best = rows.groupBy("repo_id", "id").agg(F.min(F.struct((-C("size")).alias("s"), "group_path", "shown")).alias("b"))
        shade = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (C("b.shown") - C("lo")) / (C("hi") - C("lo")))), F.lit(0.5))
        radius = F.sqrt(F.when(C("b.s") == 0, 1.0).otherwise(-C("b.s")) / C("most")) * 18 + 4
        out = best.join(small(spans), "repo_id").select("repo_id", "id", C("b.group_path").alias("group_path"), F.round(radius, 6).alias("radius"), F.round(shade, 6).alias("shade"))
        return out.withColumn("colour", blend_colours("#3fb950", "#f85149", C("shade")))

    def graph_data(self, size: str = "symbol_count", colour: str | None = None, least_weight: int = 1, top: int | None = None, connected: bool = False) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of a pivot: edges over the innermost dimension, thinned, with both ends among the nodes; nodes without edges left out if ``connected``."""
        nodes = self.graph_nodes(size, colour)
        edges = filters.valid_edges(filters.thin_edges(self.induced_edges(self.dimensions[-1]), least_weight, top), nodes)
        return (filters.without_isolated(nodes, edges) if connected else nodes), edges

    def envelope(self) -> Pivot:
        """All that a pivot view shows; symbols where no dimension or only the symbol is asked for."""
        by_symbol = self.asked in ([], ["symbol"])
        rows = self.symbols() if by_symbol else self.ordered_tree() if self.dimensions and self.measures else None
        none = lambda: self.induced_edges("")
        return Pivot(
            rows=rows,
            dimensions=["symbol"] if by_symbol else self.dimensions,
            measures=[alias(m) for m in self.measures],
            types={alias(m): measure_type(m) for m in self.measures},
            enriched=self.catalog.has_features,
            edges=self.symbol_edges() if by_symbol else self.induced_edges(self.dimensions[0]) if self.dimensions else none(),
            leaf_edges=self.induced_edges(self.dimensions[-1]) if len(self.dimensions) > 1 else none(),
            totals=self.totals(SYMBOLS) if by_symbol else None,
        )

    def symbols(self, limit: int = SYMBOLS) -> DataFrame:
        """Symbol grain: raw fields under the measures' names, most callers first, ``limit`` rows a snapshot."""
        fields = []
        for m in self.measures:
            name, agg = parse_measure(m)  # type: ignore[misc]
            fields.append((C(FIELDS[name][0]) if agg else _FIELD_OF_SPECIAL[name]()).alias(alias(m)))
        first = Window.partitionBy("repo_id").orderBy(C("caller_count").desc_nulls_last(), C("name").asc_nulls_first(), "hash")
        rows = self.rows().withColumn("row_no", F.row_number().over(first)).where(C("row_no") <= limit)
        return rows.select("repo_id", "row_no", "hash", symbol(C("module"), C("name")).alias("symbol"), *fields)

    def totals(self, limit: int) -> DataFrame:
        """(repo_id, total_count, shown_count, truncated) of a list of symbols that shows ``limit`` a snapshot."""
        n = self.rows().groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_count"))
        return n.select("repo_id", "total_count", F.least("total_count", F.lit(limit)).alias("shown_count"), (C("total_count") > limit).alias("truncated"))

    def symbol_edges(self, symbols: int = SYMBOLS, limit: int = 2000) -> DataFrame:
        """(repo_id, row_no, source, target, weight): edge rows among the symbols shown, most calls first, ``limit`` a snapshot."""
        shown = keep(self.symbols(symbols).select("repo_id", "hash", "symbol"), "shown")
        e = self.catalog.edges.select("repo_id", "caller_hash", "callee_hash", "call_count")
        for end, name in (("caller_hash", "source"), ("callee_hash", "target")):
            e = e.join(shown.select("repo_id", C("hash").alias(end), C("symbol").alias(name)), ["repo_id", end])
        first = Window.partitionBy("repo_id").orderBy(C("call_count").desc_nulls_last(), "caller_hash", "callee_hash")
        return e.withColumn("row_no", F.row_number().over(first)).where(C("row_no") <= limit).select("repo_id", "row_no", "source", "target", C("call_count").alias("weight"))

    def induced_edges(self, dimension: str) -> DataFrame:
        """source, target, weight: the quotient graph over a dimension, null and equal ends left out, edge rows counted."""
        if dimension not in EDGE_DIMENSIONS:
            return self.catalog.spark.createDataFrame([], "repo_id string, source string, target string, weight long")
        ends = Explore(self.catalog, [dimension], [], self.kinds).rows().select("repo_id", "hash", C("d_0").alias("d")).where(C("d").isNotNull())
        e = self.catalog.edges.select("repo_id", "caller_hash", "callee_hash")
        e = e.join(ends.select("repo_id", C("hash").alias("caller_hash"), C("d").alias("source")), ["repo_id", "caller_hash"]).join(ends.select("repo_id", C("hash").alias("callee_hash"), C("d").alias("target")), ["repo_id", "callee_hash"])
        return e.where(C("source") != C("target")).groupBy("repo_id", "source", "target").agg(F.count(F.lit(1)).alias("weight"))

    def picker_values(self) -> DataFrame:
        """Distinct non-null values of the short dimensions: (repo_id, dimension, value), in one pass."""
        c = self.catalog
        dims = ["module", "risk", "kind", "directory", "dead", "high_risk", *(["framework", "async", "exported"] if c.has_schema else []), *(["community"] if c.has_features else [])]
        df = c.enriched if c.has_features else c.internal_nodes
        if self.kinds:
            df = df.where(C("kind").isin(self.kinds))
        pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), DIMENSIONS[d]().alias("value")) for d in dims]))
        return df.select("repo_id", pairs.alias("p")).select("repo_id", "p.dimension", "p.value").where(C("value").isNotNull()).distinct()

    def merged_picker_values(self) -> DataFrame:
        """The values of the short dimensions and those that the pivot itself shows, buckets included; empty ones left out."""
        names = [(d, alias(d)) for d in self.dimensions]
        pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), C(x).cast("string").alias("value")) for d, x in names]))
        shown = self.pivot().select("repo_id", pairs.alias("p")).select("repo_id", "p.dimension", "p.value").where(C("value") != "")
        return self.picker_values().unionByName(shown).distinct()

    def node_table(self, sort: str = "caller_count", descending: bool = True, limit: int = 300) -> DataFrame:
        """Raw symbols by an allowed column (else caller_count), the hash breaking ties, with the 8 calls of greatest count each."""
        allowed = {"caller_count", "callee_count", "complexity", "name", "module"}
        enriched = {"utility_score", "pagerank", "xmod_fan_in"}
        c = self.catalog
        by = C(sort if sort in allowed or (sort in enriched and c.has_features) else "caller_count")
        by = by.desc_nulls_last() if descending else by.asc_nulls_first()
        df = c.enriched if c.has_features else c.internal_nodes
        if self.kinds:
            df = df.where(C("kind").isin(self.kinds))
        rows = df.withColumn("row_no", F.row_number().over(Window.partitionBy("repo_id").orderBy(by, "hash"))).where(C("row_no") <= limit)
        signals = [x for x in ("utility_score", "pagerank", "xmod_fan_in", "xmod_fan_out", "scc_size", "topological_depth", "complexity_pct") if x in df.columns]
        rows = keep(rows.select("repo_id", "row_no", "hash", *NODE_COLUMNS, *SCHEMA_COLUMNS, *signals), "node-table")
        return rows.join(top_callees(c, rows), ["repo_id", "hash"], "left")


def top_callees(catalog: Catalog, of: DataFrame | None = None, n: int = 8) -> DataFrame:
    """(repo_id, hash, outbound): the n edge rows of greatest count of each symbol (of ``of``), ties by the callee's hash, in one join for all."""
    e = catalog.edges.where(internal("callee_hash")).select("repo_id", C("caller_hash").alias("hash"), "callee_hash", "call_count")
    if of is not None:
        e = e.join(of.select("repo_id", "hash"), ["repo_id", "hash"], "left_semi")
    callee = catalog.internal_nodes.select("repo_id", C("hash").alias("callee_hash"), "name", "module")
    w = Window.partitionBy("repo_id", "hash").orderBy(C("call_count").desc_nulls_last(), "callee_hash")
    top = e.join(callee, ["repo_id", "callee_hash"]).withColumn("r", F.row_number().over(w)).where(C("r") <= n)
    one = F.struct("r", C("callee_hash").alias("hash"), "name", "module", "call_count")
    return top.groupBy("repo_id", "hash").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("r")).alias("outbound"))


def search(catalog: Catalog, text: str, limit: int = 20) -> DataFrame:
    """Internal symbols whose name holds the text in any case, most callers first. ``%`` and ``_`` are wild."""
    rows = catalog.internal_nodes.where(C("name").ilike(f"%{text}%"))
    w = Window.partitionBy("repo_id").orderBy(C("caller_count").desc_nulls_last(), "hash")
    fields = ["hash", "name", "kind", "module", "file_path", "line_start", "caller_count", "callee_count", "risk"]
    return rows.withColumn("row_no", F.row_number().over(w)).where(C("row_no") <= limit).select("repo_id", "row_no", *fields)
