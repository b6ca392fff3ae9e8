"""The code graph of one or many snapshots: counting rows, probes of optional parts, and fixed scans."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property

from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.operators.rows import latest, latest_parents
from symgrid.sources.tables import keep, table

NODE_COLUMNS = ["name", "module", "file_path", "line_start", "line_end", "kind", "risk", "complexity", "caller_count", "callee_count"]
SCHEMA_COLUMNS = ["is_async", "arity", "is_exported", "is_self_recursive", "decorators", "base_classes", "return_type", "framework_entry_point", "ext_package"]
EXTERNAL_MODULE = "__external__"


class RepoNotFound(LookupError):
    """No snapshot of that repo_id."""


class UnreadableSnapshot(ValueError):
    """A table or column that a query needs is missing or malformed."""


@contextmanager
def reading() -> Iterator[None]:
    """Errors of missing or malformed tables as ``UnreadableSnapshot``; others stay as they are."""
    try:
        yield
    except (AnalysisException, SparkRuntimeException) as e:
        known = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "UNRESOLVED_COLUMN", "FIELD_NOT_FOUND", "FAILED_READ_FILE", "UNABLE_TO_INFER_SCHEMA")
        if str(e.getCondition() or "").split(".")[0] in known:
            raise UnreadableSnapshot(str(e).splitlines()[0]) from e
        raise


def internal(hash_: str | Column = "hash") -> Column:
    """Whether a hash is that of a symbol of the project itself."""
    return ~(F.col(hash_) if isinstance(hash_, str) else hash_).startswith("ext:")


class Catalog:
    """Tables below a folder, of one snapshot (``open``) or of all.

    Of repeated deliveries the counting row is taken. kind and risk are lower case, an unknown complexity is null.
    Edges keep their repetitions (``edges``) or not (``edges_distinct``); ends may not be null or empty.
    """

    def __init__(self, spark: SparkSession, folder: str, repo_id: str | None = None) -> None:
        self.spark, self.folder, self.repo_id = spark, folder, repo_id

    def open(self, repo_id: str) -> Catalog:
        if not self.raw("nodes").where(F.col("repo_id") == repo_id).limit(1).count():
            raise RepoNotFound(repo_id)
        return Catalog(self.spark, self.folder, repo_id)

    def raw(self, name: str) -> DataFrame:
        with reading():
            df = table(self.spark, self.folder, name)
        return df.where(F.col("repo_id") == self.repo_id) if self.repo_id is not None and "repo_id" in df.columns else df

    def kept(self) -> Catalog:
        """The same catalog with nodes and edges written once to the shared folder, for what reads them many times."""
        out = Catalog(self.spark, self.folder, self.repo_id)
        out.nodes = keep(self.nodes, "nodes")
        out.edges = keep(self.edges, "edges")
        out.edges_distinct = keep(out.edges_distinct, "edges-distinct")
        return out

    def has(self, name: str) -> bool:
        try:
            self.raw(name)
        except UnreadableSnapshot:
            return False
        return True

    @cached_property
    def has_features(self) -> bool:
        return self.has("node_features")

    @cached_property
    def has_schema(self) -> bool:
        return "is_async" in self.raw("nodes").columns

    @cached_property
    def has_inheritance(self) -> bool:
        return self.has("inheritance")

    @cached_property
    def nodes(self) -> DataFrame:
        raw = self.raw("nodes").where(F.col("hash").isNotNull())
        have = [c for c in [*NODE_COLUMNS, *SCHEMA_COLUMNS] if c in raw.columns]
        rows = latest(raw, ["repo_id", "hash"], "loaded_at", have).withColumns({"kind": F.lower("kind"), "risk": F.lower("risk"), "complexity": F.when(F.col("complexity") >= 0, F.col("complexity"))})
        return rows.withColumns({c: F.lit(None).cast("string") for c in SCHEMA_COLUMNS if c not in have})

    @cached_property
    def internal_nodes(self) -> DataFrame:
        return self.nodes.where(internal())

    @cached_property
    def features(self) -> DataFrame:
        raw = self.raw("node_features")
        return latest(raw, ["repo_id", "hash"], "computed_at", [c for c in raw.columns if c not in ("repo_id", "hash", "computed_at")])

    @cached_property
    def edges(self) -> DataFrame:
        return self.raw("edges").where((F.col("caller_hash") != "") & (F.col("callee_hash") != "")).select("repo_id", "caller_hash", "callee_hash", "call_count", F.lower("edge_kind").alias("edge_kind"))

    @cached_property
    def edges_distinct(self) -> DataFrame:
        """Distinct edges between internal symbols that both exist."""
        ends = self.internal_nodes.select("repo_id", "hash")
        e = self.edges.where(internal("caller_hash") & internal("callee_hash")).select("repo_id", F.col("caller_hash").alias("src"), F.col("callee_hash").alias("dst")).distinct()
        return e.join(ends.withColumnRenamed("hash", "src"), ["repo_id", "src"], "left_semi").join(ends.withColumnRenamed("hash", "dst"), ["repo_id", "dst"], "left_semi").select("repo_id", "src", "dst")

    @cached_property
    def module_edges(self) -> DataFrame:
        """Latest count of each pair of modules, the external module left out."""
        raw = self.raw("module_edges").where(F.col("caller_module").isNotNull() & F.col("callee_module").isNotNull())
        rows = latest(raw, ["repo_id", "caller_module", "callee_module"], "loaded_at", ["edge_count"])
        return rows.where((F.col("caller_module") != EXTERNAL_MODULE) & (F.col("callee_module") != EXTERNAL_MODULE))

    @cached_property
    def inheritance(self) -> DataFrame:
        return latest_parents(self.raw("inheritance"))

    @cached_property
    def enriched(self) -> DataFrame:
        """Internal nodes with their features, null where there are none."""
        return self.internal_nodes.join(self.features, ["repo_id", "hash"], "left")

    @cached_property
    def calls(self) -> DataFrame:
        """Edge rows with name, module, kind of both internal ends (s_…, t_…)."""
        columns = ("name", "module", "kind", "caller_count")
        side = lambda p, h: self.internal_nodes.select("repo_id", F.col("hash").alias(h), *[F.col(c).alias(f"{p}_{c}") for c in columns])
        return self.edges.join(side("s", "caller_hash"), ["repo_id", "caller_hash"]).join(side("t", "callee_hash"), ["repo_id", "callee_hash"])

    @cached_property
    def call_rows(self) -> DataFrame:
        """(repo_id, src, dst, s_module, t_module, n): each pair of internal symbols with the number of its edge rows.

        Edges are counted before they meet the nodes: a callee with a tenth of all rows has one row a caller then.
        """
        e = self.edges.where(internal("caller_hash") & internal("callee_hash")).groupBy("repo_id", F.col("caller_hash").alias("src"), F.col("callee_hash").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
        side = lambda h, m: self.internal_nodes.select("repo_id", F.col("hash").alias(h), F.col("module").alias(m))
        return e.join(side("src", "s_module"), ["repo_id", "src"]).join(side("dst", "t_module"), ["repo_id", "dst"]).select("repo_id", "src", "dst", "s_module", "t_module", "n")

    def scan(self, fields: list[str] | None = None, where: Column | None = None, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
        """Internal symbols, chosen columns, a condition, and the first ``limit`` of each snapshot by ``order``, the hash breaking ties.

        repo_id and hash are always there. row_no, from 1, says the order where there is one or a limit.
        """
        df = self.internal_nodes if where is None else self.internal_nodes.where(where)
        fields = [c for c in (fields or df.columns) if c not in ("repo_id", "hash")]
        if order is None and limit is None:
            return df.select("repo_id", "hash", *fields)
        w = Window.partitionBy("repo_id").orderBy(*(order or []), "hash")
        df = df.withColumn("row_no", F.row_number().over(w))
        return (df if limit is None else df.where(F.col("row_no") <= limit)).select("repo_id", "row_no", "hash", *fields)

    def internal_edges(self) -> DataFrame:
        """Edge rows of which neither end is external."""
        return self.edges.where(internal("caller_hash") & internal("callee_hash")).select("repo_id", "caller_hash", "callee_hash", "call_count")

    def graph(self, external: bool = False) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of the whole graph; distinct edges with both ends among the nodes.

        Without external symbols their edges are left out; the nodes stay, as they may be asked for by name.
        """
        fields = ["name", "kind", "module", "file_path", "line_start", "complexity", "caller_count", "callee_count", "risk"]
        nodes = self.nodes.select("repo_id", "hash", *fields)
        e = self.edges if external else self.edges.where(internal("caller_hash") & internal("callee_hash"))
        # of repeated edges the greatest count
        e = e.groupBy("repo_id", "caller_hash", "callee_hash").agg(F.max("call_count").alias("call_count"))
        for end in ("caller_hash", "callee_hash"):
            e = e.join(nodes.select("repo_id", F.col("hash").alias(end)), ["repo_id", end], "left_semi")
        return nodes, e.select("repo_id", "caller_hash", "callee_hash", "call_count")

    def graph_page(self, module: str | None = None, limit: int = 300, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """A page of the internal symbols of each snapshot, by hash, and the edges between them."""
        where = None if module is None else F.col("module") == module
        fields = ["name", "kind", "module", "file_path", "line_start", "complexity", "caller_count", "callee_count", "risk"]
        nodes = self.scan(fields, where, [], limit + offset).where(F.col("row_no") > offset)
        return nodes, self.edges_within(nodes).select("repo_id", "caller_hash", "callee_hash", "call_count")

    def modules_of(self) -> Column:
        """Counts the modules of internal symbols."""
        return F.countDistinct(F.when(internal(), F.col("module")))

    def repos(self) -> DataFrame:
        """Every snapshot with its numbers of symbols, edges and modules, and whether it has features."""
        n = self.nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("node_count"), self.modules_of().alias("module_count"))
        e = self.edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("edge_count"))
        out = n.join(e, "repo_id", "left")
        if self.has_features:
            out = out.join(self.raw("node_features").select("repo_id").distinct().withColumn("enriched", F.lit(True)), "repo_id", "left")
        else:
            out = out.withColumn("enriched", F.lit(False))
        return out.select("repo_id", F.split("repo_id", "@", 2)[0].alias("project"), "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), "module_count", F.coalesce("enriched", F.lit(False)).alias("enriched"))

    def overview(self) -> DataFrame:
        """By snapshot: all symbols and edges, modules, symbols without callers, symbols that both call and are called (external ones included)."""
        n = self.nodes.groupBy("repo_id").agg(
            F.count(F.lit(1)).alias("node_count"),
            self.modules_of().alias("module_count"),
            F.count_if(internal() & (F.col("caller_count") == 0)).alias("dead_count"),
            F.count_if(internal() & F.col("risk").isin("high", "critical")).alias("high_risk_count"),
        )
        # each end once for each role: what has both is a candidate
        role = lambda c, r: F.struct(F.col(c).alias("h"), F.lit(r).alias("role"))
        ends = self.edges.select("repo_id", F.explode(F.array(role("caller_hash", 1), role("callee_hash", 2))).alias("e"))
        roles = ends.groupBy("repo_id", "e.h").agg(F.bit_or("e.role").alias("roles"), F.count_if(F.col("e.role") == 1).alias("k"))
        e = roles.groupBy("repo_id").agg(F.sum("k").alias("edge_count"), F.count_if(F.col("roles") == 3).alias("cycle_candidates"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return n.join(e, "repo_id", "left").select("repo_id", "node_count", zero("edge_count"), "module_count", "dead_count", "high_risk_count", zero("cycle_candidates"))

    def top_modules(self, n: int = 10) -> DataFrame:
        """The n modules with most symbols of each snapshot, ties by name."""
        rows = self.internal_nodes.where(F.col("module").isNotNull()).groupBy("repo_id", "module").agg(F.count(F.lit(1)).alias("symbol_count"))
        w = Window.partitionBy("repo_id").orderBy(F.col("symbol_count").desc(), "module")
        return rows.withColumn("row_no", F.row_number().over(w)).where(F.col("row_no") <= n)

    def top_module_edges(self, n: int = 200) -> DataFrame:
        """The n pairs of modules with most calls of each snapshot, ties by name."""
        w = Window.partitionBy("repo_id").orderBy(F.col("edge_count").desc_nulls_last(), "caller_module", "callee_module")
        return self.module_edges.withColumn("row_no", F.row_number().over(w)).where(F.col("row_no") <= n).select("repo_id", "row_no", "caller_module", "callee_module", "edge_count")

    def risks(self) -> DataFrame:
        return self.internal_nodes.groupBy("repo_id", "risk").agg(F.count(F.lit(1)).alias("n"))

    def weighted_edges(self) -> DataFrame:
        """Pairs with the number of their edge rows; only the callee must be internal."""
        return self.edges.where(internal("callee_hash")).groupBy("repo_id", "caller_hash", "callee_hash").agg(F.count(F.lit(1)).alias("weight"))

    def edges_within(self, chosen: DataFrame) -> DataFrame:
        """Edge rows with both ends among (repo_id, hash) ``chosen`` and an internal callee."""
        e = self.edges.where(internal("callee_hash"))
        for end in ("caller_hash", "callee_hash"):
            e = e.join(chosen.select("repo_id", F.col("hash").alias(end)), ["repo_id", end], "left_semi")
        return e

    def module_stats(self) -> DataFrame:
        """Symbols and complexity of each module of internal symbols."""
        zero = lambda x: F.coalesce(x, F.lit(0))
        rows = self.internal_nodes.where(F.col("module").isNotNull()).groupBy("repo_id", "module")
        return rows.agg(F.count(F.lit(1)).alias("symbol_count"), zero(F.sum("complexity")).alias("total_complexity"), F.coalesce(F.round(F.avg("complexity"), 6), F.lit(0.0)).alias("avg_complexity"))

    def write_features(self, features: DataFrame, path: str) -> None:
        """Features as a dataset of its own, one folder a snapshot; the source and the folders of other snapshots stay as they are."""
        features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)


class LoadBearing:
    """Declared load-bearing modules and symbols, kept as a small JSON file; a missing file is an empty declaration."""

    def __init__(self, path: str) -> None:
        self.path = path
        try:
            with open(path) as f:
                self.of = json.load(f)
        except FileNotFoundError:
            self.of = {}
        self.of = {k: list(self.of.get(k, [])) for k in ("declared_modules", "declared_nodes")}

    def declare(self, kind: str, value: str) -> None:
        if value not in self.of[kind]:
            self.of[kind].append(value)
        self._save()

    def undeclare(self, kind: str, value: str) -> None:
        self.of[kind] = [x for x in self.of[kind] if x != value]
        self._save()

    def _save(self) -> None:
        with open(self.path, "w") as f:
            json.dump(self.of, f)
