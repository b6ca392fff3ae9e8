"""Problem 6: parent-child rows to paths, depths, roots, descendants and cycles.

Connected components are found first; each component is brought to one task, which walks it depth-first without
recursion and colours its nodes: an edge back to a grey node closes a circle. Components above ``LARGEST`` nodes are
not brought together: their circles and then their ancestors are found by doubling the distance of each node's pointer,
with joins alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgrid.operators.components import components
from symgrid.operators.rows import is_reference, latest_parents
from symgrid.sources.tables import forget, keep, small

#: Nodes up to which a component is walked by one task (some 100 MB of Python lists at most).
LARGEST = 100_000
#: Rows of whole components that a task walks together, and path elements that it gives out at once.
CHUNK, ELEMENTS = 50_000, 1_000_000
ON_CYCLE, BELOW_CYCLE = -1, -2
_KEY = ["repo", "node"]
_TYPES = {
    "repo_id": ("string", pa.string()),
    "hash": ("string", pa.string()),
    "root_hash": ("string", pa.string()),
    "depth": ("int", pa.int32()),
    "circle": ("string", pa.string()),
    "closes": ("boolean", pa.bool_()),
    "n_descendants": ("long", pa.int64()),
    "path": ("array<string>", pa.list_(pa.string())),
}


class Walk:
    """A depth-first walk over whole components. ``parent`` has the number of each node's parent or -1, ``name`` their names.

    order: nodes as they are reached; level: steps from origin, which is the root or the nearest node of a circle;
    below: number of descendants; on: whether a node lies on a circle; start: the least node of the circle that a node
    is on or below, -1 without one.
    """

    WHITE, GREY, BLACK = 0, 1, 2

    def __init__(self, parent: list[int], name: list[str]) -> None:
        n = len(parent)
        self.parent, self.name = parent, name
        self.order: list[int] = []
        self.level, self.below, self.origin, self.start = [0] * n, [0] * n, list(range(n)), [-1] * n
        self.on = bytearray(n)
        self._colour, self._place = bytearray(n), [0] * n
        self._next, self._then = [-1] * n, [-1] * n  # first child not yet walked, next child of the same parent
        for c in range(n - 1, -1, -1):
            if (p := parent[c]) >= 0:
                self._then[c], self._next[p] = self._next[p], c
        for node in range(n):
            if parent[node] < 0:
                self._down(node, -1)
        for node in range(n):  # what no root reaches hangs on a circle
            if not self._colour[node]:
                self._circle(node)

    def _down(self, top: int, circle: int) -> None:
        colour, then, order = self._colour, self._then, self.order
        colour[top] = self.GREY
        self._place[top] = len(order)
        order.append(top)
        self.start[top] = circle
        stack = [top]
        while stack:
            v = stack[-1]
            child = self._next[v]
            if child < 0:
                stack.pop()
                colour[v] = self.BLACK
                self.below[v] = len(order) - 1 - self._place[v]
                continue
            self._next[v] = then[child]
            if colour[child] == self.WHITE:
                colour[child] = self.GREY
                if not self.on[child]:
                    self.level[child], self.origin[child] = self.level[v] + 1, self.origin[v]
                self.start[child] = circle
                self._place[child] = len(order)
                order.append(child)
                stack.append(child)

    def _circle(self, node: int) -> None:
        """Climbs from a white node until a grey one closes the circle, then walks down from the circle's least node."""
        way = []
        while not self._colour[node]:
            self._colour[node] = self.GREY
            way.append(node)
            node = self.parent[node]
        for x in way:
            self._colour[x] = self.WHITE
        around = way[way.index(node) :]
        for x in around:
            self.on[x] = 1
        top = min(around, key=self.name.__getitem__)
        self._down(top, top)
        reached = self.below[top] + 1
        for x in around:  # each node of a circle descends from all of it
            self.below[x] = reached

    def rows(self, columns: list[str]) -> Iterator[tuple[int, tuple]]:
        """(node, values of columns) in the order of the walk; a path is built from the way down to its node."""
        way: list[str] = []
        name = self.name
        for v in self.order:
            level, circle = self.level[v], self.start[v]
            value: dict[str, object] = {"hash": name[v], "n_descendants": self.below[v]}
            if circle < 0:
                value |= {"root_hash": name[self.origin[v]], "depth": level, "circle": None, "closes": False}
            else:
                value |= {"root_hash": "", "depth": ON_CYCLE if self.on[v] else BELOW_CYCLE, "circle": name[circle], "closes": v == circle}
            if "path" in columns:
                del way[level:]
                if level:
                    way[0] = name[self.origin[v]]
                way.append(name[v])
                value["path"] = None if self.on[v] else way.copy()
            yield v, tuple(value[c] for c in columns)


def _walk_partition(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (component, repo_id, child, parent) sorted by component in, one row a node out."""
    schema = pa.schema([("repo_id", pa.string()), *[(c, _TYPES[c][1]) for c in columns]])

    def treat(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repos, children, parents = pa.Table.from_batches(held).select([1, 2, 3]).to_pydict().values()
        number: dict[tuple[str | None, str], int] = {}
        of = lambda key: number.setdefault(key, len(number))
        links = [(of((r, c)), -1 if p is None else of((r, p))) for r, c, p in zip(repos, children, parents)]
        parent = [-1] * len(number)
        for c, p in links:
            if p >= 0:
                parent[c] = p
        keys = list(number)
        out: list[tuple] = []
        size = 0
        for v, row in Walk(parent, [k[1] for k in keys]).rows(columns):
            out.append((keys[v][0], *row))
            size += 1 + (len(row[-1] or ()) if columns[-1] == "path" else 0)
            if size >= ELEMENTS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            last = held[-1].column(0)[-1] if held else None
            comp = b.column(0).to_numpy()
            same = 0 if last is None else int((comp == last.as_py()).argmin()) if comp[-1] != last.as_py() else b.num_rows
            if n >= CHUNK and same < b.num_rows:  # a new component begins
                yield from treat([*held, b.slice(0, same)])
                held, n = [b.slice(same)], b.num_rows - same
            else:
                held.append(b)
                n += b.num_rows
        if held:
            yield from treat(held)

    return run


def _repo() -> Column:
    """repo_id as a key that joins nulls with nulls."""
    return F.coalesce(F.concat(F.lit("r"), "repo_id"), F.lit(""))


def _circles(links: DataFrame) -> DataFrame:
    """(repo, node, circle) of the nodes on circles, with the least node of each. links: repo, node, anc, every node once.

    A round doubles the distance of each pointer; nodes whose pointer would pass a root are dropped. If a round drops
    none, only nodes on and below circles are left, since a deeper tree has nodes for each round. Once the distance is as
    large as their number, every pointer stands on a circle, and the pointers of a circle cover it.
    """
    first = links.where(F.col("anc").isNotNull())
    open_, distance, left = keep(first, "circles"), 1, None
    while (n := open_.count()) and (n != left or distance < n):
        left, distance, old = n, distance * 2, open_
        up = old.select("repo", F.col("node").alias("anc"), F.col("anc").alias("next"))
        open_ = keep(old.join(up, ["repo", "anc"]).select(*_KEY, F.col("next").alias("anc")), "circles")
        forget(old)
    on = open_.select("repo", F.col("anc").alias("node")).distinct()
    # the least node within 2^k steps up, until a round changes none
    least = keep(first.join(on, _KEY, "left_semi").select(*_KEY, "anc", F.col("node").alias("circle"), F.lit(True).alias("moved")), "circles")
    while least.where("moved").limit(1).count():
        old = least
        up = old.select("repo", F.col("node").alias("anc"), F.col("anc").alias("next"), F.col("circle").alias("other"))
        both = old.join(up, ["repo", "anc"])
        least = keep(both.select(*_KEY, F.col("next").alias("anc"), F.least("circle", "other").alias("circle"), (F.col("other") < F.col("circle")).alias("moved")), "circles")
        forget(old)
    forget(open_)
    return least.select(*_KEY, "circle")


def _double(links: DataFrame, columns: list[str]) -> DataFrame:
    """The same columns for components of any size. links: component, repo_id, child, parent (null for a root), every node once.

    A round joins each node with the one that its pointer names: pointers and ways double, and the nodes within the
    distance so far are added up for the node that lies that far above them.
    """
    paths = "path" in columns
    links = keep(links.select("component", _repo().alias("repo"), F.col("child").alias("node"), F.col("parent").alias("anc")), "double")
    circles = _circles(links.drop("component"))
    # with the nodes on circles as roots the rest is trees
    first = links.join(circles, _KEY, "left").select(
        "component",
        *_KEY,
        "circle",
        F.when(F.col("circle").isNull(), F.col("anc")).alias("anc"),
        F.when(F.col("circle").isNull() & F.col("anc").isNotNull(), F.col("anc")).otherwise(F.col("node")).alias("top"),
        F.when(F.col("circle").isNull() & F.col("anc").isNotNull(), 1).otherwise(0).alias("steps"),
        F.lit(1).cast("long").alias("size"),
        *([F.array("node").alias("path")] if paths else []),
    )
    state = keep(first, "double")
    while (open_ := state.where(F.col("anc").isNotNull())).limit(1).count():
        gain = open_.groupBy("repo", F.col("anc").alias("node")).agg(F.sum("size").alias("gain"))
        up = state.select("repo", F.col("node").alias("at"), F.col("anc").alias("anc2"), F.col("top").alias("top2"), F.col("steps").alias("steps2"), *([F.col("path").alias("path2")] if paths else []))
        both = state.withColumn("at", F.col("anc")).join(gain, _KEY, "left").join(up, ["repo", "at"], "left")
        more = F.col("anc").isNotNull()
        old, state = state, both.select(
            "component",
            *_KEY,
            "circle",
            F.col("anc2").alias("anc"),
            F.when(more, F.col("top2")).otherwise(F.col("top")).alias("top"),
            (F.col("steps") + F.when(more, F.col("steps2")).otherwise(0)).alias("steps"),
            (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"),
            *([F.when(more, F.concat("path2", "path")).otherwise(F.col("path")).alias("path")] if paths else []),
        )
        state = keep(state, "double")
        forget(old)
    tops = circles.select("repo", F.col("node").alias("top"), F.col("circle").alias("around"))
    found = state.join(tops, ["repo", "top"], "left")
    if "n_descendants" in columns:
        # a circle's nodes descend from all of their component
        sizes = found.where(F.col("around").isNotNull()).groupBy("component").agg(F.count(F.lit(1)).alias("all"))
        found = found.join(sizes, "component", "left")
    on, hung = F.col("circle").isNotNull(), F.col("around").isNotNull()
    value = {
        "repo_id": F.when(F.col("repo") != "", F.expr("substring(repo, 2)")),
        "hash": F.col("node"),
        "root_hash": F.when(hung, "").otherwise(F.col("top")),
        "depth": F.when(on, ON_CYCLE).when(hung, BELOW_CYCLE).otherwise(F.col("steps")).cast("int"),
        "circle": F.col("around"),
        "closes": on & (F.col("node") == F.col("circle")),
    }
    if "n_descendants" in columns:
        value["n_descendants"] = F.when(on, F.col("all")).otherwise(F.col("size") - 1)
    if paths:
        value["path"] = F.when(~on, F.col("path"))
    return found.select(*[value[c].alias(c) for c in ("repo_id", *columns)])


def _rounds(links: DataFrame) -> DataFrame:
    """(repo, top, node, distance): of each node on a circle those on it, itself at the circle's length. links: repo, node, top, the node above.

    The ways known so far are doubled until each node has met itself.
    """
    ways, longest = keep(links.select("repo", "top", "node", F.lit(1).alias("distance")), "rounds"), 1
    met = lambda: ways.where(F.col("top") == F.col("node")).groupBy(*_KEY).agg(F.min("distance").alias("length"))
    while ways.select(*_KEY).distinct().join(met(), _KEY, "left_anti").limit(1).count():
        far = ways.where(F.col("distance") == longest).select("repo", F.col("top").alias("at"), "node")
        up = ways.select("repo", F.col("node").alias("at"), "top", "distance")
        more = far.join(up, ["repo", "at"]).select("repo", "top", "node", (F.col("distance") + longest).alias("distance"))
        old, ways, longest = ways, keep(ways.unionByName(more), "rounds"), longest * 2
        forget(old)
    return ways.join(met(), _KEY).where(F.col("distance") <= F.col("length")).select("repo", "top", "node", "distance")


def descendants(inheritance: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(repo_id, hash, descendant_hash, distance): each class with all of its descendants and the number of steps down.

    On a circle each class descends from all of it, itself included, which is once round; what hangs on a circle descends
    from all of it too. Of several ways round the nearest counts.
    """
    tree = keep(hierarchies(inheritance, largest, ["hash", "depth", "path"]).select(_repo().alias("repo"), "hash", "depth", "path"), "descendants")
    steps = F.size("path") - 1
    down = tree.where(steps > 0).select("repo", F.posexplode("path").alias("at", "top"), F.col("hash").alias("node"), steps.alias("steps"))
    down = down.where(F.col("at") < F.col("steps")).select("repo", "top", "node", (F.col("steps") - F.col("at")).alias("distance"))
    on = tree.where(F.col("depth") == ON_CYCLE).select("repo", F.col("hash").alias("node"))
    above = latest_parents(inheritance).select(_repo().alias("repo"), F.col("child_hash").alias("node"), F.col("parent_hash").alias("top"))
    rounds = keep(_rounds(on.join(above, _KEY)), "rounds")
    hung = tree.where(F.col("depth") == BELOW_CYCLE).select("repo", F.col("path")[0].alias("at"), "hash", steps.alias("steps"))
    up = rounds.where(F.col("top") != F.col("node")).select("repo", F.col("node").alias("at"), "top", "distance")
    over = hung.join(up, ["repo", "at"]).select("repo", "top", F.col("hash").alias("node"), (F.col("steps") + F.col("distance")).alias("distance"))
    every = down.unionByName(rounds).unionByName(over)
    return every.select(F.when(F.col("repo") != "", F.expr("substring(repo, 2)")).alias("repo_id"), F.col("top").alias("hash"), F.col("node").alias("descendant_hash"), "distance")


def hierarchies(inheritance: DataFrame, largest: int = LARGEST, columns: list[str] | None = None) -> DataFrame:
    """(repo_id, hash, root_hash, depth, circle, closes, n_descendants, path): one row for each hash of each snapshot's hierarchies.

    The counting row of a child gives its parent; null, empty and ``unresolved:`` parents make it a root. Roots have
    themselves as root and depth 0; hashes on a circle have root '', depth -1 and a null path, those below one '', -2 and
    their path from the nearest hash on it; circle is the least hash of that circle, and closes tells the one hash of it
    whose link to its parent leads back to where the walk began. n_descendants doesn't count the hash itself but, on a
    circle, all of the circle. A child of null is no class; an empty child is one like any other. An empty table gives
    no rows. Rows with null repo_id form a snapshot of their own. ``columns`` chooses some, path last: paths and counts
    cost nothing where they aren't asked for.
    """
    columns = [c for c in _TYPES if c != "repo_id" and (columns is None or c in columns)]
    rows = latest_parents(inheritance).withColumn("parent_hash", F.when(is_reference("parent_hash"), F.col("parent_hash")))
    rows = keep(rows.withColumn("repo_key", F.coalesce("repo_id", F.lit(""))), "parents")
    # 64 bits name a node here: should two share them, their components are only walked together
    node = lambda c: F.xxhash64(F.col("repo_id").isNull(), "repo_key", c)
    links = rows.select(node("child_hash").alias("a"), F.coalesce(node("parent_hash"), node("child_hash")).alias("b"))
    comp = keep(components(links, "a", "b"), "components")
    rows = rows.withColumn("id", node("child_hash")).join(comp, "id").select("component", "repo_id", F.col("child_hash").alias("child"), F.col("parent_hash").alias("parent"))
    large = keep(comp.groupBy("component").count().where(F.col("count") > largest).select("component"), "large")
    any_large = large.limit(1).count() > 0
    rows_of = lambda how: rows.join(small(large), "component", how)
    shape = ", ".join(f"{c} {_TYPES[c][0]}" for c in ("repo_id", *columns))
    few = rows_of("left_anti") if any_large else rows
    walked = few.repartition("component").sortWithinPartitions("component").mapInArrow(_walk_partition(columns), shape)
    if not any_large:
        return walked
    some = keep(rows_of("left_semi"), "large-rows")
    key = some.select(_repo().alias("repo"), "child")
    tops = some.where(F.col("parent").isNotNull()).select("component", "repo_id", F.col("parent").alias("child"), _repo().alias("repo"))
    tops = tops.join(key, ["repo", "child"], "left_anti").select("component", "repo_id", "child", F.lit(None).cast("string").alias("parent")).distinct()
    return walked.unionByName(_double(some.unionByName(tops), columns))
