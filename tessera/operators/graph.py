"""Graphs over tables of edges: (src, dst), optionally type, weight, valid_from and valid_until.

Everything proceeds by rounds of joins over edges and labels, whatever the size of the graph: levels of a search, labels of
cost or arrival time that are corrected until none changes, paths that grow by an edge. A budget bounds levels, results and
the edges a search may visit, and a question beyond it is refused instead of being cut short. Only the order of moves that
makes communities is sequential: it runs by connected component, each in a task of its own, which has the vertices in memory
and their neighbours in a file.

Every result can say where it comes from (`provenance`): the graph's epoch, its snapshot, and whether and why it is cut.
"""

from __future__ import annotations

import copy
import tempfile
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.components import connected_components as _components
from tessera.session import Refused, shared_cut, ship

#: Neighbours that travel in one row, and those that a task reads at once.
EACH, BLOCK = 512, 500_000
#: Edges of a partition in rounds of joins.
EDGES_EACH = 200_000
#: Rounds that are kept apart before they are written as one.
ROUNDS = 16


@dataclass(frozen=True)
class Budget:
    results: int = 1_000
    visits: int = 100_000
    depth: int = 6
    degree: int = 10_000


GENEROUS = Budget(100_000, 1 << 60, 64, 1 << 60)


class Graph:
    def __init__(self, edges: DataFrame, source: str = "src", target: str = "dst", weight: str | None = None, edge_type: str | None = None, valid_from: str | None = None, valid_until: str | None = None, budget: Budget = Budget(), snapshot: str | None = None):  # noqa: B008
        if lost := [c for c in (source, target, weight, edge_type, valid_from, valid_until) if c and c not in edges.columns]:
            raise Refused(f"the edges have no column {', '.join(lost)}")
        null = lambda c, kind: F.col(c).cast(kind) if c else F.lit(None).cast(kind)
        self.edges = edges.select(
            F.col(source).cast("string").alias("src"), F.col(target).cast("string").alias("dst"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"),
            null(edge_type, "string").alias("type"), null(valid_from, "long").alias("valid_from"), null(valid_until, "long").alias("valid_until"),
        ).where("src is not null and dst is not null")
        self.budget, self.epoch, self.snapshot = budget, 1, snapshot

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @contextmanager
    def _dealt(self) -> Iterator[None]:
        """Rounds of joins by vertex. Adaptive plans forget how a checkpoint's rows are dealt; meanwhile there are none, so what is cut
        stays dealt by its key, and joins, unions and groups by that key move nothing: a round shuffles what it sends along edges, never
        the edges. Without adaption the number of partitions has to follow the edges."""
        conf, edges = self.spark.conf, self.edges.count()
        cores = self.spark.sparkContext.defaultParallelism
        # Joins by a vertex and more are to take rows as dealt by the vertex alone.
        ours = {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.shuffle.partitions": str(max(1, min(cores, edges // 10_000), edges // EDGES_EACH))}
        held = {k: conf.get(k) for k in ours}
        try:
            for k, v in ours.items():
                conf.set(k, v)
            yield
        finally:
            for k, v in held.items():
                conf.set(k, v)

    def vertices(self) -> DataFrame:
        return self.edges.select(F.col("src").alias("vertex")).union(self.edges.select("dst")).distinct()

    def _seeds(self, seeds: Iterable) -> DataFrame:
        given = self.spark.createDataFrame([(str(s),) for s in seeds], "vertex string").distinct()
        ends = self.edges.select(F.col("src").alias("vertex")).union(self.edges.select("dst"))
        unknown = given.join(ends.join(F.broadcast(given), "vertex", "left_semi").distinct(), "vertex", "left_anti").limit(1).collect()
        if unknown:
            raise Refused(f"seed {unknown[0][0]!r} is no vertex of the graph")
        return given

    def _typed(self, types: list[str] | None) -> DataFrame:
        if not types:
            return self.edges
        known = {r[0] for r in self.edges.select("type").distinct().collect()}
        if unknown := [t for t in types if t not in known]:
            raise Refused(f"no edge has type {', '.join(unknown)}")
        return self.edges.where(F.col("type").isin(types))

    def reachable(self, seeds: Iterable, max_depth: int | None = None, types: list[str] | None = None, direction: str = "out", at: int | None = None) -> DataFrame:
        """(vertex, depth, via, truncated): breadth first; `via` is the least vertex one level nearer. A vertex of more than the
        budget's degree is returned and not expanded; `truncated` says whether that or the depth left anything unseen."""
        with self._dealt():
            found, by_degree, by_depth = self._reach(seeds, max_depth, types, direction, at)
        return self.provenance(found, by_degree or by_depth, "degree" if by_degree else "depth" if by_depth else None)

    def _reach(self, seeds: Iterable, max_depth: int | None = None, types: list[str] | None = None, direction: str = "out", at: int | None = None) -> tuple[DataFrame, bool, bool]:
        """What is reached, whether a vertex nearer than the depth was too wide to expand, whether the depth left anything unseen."""
        edges, b = self._typed(types), self.budget
        if at is not None:
            edges = edges.where(f"coalesce(valid_from, {at}) <= {at} and coalesce(valid_until, {at} + 1) > {at}")
        if direction != "out":
            turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            edges = turned if direction == "in" else edges.select("src", "dst").union(turned)
        edges = shared_cut(_by(edges.select("src", "dst"), "src").distinct().sortWithinPartitions("src"))
        wide = edges.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > b.degree).select(F.col("src").alias("vertex"))
        any_wide = not wide.isEmpty()
        found = shared_cut(self._seeds(seeds).select("vertex", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via")))
        front, by_degree, by_depth, depth = found, False, False, 0
        limit = b.depth if max_depth is None else max_depth
        while True:
            near = front.select("vertex").join(wide, "vertex", "left_anti") if any_wide else front.select("vertex")
            if any_wide and not front.join(wide, "vertex", "left_semi").isEmpty():
                by_degree, by_depth = by_degree or depth < limit, by_depth or depth >= limit
            reached = edges.join(near.withColumnRenamed("vertex", "src"), "src").groupBy(F.col("dst").alias("vertex")).agg(F.min("src").alias("via"))
            fresh = shared_cut(reached.join(found.select("vertex"), "vertex", "left_anti").select("vertex", F.lit(depth + 1).alias("depth"), "via"))
            if fresh.isEmpty():
                break
            if depth >= limit:
                by_depth = True
                break
            depth += 1
            found = found.unionByName(fresh)  # levels that are cut themselves and dealt by vertex, at most the depth's number of them
            front = fresh
        return found, by_degree, by_depth

    def influence(self, seeds: Iterable, damping: float = 1.0, floor: float = 1e-4) -> DataFrame:
        """(vertex, influence): the sum over walks of the products of damped weights, a walk ending where its product is under
        the floor. Walks are summed by their current (vertex, product), which changes nothing and keeps equal ones together."""
        if self.edges.where("weight < 0").limit(1).count():
            raise Refused("a weight is negative")
        steps = shared_cut(self.edges.groupBy("src", "dst", "weight").agg(F.count("*").alias("k")))
        walks = shared_cut(self._seeds(seeds).select("vertex", F.lit(1.0).alias("p"), F.lit(1.0).alias("m")))
        total = None
        for _ in range(self.budget.depth):
            walks = walks.join(steps.withColumnRenamed("src", "vertex"), "vertex").select(F.col("dst").alias("vertex"), (F.col("p") * F.col("weight") * damping).alias("p"), (F.col("m") * F.col("k")).alias("m"))
            walks = shared_cut(walks.where(F.col("p") >= floor).groupBy("vertex", "p").agg(F.sum("m").alias("m")))
            if walks.isEmpty():
                break
            here = walks.groupBy("vertex").agg(F.sum(F.col("p") * F.col("m")).alias("influence"))
            total = here if total is None else total.unionByName(here)
        if total is None:
            return self.spark.createDataFrame([], "vertex string, influence double")
        return total.groupBy("vertex").agg(F.sum("influence").alias("influence"))

    def degree(self, direction: str = "both") -> DataFrame:
        ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
        counts = None
        for e in ends:
            c = self.edges.groupBy(F.col(e).alias("vertex")).agg(F.count("*").alias("n"))
            counts = c if counts is None else counts.unionByName(c)
        return self.vertices().join(counts.groupBy("vertex").agg(F.sum("n").alias("n")), "vertex", "left").select("vertex", F.coalesce("n", F.lit(0)).alias("degree"))

    def rank(self, iterations: int = 20, damping: float = 0.85) -> DataFrame:
        """PageRank; parallel edges count, and what vertices without edges out hold is shared by all."""
        out = self.edges.groupBy("src").agg(F.count("*").alias("out"))
        steps = shared_cut(self.edges.groupBy("src", "dst").agg(F.count("*").alias("k")).join(out, "src").select("src", "dst", (F.col("k") / F.col("out")).alias("share")))
        vertices = shared_cut(self.vertices().join(out.withColumnRenamed("src", "vertex"), "vertex", "left").select("vertex", F.col("out").isNull().alias("dangling")))
        n = vertices.count()
        ranks = vertices.withColumn("rank", F.lit(1.0 / n))
        for i in range(iterations):
            lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))).first()[0]
            given = steps.join(ranks.select(F.col("vertex").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("vertex")).agg(F.sum(F.col("rank") * F.col("share")).alias("g"))
            ranks = vertices.join(given, "vertex", "left").select("vertex", "dangling", (F.lit((1 - damping) / n) + damping * (F.coalesce("g", F.lit(0.0)) + lost / n)).alias("rank"))
            ranks = shared_cut(ranks) if i % 4 == 3 or i == iterations - 1 else ranks
        return ranks.select("vertex", "rank")

    def connected_components(self) -> DataFrame:
        """Weakly connected: (vertex, component)."""
        return _components(self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), shared_cut).withColumnRenamed("node", "vertex")

    def strong_components(self) -> DataFrame:
        """(vertex, component) by forward and backward colouring: in each round the least vertex that reaches a vertex colours
        it, and the vertices that reach back to their colour's own vertex are that vertex's component."""
        with self._dealt():
            rest = shared_cut(_by(self.edges.where("src <> dst").select("src", "dst"), "src").distinct().sortWithinPartitions("src"))
            left = shared_cut(_by(self.vertices(), "vertex").sortWithinPartitions("vertex"))
            done = None
            while not left.isEmpty():
                colour = self._spread(left, rest)
                ends = rest.join(colour.select(F.col("vertex").alias("src"), F.col("c").alias("cs")), "src")
                ends = ends.join(colour.select(F.col("vertex").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
                same = shared_cut(ends.select("dst", "src", F.col("cs").alias("c")).sortWithinPartitions("dst"))  # dealt by dst: the way back
                front = back = shared_cut(colour.where("vertex = c"))
                rounds = 0
                while not front.isEmpty():
                    met = same.join(front.select(F.col("vertex").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("vertex"), "c")
                    front = shared_cut(_by(met, "vertex").distinct().join(back, ["vertex", "c"], "left_anti"))
                    back, rounds = back.unionByName(front), rounds + 1  # rounds that are cut themselves, all dealt by vertex
                    if rounds % ROUNDS == 0:
                        back = shared_cut(back)
                done = back if done is None else done.unionByName(back)
                left = shared_cut(left.join(back, "vertex", "left_anti"))
                rest = rest.join(left.withColumnRenamed("vertex", "src"), "src", "left_semi").join(left.withColumnRenamed("vertex", "dst"), "dst", "left_semi")
                rest = shared_cut(_by(rest, "src").sortWithinPartitions("src"))
            return shared_cut(done.select("vertex", F.col("c").alias("component")))

    @staticmethod
    def _spread(vertices: DataFrame, edges: DataFrame) -> DataFrame:
        """(vertex, c): the least vertex that reaches each; only colours that have changed are sent on."""
        colour = shared_cut(vertices.select("vertex", F.concat("vertex", F.lit("")).alias("c"), F.lit(True).alias("new")))
        while not (front := colour.where("new")).isEmpty():
            got = edges.join(front.select(F.col("vertex").alias("src"), "c"), "src").groupBy(F.col("dst").alias("vertex")).agg(F.min("c").alias("g"))
            colour = shared_cut(colour.join(got, "vertex", "left").select("vertex", F.least("c", "g").alias("c"), F.coalesce(F.col("g") < F.col("c"), F.lit(False)).alias("new")))
        return colour.select("vertex", "c")

    # labels that are corrected until none changes
    def _within(self, seeds: Iterable, whole: bool) -> DataFrame:
        """Edges within the budget's depth of the seeds; refused beyond the budget's visits, past a vertex of more than its
        degree and, if what is reached must be `whole`, beyond its depth."""
        found, by_degree, by_depth = self._reach(list(seeds))
        if by_degree:
            raise Refused(f"a vertex within depth {self.budget.depth} has more than {self.budget.degree} neighbours; give a larger budget")
        if whole and by_depth:
            raise Refused(f"the graph goes on beyond depth {self.budget.depth}; give a larger budget")
        part = shared_cut(_by(self.edges, "src").join(found.select(F.col("vertex").alias("src")), "src", "left_semi"))
        if part.count() > self.budget.visits:
            raise Refused(f"more than {self.budget.visits} edges lie within depth {self.budget.depth}; give a larger budget")
        return part

    def shortest_path(self, source, target, k: int = 1) -> DataFrame:
        """The k cheapest loopless paths, one row a step: path_id, position, vertex, path_cost, path_hops. Of paths of one cost
        the one whose vertices, from the end, come first. Yen's scheme over searches that each run as rounds of joins."""
        source, target = str(source), str(target)
        with self._dealt():
            edges = self._within([source], whole=True)
            if edges.where("weight < 0").limit(1).count():
                raise Refused("a weight is negative")
            self._seeds([target])
            edges = shared_cut(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")).sortWithinPartitions("src"))
            paths = _cheapest(lambda banned, cut, start: self._search(edges, start, target, banned, cut), source, k)
        rows = [(i, p, v, cost, len(path) - 1) for i, (cost, path) in enumerate(paths) for p, v in enumerate(path)]
        return self.spark.createDataFrame(rows, "path_id int, position int, vertex string, path_cost double, path_hops int")

    def _search(self, edges: DataFrame, source: str, target: str, banned: frozenset[str], cut: frozenset[tuple[str, str]]) -> list[tuple[str, float]] | None:
        """The cheapest path's vertices, each with the cost up to it. `banned` and `cut` are parts of paths already found. Only
        labels that have changed are carried on, and none that costs more than the target does already."""
        if banned:
            edges = edges.where(~F.col("dst").isin(list(banned)) & ~F.col("src").isin(list(banned)))
        for s, d in cut:
            edges = edges.where((F.col("src") != s) | (F.col("dst") != d))
        labels = shared_cut(self.spark.createDataFrame([(source, 0.0, None)], "vertex string, cost double, via string").repartition("vertex"))
        front, end = labels, None
        while True:
            reached = edges.join(front.select(F.col("vertex").alias("src"), "cost"), "src").select(F.col("dst").alias("vertex"), (F.col("cost") + F.col("weight")).alias("cost"), F.col("src").alias("via"))
            if end is not None:
                reached = reached.where(F.col("cost") <= end["cost"])
            got = reached.groupBy("vertex").agg(F.min(F.struct("cost", "via")).alias("l")).select("vertex", "l.cost", "l.via", F.lit(True).alias("new"))
            both = got.unionByName(labels.withColumn("new", F.lit(False)))  # both dealt by vertex
            best = both.groupBy("vertex").agg(F.min(F.struct("cost", F.coalesce("via", F.lit("")).alias("via"), "new")).alias("l"))
            best = shared_cut(best.select("vertex", "l.cost", F.nullif("l.via", F.lit("")).alias("via"), "l.new"))
            labels, end = best.drop("new"), best.where(F.col("vertex") == target).select("cost").first()
            front = best.where("new")
            if end is not None:
                front = front.where(F.col("cost") < end["cost"])
            if front.isEmpty():
                break
        path, at = [], target
        while at is not None:  # a look-up for each step of one path
            row = labels.where(F.col("vertex") == at).first()
            if row is None:
                return None
            path.append((at, row["cost"]))
            at = row["via"] if at != source else None
        return path[::-1]

    def cycles(self, seeds: Iterable) -> DataFrame:
        """Simple circuits, of up to the budget's depth in steps, through a seed that is their least vertex: (cycle_id, position,
        vertex), closed. Paths grow by an edge a round and keep to vertices greater than their seed."""
        with self._dealt():
            edges = shared_cut(self._within(seeds, whole=False).select("src", "dst").distinct())
        paths = self._seeds(seeds).select(F.array("vertex").alias("path"), F.col("vertex").alias("end"))
        found, walked = None, 0
        for _ in range(self.budget.depth):
            grown = shared_cut(paths.join(edges.withColumnRenamed("src", "end"), "end").where((F.col("dst") == F.get("path", 0)) | (F.col("dst") > F.get("path", 0)) & ~F.array_contains("path", F.col("dst"))))
            closed = grown.where(F.col("dst") == F.get("path", 0)).select(F.array_append("path", F.col("dst")).alias("path"))
            found = closed if found is None else found.unionByName(closed)
            paths = grown.where(F.col("dst") != F.get("path", 0)).select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("end"))
            walked += grown.count()
            if walked > self.budget.visits or found.count() > self.budget.results:
                raise Refused("the circuits exceed the budget")
        found = found.orderBy("path").limit(self.budget.results)  # within the budget: all of them
        numbered = found.withColumn("cycle_id", F.row_number().over(Window.orderBy("path")) - 1)
        return numbered.select("cycle_id", F.posexplode("path").alias("position", "vertex"))

    def time_respecting(self, seeds: Iterable, at: int = 0, min_dwell: int = 0, max_dwell: int | None = None, min_conservation: float = 0.0) -> DataFrame:
        """(vertex, arrival, hops, via): earliest arrivals over edges whose validity starts no earlier than one stands there;
        refused if the budget's depth in hops leaves out an arrival or an earlier one.

        Each vertex has one label, the least of (arrival, hops, via, weight). All labels are made anew from their predecessors'
        in each round; a label depends only on lesser ones, so they settle from the seeds on."""
        with self._dealt():
            return self._arrivals(list(seeds), at, min_dwell, max_dwell, min_conservation)

    def _arrivals(self, seeds: list, at: int, min_dwell: int, max_dwell: int | None, min_conservation: float) -> DataFrame:
        edges = shared_cut(self._within(seeds, whole=False).where("valid_from is not null and (valid_until is null or valid_until > valid_from)").select("src", "dst", "weight", "valid_from").sortWithinPartitions("src"))
        label = "arrival long, hops int, via string, w double"
        first = shared_cut(self._seeds(seeds).select("vertex", F.struct(F.lit(at).cast("long").alias("arrival"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("double").alias("w")).alias("l")).repartition("vertex"))
        labels = first

        def steps(labels: DataFrame) -> DataFrame:
            met = edges.join(labels.withColumnRenamed("vertex", "src"), "src")
            wait = F.col("valid_from") - F.col("l.arrival")
            fits = (wait >= min_dwell) & (F.col("l.w").isNull() | (F.col("weight") >= F.col("l.w") * min_conservation))
            fits = fits if max_dwell is None else fits & ((F.col("l.hops") == 0) | (wait <= max_dwell))
            new = F.struct(F.col("valid_from").alias("arrival"), (F.col("l.hops") + 1).alias("hops"), F.col("src").alias("via"), F.col("weight").alias("w")).cast(f"struct<{label.replace(' ', ':')}>".replace(",:", ","))
            return met.where(fits).select(F.col("dst").alias("vertex"), new.alias("l"))

        while True:
            reached = steps(labels.where(F.col("l.hops") < self.budget.depth)).groupBy("vertex").agg(F.min("l").alias("l"))
            after = shared_cut(reached.unionByName(first).groupBy("vertex").agg(F.min("l").alias("l")))  # both dealt by vertex
            same = after.join(labels.select("vertex", F.col("l").alias("o")), "vertex", "left").where(~F.col("l").eqNullSafe(F.col("o"))).isEmpty() and after.count() == labels.count()
            labels = after
            if same:
                break
        beyond = steps(labels.where(F.col("l.hops") >= self.budget.depth)).groupBy("vertex").agg(F.min("l.arrival").alias("a"))
        if not beyond.join(labels, "vertex", "left").where(F.col("l").isNull() | (F.col("a") < F.col("l.arrival"))).isEmpty():
            raise Refused(f"arrivals go on beyond {self.budget.depth} hops; give a larger budget")
        return labels.select("vertex", "l.arrival", "l.hops", "l.via")

    def betweenness(self, samples: int = 64) -> DataFrame:
        """Brandes' estimate from the `samples` first vertices by hash, scaled to all. All sources search at once, a level a
        round; what depends on a vertex is then gathered from the last level back to the first."""
        vertices = shared_cut(self.vertices())
        sources = vertices.orderBy(F.xxhash64("vertex"), "vertex").limit(samples)
        scale = vertices.count() / max(1, min(samples, vertices.count()))
        edges = shared_cut(self.edges.select("src", "dst").distinct())
        front = shared_cut(sources.select(F.col("vertex").alias("source"), "vertex", F.lit(1.0).alias("paths")))
        seen, levels = front.select("source", "vertex"), []
        while not front.isEmpty():
            levels.append(front)
            after = edges.join(front.withColumnRenamed("vertex", "src"), "src").groupBy("source", F.col("dst").alias("vertex")).agg(F.sum("paths").alias("paths"))
            front = shared_cut(after.join(seen, ["source", "vertex"], "left_anti"))
            seen = shared_cut(seen.unionByName(front.select("source", "vertex")))
        total, gained = None, None
        for level in levels[::-1]:
            if gained is None:
                gained = level.withColumn("gain", F.lit(0.0))
            else:
                back = edges.join(gained.select("source", F.col("vertex").alias("dst"), ((1 + F.col("gain")) / F.col("paths")).alias("each")), "dst").groupBy("source", F.col("src").alias("vertex")).agg(F.sum("each").alias("each"))
                gained = level.join(back, ["source", "vertex"], "left").select("source", "vertex", "paths", (F.col("paths") * F.coalesce("each", F.lit(0.0))).alias("gain"))
            gained = shared_cut(gained)
            total = gained if total is None else total.unionByName(gained)
        return total.where("source <> vertex").groupBy("vertex").agg((F.sum("gain") * scale).alias("betweenness")) if total is not None else self.spark.createDataFrame([], "vertex string, betweenness double")

    def communities(self, passes: int = 10, most: int = (1 << 31) - 1) -> DataFrame:
        """Local moves of vertices, in order, to the neighbouring community that raises modularity most: (vertex, community). A
        move looks at its own connected component and the sum of all weights only, so components are moved side by side, each
        in one task; a component of more than `most` edges is refused. Neighbours are gathered by vertex on all tasks; the one that
        moves a component has some 40 bytes a vertex in memory, and reads the neighbours from a file of its own in each pass."""
        edges = shared_cut(self.edges.where("src <> dst").select("src", "dst", F.coalesce("weight", F.lit(float("nan"))).alias("weight")))
        parts = _components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), shared_cut)
        if not edges.join(parts.withColumnRenamed("node", "src"), "src").groupBy("component").count().where(F.col("count") > most).isEmpty():
            raise Refused("a connected component is too large for local moves")
        two_m = 2 * (edges.agg(F.sum("weight")).first()[0] or 0.5)
        ship(self.spark)

        # Numbers that rise with the names; a component has that of its least vertex, which names it.
        names = shared_cut(parts.repartitionByRange("node").sortWithinPartitions("node").select("node", "component", F.monotonically_increasing_id().alias("id")))
        first = names.where("node = component").select("component", F.col("id").alias("c"))
        of = names.join(first, "component").select("node", "id", "c")
        numbered = edges.join(of.select(F.col("node").alias("src"), F.col("id").alias("s"), "c"), "src").join(names.select(F.col("node").alias("dst"), F.col("id").alias("d")), "dst")
        ends = lambda v, u: numbered.select("c", F.col(v).alias("v"), F.col(u).alias("u"), "s", "d", "weight")
        met = ends("s", "d").unionByName(ends("d", "s")).repartition("v").sortWithinPartitions("v", "s", "d", "weight")
        near = shared_cut(met.select("c", "v", "u", "weight").mapInArrow(_neighbours, "c long, v long, k int, ids binary, weights binary"))
        dealt = near.repartition("c").sortWithinPartitions("c", "v", "k")
        moved = dealt.mapInArrow(lambda batches: _moved(batches, two_m, passes), "id long, to long")
        named = moved.join(names.select("id", F.col("node").alias("vertex")), "id")
        return named.join(names.select(F.col("id").alias("to"), F.col("node").alias("community")), "to").select("vertex", "community")

    def influence_between(self, source, target, damping: float = 1.0, floor: float = 1e-4) -> float:
        """What of the source's influence arrives at the target."""
        self._seeds([target])
        row = self.influence([source], damping, floor).where(F.col("vertex") == str(target)).first()
        return row["influence"] if row else 0.0

    def provenance(self, df: DataFrame, truncated: bool = False, reason: str | None = None) -> DataFrame:
        """A result with the graph's epoch and snapshot, and whether and why it leaves something out, in every row."""
        return df.withColumns({"epoch": F.lit(self.epoch), "snapshot": F.lit(self.snapshot).cast("string"), "truncated": F.lit(truncated), "truncation_reason": F.lit(reason).cast("string")})

    def with_edges(self, more: DataFrame) -> Graph:
        """The graph of the next epoch, with edges added (columns as in `edges`)."""
        out = copy.copy(self)
        out.edges, out.epoch = self.edges.unionByName(more.select(*self.edges.columns)), self.epoch + 1
        return out

    def modularity(self, communities: DataFrame) -> float:
        c = communities.select("vertex", "community")
        e = self.edges.where("src <> dst")
        m = e.agg(F.sum("weight")).first()[0] or 1.0
        inside = e.join(c.select(F.col("vertex").alias("src"), F.col("community").alias("a")), "src").join(c.select(F.col("vertex").alias("dst"), F.col("community").alias("b")), "dst").where("a = b").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
        ends = e.select(F.col("src").alias("vertex"), "weight").union(e.select("dst", "weight")).join(c, "vertex").groupBy("community").agg(F.sum("weight").alias("d"))
        return inside / m - ends.agg(F.sum(F.pow(F.col("d") / (2 * m), 2))).first()[0]


def _by(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt by `key`, which gets a name of its own in the plan: under one that is only passed on a checkpoint is not known to be
    dealt."""
    return df.withColumn(key, F.concat(key, F.lit(""))).repartition(key)


def _cheapest(search, source: str, k: int) -> list[tuple[float, list[str]]]:
    """Yen's scheme: each next path leaves one that is found at some vertex, by an edge that none of the found ones with the
    same beginning has taken. `search(banned, cut, start)` gives a path's vertices with the cost up to each."""
    first = search(frozenset(), frozenset(), source)
    found: list[tuple[float, list[str], list[float]]] = []
    waiting = [(first[-1][1], [v for v, _ in first], [c for _, c in first])] if first else []
    while waiting and len(found) < k:
        waiting.sort()
        _, path, costs = waiting.pop(0)
        found.append((costs[-1], path, costs))
        if len(found) == k:
            break
        for i in range(len(path) - 1):
            root = path[: i + 1]
            cut = frozenset((p[i], p[i + 1]) for _, p, _ in found if p[: i + 1] == root and len(p) > i + 1)
            if spur := search(frozenset(root[:-1]), cut, path[i]):
                new = (costs[i] + spur[-1][1], root + [v for v, _ in spur[1:]], costs[: i + 1] + [costs[i] + c for _, c in spur[1:]])
                if all(new[1] != p for _, p, _ in (*waiting, *found)):
                    waiting.append(new)
    return [(cost, path) for cost, path, _ in found]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (c, v, u, weight) in the order of v: each vertex's neighbours and the sums of their weights, in the order in which they
    are first met, in rows of at most `EACH`."""
    kinds = pa.schema([("c", pa.int64()), ("v", pa.int64()), ("k", pa.int32()), ("ids", pa.binary()), ("weights", pa.binary())])
    rows: list[tuple] = []
    held: dict[int, float] = {}
    last = None

    def gather() -> None:
        ids, weights = np.fromiter(held, "<i8", len(held)), np.fromiter(held.values(), "<f8", len(held))
        for k in range(0, len(held), EACH):
            rows.append((*last, k // EACH, ids[k : k + EACH].tobytes(), weights[k : k + EACH].tobytes()))

    for batch in batches:
        for c, v, u, w in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if last is None or v != last[1]:
                if last is not None:
                    gather()
                held, last = {}, (c, v)
            held[u] = held.get(u, 0.0) + w
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
            rows = []
    if last is not None:
        gather()
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def _moved(batches: Iterator[pa.RecordBatch], two_m: float, passes: int) -> Iterator[pa.RecordBatch]:
    """Of the rows of `_neighbours`, in the order of (c, v, k): each vertex's number and its community's least one."""
    component, held = None, None
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            for c, v, ids, weights in zip(*(batch.column(k).slice(start, 512).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if c != component:
                    if held is not None:
                        yield from held.moved(two_m, passes)
                    component, held = c, _Component()
                held.add(v, ids, weights)
    if held is not None:
        yield from held.moved(two_m, passes)


class _Component:
    """One component's vertices in the order of their numbers, and their neighbours in files (of small ones: in memory)."""

    def __init__(self):
        self.names, self.degrees, self.ends = array("q"), array("q"), array("d")
        self.ids, self.weights = (tempfile.SpooledTemporaryFile(1 << 20) for _ in range(2))
        self.last: list[float] = []

    def add(self, v: int, ids: bytes, weights: bytes) -> None:
        if not self.names or v != self.names[-1]:
            self._end()
            self.names.append(v)
        self.last += np.frombuffer(weights, "<f8").tolist()
        self.ids.write(ids)
        self.weights.write(weights)

    def _end(self) -> None:
        if self.names:
            self.degrees.append(len(self.last))
            self.ends.append(sum(self.last))
            self.last = []

    def _places(self) -> None:
        """Neighbours by their place among the component's vertices."""
        names, placed = np.frombuffer(self.names, np.int64), tempfile.SpooledTemporaryFile(1 << 20)
        self.ids.seek(0)
        while piece := self.ids.read(BLOCK * 8):
            placed.write(np.searchsorted(names, np.frombuffer(piece, "<i8")).astype("<i4").tobytes())
        self.ids.close()
        self.ids = placed

    def _blocks(self) -> Iterator[tuple[int, int, list[int], list[float]]]:
        """Runs of vertices, and the neighbours of all of a run."""
        self.ids.seek(0)
        self.weights.seek(0)
        first, size = 0, 0
        for v, n in enumerate(self.degrees):
            size += n
            if size >= BLOCK or v == len(self.degrees) - 1:
                yield first, v + 1, np.frombuffer(self.ids.read(size * 4), "<i4").tolist(), np.frombuffer(self.weights.read(size * 8), "<f8").tolist()
                first, size = v + 1, 0

    def moved(self, two_m: float, passes: int) -> Iterator[pa.RecordBatch]:
        self._end()
        self._places()
        n, degrees, ends = len(self.names), self.degrees, self.ends
        of, total = array("i", range(n)), array("d", ends)
        for _ in range(passes):
            moved = False
            for first, last, ids, weights in self._blocks():
                at = 0
                for v in range(first, last):
                    here, end, links = of[v], ends[v], {}
                    total[here] -= end
                    for i in range(at, at := at + degrees[v]):
                        c = of[ids[i]]
                        links[c] = links.get(c, 0.0) + weights[i]
                    best, most = here, links.get(here, 0.0) - total[here] * end / two_m
                    for c, w in links.items():  # of equal ones: where it is, then the least
                        gain = w - total[c] * end / two_m
                        if gain > most or (gain == most and best != here and c < best):
                            best, most = c, gain
                    of[v] = best
                    moved |= best != here
                    total[best] += end
            if not moved:
                break
        self.ids.close()
        self.weights.close()
        names, at = np.frombuffer(self.names, np.int64), np.frombuffer(of, np.int32)
        least = np.full(n, n, np.int32)
        np.minimum.at(least, at, np.arange(n, dtype=np.int32))
        for k in range(0, n, 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(names[k : k + (1 << 16)]), pa.array(names[least[at[k : k + (1 << 16)]]])], names=["id", "to"])
