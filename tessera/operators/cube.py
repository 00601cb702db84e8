"""Cubes: facts summed along declared dimensions, each measure with a rule for each dimension.

Nothing has a default rule, and what cannot be answered under the rules is refused before a plan is built. Navigation gives
lazy DataFrames: a roll-up under one rule is a single aggregation with partial sums, and only mixed rules take a stage each.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import Refused, shared_cut

RULES = ("sum", "min", "max", "first", "last", "mean", "none")
SUPPLIED = "aggregation "  # and the name of a supplied aggregation
COMPOSING = ("sum", "min", "max", "first", "last")


@dataclass(frozen=True)
class Dimension:
    """A key column of the facts; `parents` names (child, parent) columns of a hierarchy table; `levels` lists columns of it."""

    name: str
    levels: tuple[str, ...] = ()


@dataclass(frozen=True)
class Measure:
    name: str
    column: str
    rules: dict[str, str] = field(default_factory=dict)

    def __hash__(self) -> int:
        return hash((self.name, self.column, tuple(sorted(self.rules.items()))))


@dataclass(frozen=True)
class Definition:
    name: str
    dimensions: tuple[Dimension, ...]
    measures: tuple[Measure, ...]

    @property
    def names(self) -> list[str]:
        return [d.name for d in self.dimensions]

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]

    def rejections(self, fact_columns: list[str] | None = None) -> list[str]:
        """All that is wrong with it, not only the first."""
        out, names = [], self.names
        for what, given in (("dimension", names), ("measure", [m.name for m in self.measures])):
            out += [f"no {what} is declared"] * (not given)
            out += [f"{what} {n!r} is blank" for n in given if not n.strip()]
            out += [f"{what} {n!r} is declared twice" for n in sorted({n for n in given if given.count(n) > 1})]
        for m in self.measures:
            out += [f"measure {m.name!r} has no rule along {d!r}" for d in names if d not in m.rules]
            out += [f"measure {m.name!r} has a rule along {d!r}, which is no dimension" for d in m.rules if d not in names]
            out += [f"measure {m.name!r}: rule {r!r} is unknown" for r in m.rules.values() if r not in RULES and not r.startswith(SUPPLIED.strip())]
            out += [f"measure {m.name!r}: an aggregation has no name" for r in m.rules.values() if r.startswith(SUPPLIED.strip()) and not r[len(SUPPLIED) :].strip()]
        if fact_columns is not None:
            out += [f"the facts have no column {c!r}" for c in [*names, *(m.column for m in self.measures)] if c not in fact_columns]
        return out


class Cube:
    """A definition over a table of facts. Rows with a null key or measure are withheld and counted.

    With a `source` (which gives the facts' version and the facts) `refresh` follows the table: at once, or, if the cube is
    maintained `within` some versions, only when it has fallen further behind; then its kept cuboids are made anew, and until
    then all answers are of the older version, as their `snapshot` says. The grains in `pinned` are kept from the start."""

    def __init__(self, definition: Definition, facts: DataFrame, hierarchies: dict[str, DataFrame] | None = None, snapshot: str = "live", aggregations: dict | None = None, source: Callable[[], tuple[int, DataFrame]] | None = None, within: int | None = None, pinned: Iterable[Iterable[str]] = ()):
        wrong = definition.rejections(facts.columns)
        self.aggregations = aggregations or {}
        named = {r[len(SUPPLIED) :].strip() for m in definition.measures for r in m.rules.values() if r.startswith(SUPPLIED)}
        wrong += [f"no aggregation {n!r}" for n in sorted(named - set(self.aggregations)) if n]
        wrong += [f"pinned: {d!r} is no dimension" for g in pinned for d in g if d not in definition.names]
        if wrong:
            raise Refused("; ".join(wrong))
        self.d, self.facts, self.snapshot = definition, facts, snapshot
        self.source, self.within, self.pinned = source, within, [list(g) for g in pinned]
        self.version = source()[0] if source else None
        self.parents = hierarchies or {}  # dimension -> (child, parent)
        self.overlays: dict[str, tuple[DataFrame, str]] = {}
        self.cuboids: dict[tuple[str, frozenset[str]], DataFrame] = {}
        self.log: deque = deque(maxlen=256)
        for name, edges in self.parents.items():
            self._acyclic(name, edges)
        self._keep_pinned()

    def refresh(self) -> int:
        """Follow the source; how many versions the cube is behind it now."""
        if self.source is None:
            return 0
        version, facts = self.source()
        behind = version - self.version
        if behind == 0 or self.within is not None and 0 < behind <= self.within:
            return behind
        kept = list(self.cuboids)
        self.version, self.facts, self.snapshot = version, facts, str(version)
        self.cuboids.clear()
        for measure, grain in kept if self.within is not None else []:
            self.materialise(measure, [sorted(grain)])
        self._keep_pinned()
        return 0

    def _keep_pinned(self) -> None:
        for m in self.d.measures:
            for g in self.pinned:
                if (m.name, frozenset(g)) not in self.cuboids and all(m.rules[d] in ("sum", "min", "max") for d in self.d.names if d not in g):
                    self.materialise(m.name, [g])

    def measure(self, name: str) -> Measure:
        for m in self.d.measures:
            if m.name == name:
                return m
        raise Refused(f"cube {self.d.name!r} has no measure {name!r}")

    def _dims(self, names) -> list[str]:
        if unknown := [n for n in names if n not in self.d.names]:
            raise Refused(f"no dimension {', '.join(map(repr, unknown))} in cube {self.d.name!r}")
        return list(names)

    def completeness(self, measure: str) -> tuple[int, int]:
        """Contributed and withheld rows."""
        m = self.measure(measure)
        r = self.facts.agg(F.count("*").alias("n"), F.count_if(self._whole(m)).alias("k")).first()
        return r["k"], r["n"] - r["k"]

    def _whole(self, m: Measure):
        ok = F.col(m.column).isNotNull()
        for d in self.d.names:
            ok = ok & F.col(d).isNotNull()
        return ok

    def cells(self, measure: str) -> DataFrame:
        """The base grain: one value for each combination of members that has facts, with their number."""
        m = self.measure(measure)
        rules = set(m.rules.values())
        if supplied := next((r for r in rules if r.startswith(SUPPLIED)), None):
            return self._supplied(m, supplied, self.d.names, None)
        fold = F.avg if "mean" in rules else F.min if rules == {"min"} else F.max if rules == {"max"} else F.sum
        keys = [F.col(d).cast("string").alias(d) for d in self.d.names]
        return self.facts.where(self._whole(m)).groupBy(*keys).agg(fold(F.col(m.column).cast("double")).alias("value"))

    def _supplied(self, m: Measure, rule: str, by: list[str], where: dict[str, list[str]] | None) -> DataFrame:
        """A supplied aggregation over the facts themselves: its states merge, its finished values do not."""
        if set(m.rules.values()) != {rule}:
            raise Refused(f"measure {m.name!r}: an aggregation does not mix with other rules")
        facts = self.facts.where(self._whole(m)).select(*(F.col(d).cast("string").alias(d) for d in self.d.names), F.col(m.column).cast("double").alias("_measure"))
        made = self.aggregations[rule[len(SUPPLIED) :].strip()](self._dice(facts, where), by, "_measure")
        return made.select(*by, F.col(made.columns[-1]).alias("value"))

    def _dice(self, cells: DataFrame, where: dict[str, list[str]] | None) -> DataFrame:
        for d in self._dims(where or {}):
            cells = cells.where(F.col(d).isin([str(x) for x in where[d]]))
        return cells

    def rollup(self, measure: str, by: list[str], where: dict[str, list[str]] | None = None, order: dict[str, list[str]] | None = None, min_completeness: float | None = None, overlay: str | None = None, materialised: bool = True) -> DataFrame:
        """The measure at the kept dimensions `by`, the others rolled away under their rules, in the definition's order."""
        m, by = self.measure(measure), self._dims(by)
        away = [d for d in self.d.names if d not in by]
        for d in away:
            rule = m.rules[d]
            if rule in ("mean", "none"):
                raise Refused(f"measure {m.name!r} may not be rolled up along {d!r}: its rule there is {rule}")
            if rule in ("first", "last") and d not in (order or {}):
                raise Refused(f"rule {rule} along {d!r} needs an order of its members")
        self.log.append((m.name, frozenset(by)))
        if supplied := next((r for r in m.rules.values() if r.startswith(SUPPLIED)), None):
            if overlay:
                raise Refused("an overlay does not change what an aggregation is made of")
            return self._with_provenance(self._supplied(m, supplied, by, where), m, by, min_completeness, None)
        source, grain = None, self.d.names
        if materialised and not where and not overlay and not any(m.rules[d] in ("first", "last") for d in away):
            usable = [c for (n, c) in self.cuboids if n == m.name and c >= set(by) and all(m.rules[d] in COMPOSING for d in away)]
            if usable:
                best = min(usable, key=len)
                source, grain = self.cuboids[m.name, best], [d for d in self.d.names if d in best]
        cells = source if source is not None else self._overlaid(self._dice(self.cells(m.name), where), overlay)
        out = self._fold(cells, m, [d for d in away if d in grain], grain, order or {})
        return self._with_provenance(out.select(*by, "value"), m, by, min_completeness, overlay, source is not None, "|".join(grain) if source is not None else None)

    def _fold(self, cells: DataFrame, m: Measure, away: list[str], grain: list[str], order: dict[str, list[str]]) -> DataFrame:
        plain = {"sum": F.sum, "min": F.min, "max": F.max}
        rules = [m.rules[d] for d in away]
        if not away:
            return cells
        if len(set(rules)) == 1 and rules[0] in plain:
            return cells.groupBy(*[d for d in grain if d not in away]).agg(plain[rules[0]]("value").alias("value"))
        kept = list(grain)
        for d in away:
            kept.remove(d)
            rule = m.rules[d]
            if rule in plain:
                cells = cells.groupBy(*kept).agg(plain[rule]("value").alias("value"))
                continue
            place = F.array_position(F.array(*(F.lit(x) for x in order[d])), F.col(d))
            place = F.when(place == 0, F.raise_error(F.concat(F.lit(f"the order of {d} lacks member "), F.col(d)))).otherwise(place)
            pick = F.min_by if rule == "first" else F.max_by
            cells = cells.withColumn("_at", place).groupBy(*kept).agg(pick("value", "_at").alias("value"))
        return cells

    def _with_provenance(self, out: DataFrame, m: Measure, by: list[str], least: float | None, overlay: str | None, made: bool = False, cuboid: str | None = None) -> DataFrame:
        good, withheld = self.completeness(m.name)
        share = good / (good + withheld) if good + withheld else None
        if least is not None and (share is None or share < least):
            raise Refused(f"completeness {share} is under {least}")
        extra = {"definition_version": self.d.fingerprint(), "snapshot": self.snapshot, "materialised": made, "from_cuboid": cuboid, "completeness": share, "withheld": withheld, "overlay": overlay}
        types = {"from_cuboid": "string", "completeness": "double", "withheld": "long", "overlay": "string"}
        return out.withColumns({k: F.lit(v).cast(types[k]) if k in types else F.lit(v) for k, v in extra.items()})

    def slice(self, measure: str, where: tuple[str, str]) -> DataFrame:
        """One member of one dimension, which is dropped; the others stay at the base grain."""
        d, member = where
        m = self.measure(measure)
        self._dims([d])
        rest = [x for x in self.d.names if x != d]
        return self._with_provenance(self.cells(m.name).where(F.col(d) == str(member)).select(*rest, "value"), m, rest, None, None)

    def pivot(self, measure: str, rows: list[str], columns: str) -> DataFrame:
        return self.rollup(measure, [*rows, columns]).groupBy(*rows).pivot(columns).agg(F.first("value"))

    # hierarchies
    def _acyclic(self, name: str, edges: DataFrame) -> None:
        """Refuses a cycle: leaves are stripped until nothing is left."""
        rest = edges.select(F.col("child").cast("string").alias("child"), F.col("parent").cast("string").alias("parent")).where("parent is not null").distinct()
        n = rest.count()
        while n:
            rest = shared_cut(rest.join(rest.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("child", "parent"))
            now = rest.count()
            if now == n:
                raise Refused(f"the hierarchy of {name!r} has a cycle")
            n = now

    def consolidate(self, measure: str, along: str, to: str | None = None, where: dict[str, list[str]] | None = None) -> DataFrame:
        """Members moved one step up (to their parents), or all that lie under `to` gathered there, each counted once."""
        m = self.measure(measure)
        self._dims([along])
        rule = m.rules[along]
        if rule not in ("sum", "min", "max"):
            raise Refused(f"measure {m.name!r} may not be consolidated along {along!r}: its rule there is {rule}")
        if along not in self.parents:
            raise Refused(f"{along!r} has no hierarchy")
        edges = self.parents[along].select(F.col("child").cast("string").alias(along), F.col("parent").cast("string").alias("_up"))
        cells = self._dice(self.cells(m.name), where)
        known = edges.select(along).union(edges.select("_up")).distinct()
        orphan = cells.select(along).distinct().join(known, along, "left_anti").limit(1).collect()
        if orphan:
            raise Refused(f"member {orphan[0][0]!r} of {along!r} is not in its hierarchy")
        if to is None:
            shared = edges.where("_up is not null").groupBy(along).agg(F.count_distinct("_up").alias("n")).where("n > 1").limit(1).collect()
            if shared:
                raise Refused(f"member {shared[0][0]!r} has two parents: say which ancestor")
            moved = cells.join(edges, along, "left").withColumn(along, F.coalesce("_up", along)).drop("_up")
        else:
            under = self._closure(edges, along, to)
            moved = cells.join(under.withColumn("_in", F.lit(True)), along, "left").withColumn(along, F.when(F.col("_in"), F.lit(to)).otherwise(F.col(along))).drop("_in")
        fold = {"sum": F.sum, "min": F.min, "max": F.max}[rule]
        return self._with_provenance(moved.groupBy(*self.d.names).agg(fold("value").alias("value")), m, self.d.names, None, None)

    @staticmethod
    def _closure(edges: DataFrame, along: str, to: str) -> DataFrame:
        """`to` and all below it, each once."""
        found = edges.sparkSession.createDataFrame([(to,)], f"{along} string")
        front = found
        while True:
            front = edges.join(front.select(F.col(along).alias("_up")), "_up").select(along).distinct().join(found, along, "left_anti")
            front = shared_cut(front)
            if front.isEmpty():
                return found
            found = shared_cut(found.unionByName(front))

    # what-if
    def add_overlay(self, name: str, entries: DataFrame, allocate: str = "refuse") -> None:
        """Entries: some dimensions' members, `op` ("set" or "delta") and `amount`. An entry above the base grain is refused, or
        spread over its cells in proportion to their values."""
        if allocate not in ("refuse", "pro_rata"):
            raise Refused(f"allocate {allocate!r} is unknown")
        grain = [d for d in self.d.names if d in entries.columns]
        if len(grain) < len(self.d.names) and allocate == "refuse":
            raise Refused("the overlay is above the base grain and may not be allocated")
        self.overlays[name] = (entries.select(*(F.col(d).cast("string").alias(d) for d in grain), "op", F.col("amount").cast("double").alias("amount")), allocate)

    def _overlaid(self, cells: DataFrame, name: str | None) -> DataFrame:
        if name is None:
            return cells
        if name not in self.overlays:
            raise Refused(f"no overlay {name!r}")
        entries, _ = self.overlays[name]
        grain = [d for d in self.d.names if d in entries.columns]
        totals = cells.groupBy(*grain).agg(F.sum("value").alias("_total"))
        cells = cells.join(totals, grain).join(entries, grain, "left")
        share = F.when(F.col("_total") != 0, F.col("value") / F.col("_total")).otherwise(0.0)
        new = F.when(F.col("op") == "set", F.col("amount") * share).when(F.col("op") == "delta", F.col("value") + F.col("amount") * share).otherwise(F.col("value"))
        return cells.withColumn("value", new).drop("_total", "op", "amount")

    # materialisation
    def materialise(self, measure: str, grains: list[list[str]]) -> None:
        for g in grains:
            self.cuboids[measure, frozenset(self._dims(g))] = shared_cut(self.rollup(measure, g, materialised=False).select(*[d for d in self.d.names if d in g], "value"))

    def retire(self) -> None:
        self.cuboids.clear()

    def choose_grains(self, measure: str, budget_rows: int) -> list[tuple[str, ...]]:
        """Greedy choice of cuboids by benefit a row (Harinarayan, Rajaraman and Ullman), within a budget of rows."""
        names, cells = self.d.names, self.cells(measure)
        grains = [c for n in range(len(names)) for c in combinations(names, n)]
        row = cells.agg(F.count("*").alias("base"), *(F.count_distinct(*g).alias("|".join(g)) for g in grains if g)).first()
        size = {g: row["|".join(g)] if g else 1 for g in grains}
        cost = {g: row["base"] for g in [*grains, tuple(names)]}
        chosen: list[tuple[str, ...]] = []
        while True:
            best, score = None, (0, 1)
            for g in grains:
                if g in chosen or size[g] > budget_rows:
                    continue
                gain = sum(max(0, cost[h] - size[g]) for h in cost if set(h) <= set(g))
                if gain * score[1] > score[0] * size[g]:
                    best, score = g, (gain, size[g])
            if best is None:
                return chosen
            chosen.append(best)
            budget_rows -= size[best]
            for h in cost:
                if set(h) <= set(best):
                    cost[h] = min(cost[h], size[best])

    # metadata
    def describe_dimensions(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.d.name, d.name, level, i) for d in self.d.dimensions for i, level in enumerate((d.name, *d.levels))], "cube string, dimension string, level string, depth int")

    def describe_measures(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.d.name, m.name, d, r, r in COMPOSING or r.startswith(SUPPLIED)) for m in self.d.measures for d, r in m.rules.items()], "cube string, measure string, dimension string, rule string, composes boolean")
