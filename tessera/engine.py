"""One door for queries: SQL over versioned tables, with the statements Spark has not, and cubes and graphs as table functions."""

from __future__ import annotations

import itertools
import re
import textwrap
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import catalogue, scalars
from tessera.operators.cube import Cube, Definition, Dimension, Measure
from tessera.operators.exact import require_exact, require_stable, supplied
from tessera.operators.graph import Graph
from tessera.operators.policy import Policy
from tessera.session import Refused
from tessera.sources.warehouse import Warehouse
from tessera.statement import Named, Reader, conditions, rewritten, without_comments
from tessera.streaming.feeds import Feeds

TABLE_FUNCTIONS = set("cube_rollup cube_slice cube_consolidate cube_dimensions cube_measures cubes derived functions graph_reachable graph_time_respecting graph_shortest_path graph_cycles graph_influence".split())
SCAN = "tessera.scan"
NAME = r"([A-Za-z_][\w.]*)"


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None, allow_approximate: bool = False, max_rows: int | None = None, allow_aggregations: bool = False):
        self.spark, self.allow, self.max_rows, self.allow_aggregations = spark, allow_approximate, max_rows, allow_aggregations
        self.warehouse = Warehouse(spark, root) if root else None
        self.views: dict[str, DataFrame] = {}
        self.cubes: dict[str, Cube] = {}
        self.graphs: dict[str, Graph] = {}
        self.derived: dict[str, str] = {}
        self.policies: dict[str, Policy] = {}
        self.aggregations: dict[str, Callable] = {}
        self.feeds = Feeds(self.warehouse) if self.warehouse else None
        self.reader = Reader(spark)
        catalogue.register(spark)
        scalars.register(spark)

    # tables
    def add(self, name: str, df: DataFrame) -> None:
        self.views[name] = df

    def policy(self, table: str, policy: Policy) -> None:
        """A policy of a table. It holds for every spelling of the name, and may come before the table; cubes and graphs take
        their rows as policies show them when they are declared."""
        self.policies[table.lower()] = policy

    def resolve(self, name: str, known: list[str] | None = None) -> str:
        """The full name of a table as it is written anywhere: upper and lower case are one, a bare name serves while unique."""
        known = self.tables() if known is None else known
        if name in known:
            return name
        found = [t for t in known if t.lower() == name.lower()] or [t for t in known if "." not in name and t.lower().split(".")[-1] == name.lower()]
        if len(found) != 1:
            raise Refused(f"no table {name!r}" if not found else f"{name!r} may be any of {', '.join(found)}")
        return found[0]

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as its policy shows it."""
        name = self.resolve(name)
        return self._secured(name, self.views[name] if name in self.views else self.warehouse.scan(name, version))

    def _secured(self, name: str, df: DataFrame) -> DataFrame:
        """A policy for a bare name holds for the tables of that name in every schema, unless one has a policy of its own."""
        own = self.policies.get(name.lower()) or self.policies.get(name.lower().split(".")[-1])
        return own.secure(df) if own else df

    def tables(self) -> list[str]:
        return sorted([*self.views, *(self.warehouse.tables() if self.warehouse else [])])

    # SQL
    def sql(self, text: str) -> DataFrame:
        bare = without_comments(text)
        if (out := self._house(bare)) is not None:
            return out
        df = require_exact(self._query(bare), self.allow)
        if self.max_rows is None:
            return df
        found = df.limit(self.max_rows + 1).collect()
        if len(found) > self.max_rows:
            raise Refused(f"the result has more than {self.max_rows} rows")
        return self.spark.createDataFrame(found, df.schema)

    def scalar(self, text: str):
        row = self.sql(text).first()
        return None if row is None else row[0]

    def rows(self, text: str) -> list[tuple]:
        return [tuple(r) for r in self.sql(text).collect()]

    def one(self, text: str) -> tuple:
        """The only row; refused if there are none or more."""
        found = self.sql(text).limit(2).collect()
        if len(found) != 1:
            raise Refused(f"{'no row' if not found else 'more than one row'} where one is expected")
        return tuple(found[0])

    # the same verbs without SQL
    def schemas(self) -> list[str]:
        return sorted({t.split(".")[0] for t in self.tables() if "." in t})

    def columns(self, table: str) -> list[tuple[str, str]]:
        return self.table(table).dtypes

    def functions(self) -> DataFrame:
        return catalogue.functions(self.spark)

    def fn(self, name: str, *args):
        return catalogue.fn(name, *args)

    def clone(self, name: str, origin: str, version: int | None = None) -> None:
        self._need().clone(name, origin, version)

    def lineage(self, table: str) -> DataFrame:
        return self.sql(f"SHOW LINEAGE OF {table}")

    def snapshots(self) -> DataFrame:
        return self._need().show_snapshots()

    def rollup(self, cube: str, measure: str, by: list[str], **options) -> DataFrame:
        return self._cube(cube).rollup(measure, by, **options)

    def slice(self, cube: str, measure: str, dimension: str, member: str) -> DataFrame:
        return self._cube(cube).slice(measure, (dimension, member))

    def consolidate(self, cube: str, measure: str, along: str, to: str | None = None) -> DataFrame:
        return self._cube(cube).consolidate(measure, along, to)

    def reachable(self, graph: str, seeds: list, **options) -> DataFrame:
        return self._graph(graph).reachable(seeds, **options)

    def shortest_path(self, graph: str, source, target, k: int = 1) -> DataFrame:
        return self._graph(graph).shortest_path(source, target, k)

    def _need(self) -> Warehouse:
        if self.warehouse is None:
            raise Refused("there is no warehouse")
        return self.warehouse

    def _create_aggregation(self, name: str, code: str) -> None:
        if not self.allow_aggregations:
            raise Refused("aggregations from SQL run Python; say allow_aggregations=True")
        if name in self.aggregations:
            raise Refused(f"aggregation {name!r} is there already")
        made = supplied(name, textwrap.dedent(code).strip())
        self.spark.udf.register(name, made.as_sql)
        self.aggregations[name] = made

    def _query(self, text: str, within: tuple[str, ...] = ()) -> DataFrame:
        """The query over the tables it names. Tables of more than one file are first planned over one of them, to learn which
        conditions reach their scans: the others' bounds are held against these."""
        functions: dict[Named, str] = {}
        versioned: dict[int, tuple[str, int]] = {}
        names, known = self.reader.names(text), self.tables()
        versions: dict[str, int] = {}  # one version of a table for the whole query

        def table(parts: tuple[str, ...], at: int | None, where: dict[str, list[tuple]] | None) -> tuple[str, str, tuple[str, ...]]:
            name = ".".join(parts)
            if parts[0].lower() == "information_schema" and len(parts) == 2:
                return self._as_view(self._information(parts[1].lower())), parts[1], parts
            if name in self.derived:
                if name in within:
                    raise Refused(f"derived query {name!r} names itself")
                return self._as_view(self._query(self.derived[name], (*within, name))), name, parts
            full = self.resolve(name, known)
            if full in self.views:
                return self._as_view(self._secured(full, self.views[full])), full.split(".")[-1], (full,)
            if full not in versions:
                versions[full] = self.warehouse.read_version(full)
            versioned[at] = full, versions[full]
            df = self._secured(full, self.warehouse.scan(full, versions[full], where.get(str(at), []) if where is not None else [], {SCAN: str(at)}, where is None))
            return self._as_view(df), full.split(".")[-1], tuple(full.split("."))

        def function(n: Named) -> str | None:
            f = n.parts[-1].lower()
            if f not in TABLE_FUNCTIONS or len(n.parts) > 1:
                return None
            if None in n.arguments:
                raise Refused(f"{f} takes literals")
            if n not in functions:
                functions[n] = self._as_view(self._call(f, list(n.arguments)))
            return functions[n]

        def run(where: dict[str, list[tuple]] | None) -> DataFrame:
            turn = itertools.count()
            return self.spark.sql(rewritten(self.reader, text, names, lambda parts: table(parts, next(turn), where), function))

        df = run(None)
        if any(len(self.warehouse.state(n, v)["files"]) > 1 for n, v in versioned.values()):
            df = run(conditions(df, SCAN))
        return df

    def _information(self, what: str) -> DataFrame:
        """The catalogue as rows: schemata, tables and columns, as policies show them."""
        split = lambda t: tuple(t.split(".")) if "." in t else ("main", t)
        if what == "schemata":
            return self.spark.createDataFrame(sorted({(split(t)[0],) for t in self.tables()}), "schema_name string")
        if what == "tables":
            return self.spark.createDataFrame([(*split(t), "VIEW" if t in self.views else "BASE TABLE") for t in self.tables()], "table_schema string, table_name string, table_type string")
        if what == "columns":
            rows = [(*split(t), f.name, i + 1, "YES" if f.nullable else "NO", f.dataType.simpleString()) for t in self.tables() for i, f in enumerate(self.table(t).schema.fields)]
            return self.spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")
        raise Refused(f"no table 'information_schema.{what}'")

    def _as_view(self, df: DataFrame) -> str:
        name = f"_t_{uuid.uuid4().hex[:12]}"
        df.createOrReplaceTempView(name)
        return name

    def explain(self, query: str, mode: str = "formatted") -> str:
        df = require_exact(self._query(query), self.allow)
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    # cubes and graphs in FROM
    @staticmethod
    def _options(given: list[str], known: tuple[str, ...]) -> dict[str, str]:
        out = {}
        for o in (x for g in given for x in g.split(",") if x.strip()):
            k, _, v = (x.strip() for x in o.partition("="))
            if k not in known:
                raise Refused(f"option {k!r} is unknown; known: {', '.join(known)}")
            out[k] = v
        return out

    def _cube(self, name: str) -> Cube:
        if name not in self.cubes:
            raise Refused(f"no cube {name!r}")
        self.cubes[name].refresh()
        return self.cubes[name]

    def _graph(self, name: str) -> Graph:
        if name not in self.graphs:
            raise Refused(f"no graph {name!r}")
        return self.graphs[name]

    def _call(self, f: str, args: list[str]) -> DataFrame:
        if f == "functions":
            return catalogue.functions(self.spark)
        if f == "cubes":
            return self.spark.createDataFrame([(n, c.d.fingerprint(), len(c.d.dimensions), len(c.d.measures)) for n, c in self.cubes.items()], "cube string, definition_version string, dimensions int, measures int")
        if f == "derived":
            return self.spark.createDataFrame(list(self.derived.items()), "name string, query string")
        if not args:
            raise Refused(f"{f} needs arguments")
        if f == "cube_dimensions":
            return self._cube(args[0]).describe_dimensions(self.spark)
        if f == "cube_measures":
            return self._cube(args[0]).describe_measures(self.spark)
        if f.startswith("cube_"):
            cube, measure = self._cube(args[0]), args[1]
            o = self._options(args[2:], ("by", "where", "along", "to", "order", "min_completeness", "overlay", "materialise"))
            where = {k: v.split("/") for k, _, v in (p.partition(":") for p in o.get("where", "").split("|") if p)}
            if f == "cube_rollup":
                order = {k: v.split("|") for k, _, v in (p.partition(":") for p in o.get("order", "").split(";") if p)}
                return cube.rollup(measure, [b for b in o.get("by", "").split("|") if b], where, order, float(o["min_completeness"]) if "min_completeness" in o else None, o.get("overlay"), o.get("materialise") != "no")
            if f == "cube_slice":
                if len(where) != 1 or any(len(v) != 1 for v in where.values()):
                    raise Refused("cube_slice needs where= with exactly one member of one dimension")
                d, v = next(iter(where.items()))
                return cube.slice(measure, (d, v[0]))
            if "along" not in o:
                raise Refused("cube_consolidate needs along=")
            return cube.consolidate(measure, o["along"], o.get("to"), where)
        g = self._graph(args[0])
        if f == "graph_shortest_path":
            return g.provenance(g.shortest_path(args[1], args[2], int(args[3]) if len(args) > 3 else 1))
        seeds = args[1].split("|")
        if f == "graph_cycles":
            return g.provenance(g.cycles(seeds))
        if f == "graph_influence":
            o = self._options(args[2:], ("damping", "floor"))
            return g.provenance(g.influence(seeds, **{k: float(v) for k, v in o.items()}))
        if f == "graph_time_respecting":
            o = self._options(args[2:], ("at", "min_dwell", "max_dwell", "min_conservation"))
            return g.provenance(g.time_respecting(seeds, **{k: float(v) if k == "min_conservation" else int(v) for k, v in o.items()}))
        o = self._options(args[2:], ("max_depth", "types", "direction", "at"))
        return g.reachable(seeds, int(o["max_depth"]) if "max_depth" in o else None, o["types"].split("|") if "types" in o else None, o.get("direction", "out"), int(o["at"]) if "at" in o else None)

    # house statements
    def _house(self, text: str) -> DataFrame | None:
        for pattern, run in self._statements():
            if m := re.fullmatch(pattern, text, re.I | re.S):
                out = run(m)
                return out if isinstance(out, DataFrame) else self.spark.createDataFrame([("done" if out is None else str(out),)], "status string")
        return None

    def _statements(self):
        frame, need = self.spark.createDataFrame, self._need
        full = lambda n: need().resolve(n)
        yield rf"CREATE\s+CUBE\s+{NAME}\s+FROM\s+(\(.*?\)|[\w.]+)\s+(DIMENSION.*)", lambda m: self._create_cube(m[1], m[2], m[3])
        yield rf"DROP\s+CUBE\s+(IF\s+EXISTS\s+)?{NAME}", lambda m: self._drop(self.cubes, m[2], bool(m[1]), "cube")
        yield rf"CREATE\s+DERIVED\s+{NAME}\s+FROM\s+\((.*)\)", lambda m: self._create_derived(m[1], m[2])
        yield rf"DROP\s+DERIVED\s+(IF\s+EXISTS\s+)?{NAME}", lambda m: self._drop(self.derived, m[2], bool(m[1]), "derived query")
        yield rf"CREATE\s+SNAPSHOT\s+{NAME}\s+EXPIRE\s+AFTER\s+(\d+)\s+DAYS?", lambda m: need().create_snapshot(m[1], int(m[2]))
        yield r"SHOW\s+SNAPSHOTS", lambda m: need().show_snapshots()
        yield rf"DROP\s+SNAPSHOT\s+{NAME}", lambda m: need().drop_snapshot(m[1])
        yield rf"SET\s+SNAPSHOT\s*=?\s*{NAME}", lambda m: need().set_snapshot(m[1])
        yield r"RESET\s+SNAPSHOT", lambda m: need().set_snapshot(None)
        yield rf"SET\s+VERSION\s+OF\s+{NAME}\s*=\s*(\d+)", lambda m: need().set_version(m[1], int(m[2]))
        yield rf"RESET\s+VERSION\s+OF\s+{NAME}", lambda m: need().set_version(m[1], None)
        yield rf"SHOW\s+HISTORY\s+OF\s+{NAME}", lambda m: need().history(full(m[1]))
        yield rf"SHOW\s+CHANGES\s+BETWEEN\s+(\d+)\s+AND\s+(\d+)\s+FOR\s+{NAME}", lambda m: frame([tuple((c := need().changes(full(m[3]), int(m[1]), int(m[2]))).values())], list(c))
        yield rf"CREATE\s+TABLE\s+{NAME}\s+CLONE\s+{NAME}(?:\s+AT\s+VERSION\s+(\d+))?", lambda m: need().clone(m[1], m[2], int(m[3]) if m[3] else None)
        yield rf"DROP\s+TABLE\s+{NAME}", lambda m: need().drop(full(m[1]))
        yield rf"SHOW\s+LINEAGE\s+OF\s+{NAME}", lambda m: frame(need().lineage(full(m[1])), "step int, origin string, origin_version long, cloned_at double")
        yield rf"SHOW\s+DEPENDENTS\s+OF\s+{NAME}", lambda m: frame(need().dependents(full(m[1])), "dependent string, relation string, reads_version long")
        yield rf"CREATE\s+AGGREGATION\s+{NAME}\s+LANGUAGE\s+PYTHON\s+AS\s+\$\$(.*)\$\$", lambda m: self._create_aggregation(m[1], m[2])
        yield r"SHOW\s+AGGREGATIONS", lambda m: frame([(n,) for n in self.aggregations], "aggregation string")
        yield rf"DROP\s+AGGREGATION\s+{NAME}", lambda m: self._drop(self.aggregations, m[1], False, "aggregation")
        yield r"EXPLAIN\s+(?:(EXTENDED|FORMATTED|CODEGEN|COST)\s+)?((?:SELECT|WITH|TABLE|FROM|VALUES|\().*)", lambda m: frame([(self.explain(m[2], (m[1] or "formatted").lower()),)], "plan string")
        yield r"SHOW\s+FEEDS", lambda m: self._need() and self.feeds.show()
        yield rf"RESUME\s+FEED\s+{NAME}", lambda m: self._need() and self.feeds.resume(m[1])
        yield rf"CREATE\s+GRAPH\s+{NAME}\s+FROM\s+([\w.]+)\s*\(([^()]*)\)", lambda m: self._create_graph(m[1], m[2], m[3])
        yield rf"DROP\s+GRAPH\s+(IF\s+EXISTS\s+)?{NAME}", lambda m: self._drop(self.graphs, m[2], bool(m[1]), "graph")

    def _create_graph(self, name: str, table: str, roles: str) -> None:
        """CREATE GRAPH g FROM t (SOURCE a, TARGET b, WEIGHT w, TYPE k, VALID FROM x, VALID UNTIL y)."""
        if name in self.graphs:
            raise Refused(f"graph {name!r} is there already")
        known = {"source": "source", "target": "target", "weight": "weight", "type": "edge_type", "valid from": "valid_from", "valid until": "valid_until"}
        given = {}
        for part in filter(None, map(str.strip, roles.split(","))):
            *role, column = part.split()
            if (role := " ".join(role).lower()) not in known or known[role] in given:
                raise Refused(f"graph {name!r}: {part!r} is not understood")
            given[known[role]] = column
        if lost := {"source", "target"} - set(given):
            raise Refused(f"graph {name!r} has no {', '.join(sorted(lost))}")
        version = self._version(table)
        self.graphs[name] = Graph(self._query(f"SELECT * FROM {table}"), **given, snapshot=None if version is None else str(version))

    def _version(self, table: str) -> int | None:
        """The version that this session reads of a versioned table."""
        full = self.resolve(table)
        return None if full in self.views else self.warehouse.read_version(full)

    @staticmethod
    def _drop(held: dict, name: str, quiet: bool, what: str) -> None:
        if held.pop(name, None) is None and not quiet:
            raise Refused(f"no {what} {name!r}")

    def _create_derived(self, name: str, query: str) -> None:
        if name in self.derived or name in self.tables():
            raise Refused(f"{name!r} is there already")
        if re.fullmatch(r"\s*(SELECT\s+\*\s+FROM\s+)?[\w.]+\s*", query, re.I):
            raise Refused("a bare table is no derived query")
        require_stable(require_exact(self._query(query), self.allow))
        self.derived[name] = query

    def _create_cube(self, name: str, source: str, rest: str) -> None:
        if name in self.cubes:
            raise Refused(f"cube {name!r} is there already")
        query = source[1:-1] if source.startswith("(") else f"SELECT * FROM {source}"
        facts, follow = self._query(query), None
        if not source.startswith("(") and self._version(source) is not None:
            follow = lambda: (self._version(source), self._query(query))
        within = re.search(r"\bMAINTAINED\s+WITHIN\s+(\d+)\s+VERSIONS?", rest, re.I)
        if within and follow is None:
            raise Refused("only a cube over a versioned table is maintained")
        pinned = [[d.strip() for d in p.split(",") if d.strip()] for p in re.findall(r"\bPINNED\s*\(([^()]*)\)", rest, re.I)]
        rest = re.sub(r"\bMAINTAINED\s+WITHIN\s+\d+\s+VERSIONS?|\bPINNED\s*\([^()]*\)", " ", rest, flags=re.I)
        dims, hierarchies, measures = [], {}, []
        for m in re.finditer(rf"DIMENSION\s+{NAME}(?:\s+FROM\s+{NAME}\s+ON\s+(\w+))?(?:\s*\(([^()]*)\))?|MEASURE\s+{NAME}(?:\s+OF\s+(\w+))?\s*\(([^()]*)\)", rest, re.I):
            if m[1]:
                levels = []
                for part in filter(None, map(str.strip, (m[4] or "").split(","))):
                    if p := re.fullmatch(r"LEVEL\s+(\w+)\s*(?:=\s*(\w+))?", part, re.I):
                        levels.append(p[2] or p[1])
                    elif (p := re.fullmatch(r"PARENT\s+(\w+)\s+TO\s+(\w+)", part, re.I)) and m[2]:
                        hierarchies[m[1]] = self.table(m[2]).selectExpr(f"{p[1]} AS child", f"{p[2]} AS parent").distinct()
                    else:
                        raise Refused(f"dimension {m[1]!r}: {part!r} is not understood")
                dims.append(Dimension(m[1], tuple(levels)))
            else:
                rules = {}
                for part in filter(None, map(str.strip, m[7].split(","))):
                    if not (p := re.fullmatch(r"(AGGREGATION(?:\s+\w+)?|\w+)\s+ALONG\s+(\w+)", part, re.I)):
                        raise Refused(f"measure {m[5]!r}: {part!r} is not understood")
                    kind, _, supplied_name = p[1].partition(" ")
                    rules[p[2]] = f"{kind.lower()} {supplied_name.strip()}" if kind.lower() == "aggregation" else kind.lower()
                measures.append(Measure(m[5], m[6] or m[5], rules))
        self.cubes[name] = Cube(Definition(name, tuple(dims), tuple(measures)), facts, hierarchies, "live" if follow is None else str(self._version(source)), self.aggregations, follow, int(within[1]) if within else None, pinned)
