"""Exactness: guards on approximate and volatile functions, named quantile conventions, and sums that do not depend on order."""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.session import Refused, shared_cut

APPROXIMATE = ("approx_count_distinct", "approx_percentile", "percentile_approx", "approx_top_k", "count_min_sketch", "hll_sketch_agg", "hll_union_agg", "theta_sketch_agg")
VOLATILE = ("rand", "randn", "random", "uuid", "shuffle", "now", "current_timestamp", "current_date", "localtimestamp", "monotonically_increasing_id")


def _used(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    plan = df._jdf.queryExecution().analyzed().toString()
    return sorted({n for n in names if re.search(rf"(?<![\w.]){n}\(", plan)})


def require_exact(df: DataFrame, allow: bool = False) -> DataFrame:
    """`df`, unless its plan (subqueries too) uses approximate functions that nobody allowed; all of them are named."""
    if not allow and (used := _used(df, APPROXIMATE)):
        raise Refused(f"approximate: {', '.join(used)}")
    return df


def require_stable(df: DataFrame) -> DataFrame:
    """`df`, unless its plan uses functions that differ from run to run."""
    if used := _used(df, VOLATILE):
        raise Refused(f"volatile: {', '.join(used)}")
    return df


def quantile(column: str, q: float, convention: str = "linear") -> Column:
    """An exact order statistic: "linear" or "nearest" (rank ceil(qn)); for "lower" see lower_quantile."""
    if not 0 <= q <= 1:
        raise Refused("a share lies in [0, 1]")
    if convention == "linear":
        return F.expr(f"percentile({column}, {q}D)")
    if convention == "nearest":
        return F.expr(f"percentile_disc({q}D) WITHIN GROUP (ORDER BY {column})")
    raise Refused(f"convention {convention!r} is unknown")


def lower_quantile(df: DataFrame, by: list[str], column: str, q: float, name: str = "value") -> DataFrame:
    """The order statistic at index floor(q(n-1)) of each group, without gathering a group: equal values are counted first and
    range partitioned by group and value, so a large group lies in many parts. Its counts by part tell in which of them the
    place is; a running count is taken within that part alone."""
    from pyspark.sql import Window as W

    if not 0 <= q <= 1:
        raise Refused("a share lies in [0, 1]")
    own = [f"_g{i}" for i in range(len(by))]
    groups = [F.col(b).alias(o) for b, o in zip(by, own, strict=True)]
    counts = df.where(F.col(column).isNotNull()).groupBy(*groups, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    parts = shared_cut(counts.repartitionByRange(*own, "_v").withColumn("_part", F.spark_partition_id()))
    group = W.partitionBy(*own) if own else W.partitionBy(F.lit(0))  # over a row for each group and part
    sums = parts.groupBy(*own, "_part").agg(F.sum("_n").alias("_k"))
    sums = sums.withColumns({"_to": F.sum("_k").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("_k").over(group)})
    at = F.floor(q * (F.col("_all") - 1))
    place = sums.where((F.col("_to") > at) & (F.col("_to") - F.col("_k") <= at)).select(*(F.col(o).alias(f"{o}_") for o in own), F.col("_part").alias("_part_"), (at - F.col("_to") + F.col("_k")).alias("_at"))
    same = F.col("_part") == F.col("_part_")
    for o in own:
        same = same & F.col(o).eqNullSafe(F.col(f"{o}_"))
    near = parts.join(place, same)
    to = F.sum("_n").over(W.partitionBy(*own, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    found = near.withColumn("_to", to).where((F.col("_to") > F.col("_at")) & (F.col("_to") - F.col("_n") <= F.col("_at")))
    return found.select(*(F.col(o).alias(b) for b, o in zip(by, own, strict=True)), F.col("_v").alias(name))


def quantile_of_sum(df: DataFrame, vector: str, q: float) -> float:
    """The quantile of the element-wise sum of vectors: summed by position, then one percentile over the positions."""
    sums = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    return sums.agg(F.expr(f"percentile(x, {q}D)")).first()[0]


def overflow_risk(rows: int, low: int, high: int, bits: int = 64) -> bool:
    """Whether a sum of so many whole numbers between the bounds could leave the type. Bounds come from a table's log."""
    limit = 1 << bits - 1
    return not -limit <= rows * min(low, 0) <= rows * max(high, 0) < limit


def _partials(values) -> list[float]:
    """Shewchuk's exact partial sums."""
    parts: list[float] = []
    for x in values:
        i = 0
        for y in parts:
            if abs(x) < abs(y):
                x, y = y, x
            hi = x + y
            lo = y - (hi - x)
            if lo:
                parts[i] = lo
                i += 1
            x = hi
        parts[i:] = [x]
    return parts


def deterministic_sum(df: DataFrame, by: list[str], column: str, name: str = "total") -> DataFrame:
    """Correctly rounded sums, whatever the partitions: exact partial sums on the map side, merged exactly."""
    keys = df.select(*by, F.col(column).cast("double").alias("_x")).where("_x is not null")
    schema = keys.select(*by).schema

    def part(batches):
        held: dict[tuple, list[float]] = {}
        for b in batches:
            groups = b.groupby(by, dropna=False, sort=False)["_x"] if by else [((), b["_x"])]
            for k, x in groups:
                k = k if isinstance(k, tuple) else (k,)
                held[k] = _partials([*held.get(k, []), *x.tolist()])
        if held:
            yield pd.DataFrame([(*k, v) for k, v in held.items()], columns=[*by, "_p"])

    partial = keys.mapInPandas(part, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), "_p array<double>"]))

    @pandas_udf("double")
    def merge(p: pd.Series) -> float:
        return math.fsum(x for parts in p for x in parts)

    return partial.groupBy(*by).agg(merge("_p").alias(name))


def user_aggregation(name: str, accumulate: Callable, merge: Callable, finish: Callable, start: Callable, probe: list[float] | None = None):
    """A supplied aggregation over doubles as two-phase rows: apply(df, by, column). It is exercised when declared: one batch
    against several, and two groupings of merges, must agree to the bit."""
    values = probe or [1.5, -2.25, 1e9, 3.0, 0.125, 7.0]

    def run(chunks: list[list[float]], left: bool) -> object:
        states = []
        for c in chunks:
            s = start()
            for x in c:
                s = accumulate(s, x)
            states.append(s)
        while len(states) > 1:
            states = [merge(states[0], states[1]), *states[2:]] if left else [*states[:-2], merge(states[-2], states[-1])]
        return finish(states[0])

    seen = {repr(run(c, left)) for c in ([values], [values[:2], values[2:4], values[4:]]) for left in (True, False)}
    if len(seen) > 1:
        raise Refused(f"aggregation {name!r} depends on how rows are grouped: {', '.join(sorted(seen))}")

    def apply(df: DataFrame, by: list[str], column: str) -> DataFrame:
        import pickle

        keys = df.select(*by, F.col(column).cast("double").alias("_x")).where("_x is not null")
        head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keys.select(*by).schema.fields)

        def part(batches):
            held: dict[tuple, object] = {}
            for b in batches:
                for k, x in b.groupby(by, dropna=False, sort=False)["_x"] if by else [((), b["_x"])]:
                    k = k if isinstance(k, tuple) else (k,)
                    s = held[k] if k in held else start()
                    for v in x.tolist():
                        s = accumulate(s, v)
                    held[k] = s
            if held:
                yield pd.DataFrame([(*k, pickle.dumps(v)) for k, v in held.items()], columns=[*by, "_s"])

        @pandas_udf("double")
        def combine(s: pd.Series) -> float:
            states = [pickle.loads(x) for x in s]
            out = states[0]
            for x in states[1:]:
                out = merge(out, x)
            return float(finish(out))

        return keys.mapInPandas(part, f"{head}_s binary").groupBy(*by).agg(combine("_s").alias(name))

    @pandas_udf("double")
    def whole(x: pd.Series) -> float:
        state = start()
        for v in x.dropna().tolist():
            state = accumulate(state, v)
        return float(finish(state))

    apply.as_sql = whole
    return apply


PARTS = ("start", "accumulate", "merge", "finish")
#: What supplied code may call besides its own functions and `math`.
BUILTINS = {f.__name__: f for f in (abs, all, any, bool, dict, divmod, enumerate, float, int, isinstance, len, list, map, max, min, pow, range, reversed, round, set, sorted, str, sum, tuple, zip, ValueError, ZeroDivisionError)}


def _harmless(tree: ast.AST) -> None:
    """Refuse code that imports, or reaches for what is not given to it. This is a fence and no jail: what runs is still bounded
    only by Spark's worker processes."""
    for node in ast.walk(tree):
        if isinstance(node, (ast.Import, ast.ImportFrom, ast.Global, ast.Nonlocal, ast.ClassDef, ast.AsyncFunctionDef, ast.With, ast.While)):
            raise Refused(f"supplied code may not hold {type(node).__name__}")
        name = node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""
        if name.startswith("_") or name in ("format", "format_map", "mro"):
            raise Refused(f"supplied code may not use {name!r}")


def supplied(name: str, code: str):
    """A user aggregation from Python text that defines start, accumulate, merge and finish."""
    tree = ast.parse(code, f"<aggregation {name}>")
    _harmless(tree)
    space: dict = {"__builtins__": BUILTINS, "math": math}
    exec(compile(tree, f"<aggregation {name}>", "exec"), space)  # noqa: S102  only where the engine's owner allows it
    if lost := [p for p in PARTS if not callable(space.get(p))]:
        raise Refused(f"aggregation {name!r} does not define {', '.join(lost)}")
    return user_aggregation(name, space["accumulate"], space["merge"], space["finish"], space["start"])
