"""Packs of functions written as text: a JSON bundle whose functions are expressions over their arguments.

{"pack": "fleet", "functions": [{"name": "fleet_cost", "takes": [["km", "double"], ["rate", "double"]], "gives": "double",
  "is": "km * rate", "refuses": [["km < 0", "a distance is not negative"]], "examples": [[[2, 3], 6]]}]}

An expression may use its arguments, literals and Spark's deterministic scalar functions: no tables, subqueries, aggregates
or functions that differ from run to run. A bundle is taken whole or not at all: every function is tried on its examples
before any is registered. Functions are SQL functions, so Catalyst inlines them. Null arguments give null.
"""

from __future__ import annotations

import json
import re

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from tessera.operators.exact import APPROXIMATE, VOLATILE
from tessera.session import Refused
from tessera.statement import FORBIDDEN, Reader

TYPES = ("double", "bigint", "int", "string", "boolean", "date", "timestamp", "array<double>")


def _checked(reader: Reader, pack: str, f: dict) -> None:
    if lost := [k for k in ("name", "takes", "gives", "is") if k not in f]:
        raise Refused(f"pack {pack!r}: a function has no {', '.join(lost)}")
    name = f["name"]
    if not re.fullmatch(rf"{re.escape(pack)}_\w+", name):
        raise Refused(f"{name!r}: a function's name begins with its pack's")
    names = [a for a, _ in f["takes"]]
    if len(set(names)) < len(names) or not all(re.fullmatch(r"[A-Za-z]\w*", a) for a in names) or any(t not in TYPES for _, t in f["takes"]) or f["gives"] not in TYPES:
        raise Refused(f"{name!r}: arguments have names of their own and known types")
    for text in (f["is"], *(c for c, _ in f.get("refuses", []))):
        try:
            found = reader.names(f"SELECT {text} AS value")
        except PySparkException as e:
            raise Refused(f"{name!r}: {text!r} is no expression") from e
        if found.tables or re.search(r"\bselect\b", text, re.I):
            raise Refused(f"{name!r}: an expression reads no table")
        called = {c.lower() for c in re.findall(r"(\w+)\s*\(", text)}
        if bad := called & {*FORBIDDEN, *VOLATILE, *APPROXIMATE}:
            raise Refused(f"{name!r} may not call {', '.join(sorted(bad))}")


def _literal(value, kind: str) -> str:
    if value is None:
        return f"cast(null as {kind})"
    if isinstance(value, list):
        return f"cast(array({', '.join(_literal(v, 'double') for v in value)}) as {kind})"
    text = str(value).lower() if isinstance(value, bool) else str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"cast('{text}' as {kind})"


def load(spark: SparkSession, text: str) -> list[str]:
    """Register a bundle's functions; their names."""
    try:
        bundle = json.loads(text)
        pack, functions = bundle["pack"], bundle["functions"]
    except (ValueError, KeyError, TypeError) as e:
        raise Refused("a bundle is a JSON object with pack and functions") from e
    reader, made = Reader(spark), []
    for f in functions:
        _checked(reader, pack, f)
    for f in functions:
        body = f"cast({f['is']} as {f['gives']})"
        for condition, why in reversed(f.get("refuses", [])):
            reason = why.replace("'", "")
            body = f"CASE WHEN {condition} THEN cast(raise_error('{f['name']}: {reason}') AS {f['gives']}) ELSE {body} END"
        if f["takes"]:
            body = f"CASE WHEN {' OR '.join(f'{a} IS NULL' for a, _ in f['takes'])} THEN NULL ELSE {body} END"
        made.append((f, ", ".join(f"{a} {t}" for a, t in f["takes"]), body))
    try:
        for f, takes, body in made:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f['name']}({takes}) RETURNS {f['gives']} RETURN {body}")
            for given, expected in f.get("examples", []):
                call = f"{f['name']}({', '.join(_literal(v, t) for v, (_, t) in zip(given, f['takes'], strict=True))})"
                same = spark.sql(f"SELECT {call} <=> {_literal(expected, f['gives'])} AS same").first()["same"]
                if not same:
                    raise Refused(f"{f['name']!r} does not give {expected!r} for {given!r}")
    except (Refused, PySparkException, ValueError) as e:
        for f, *_ in made:
            spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {f['name']}")
        raise e if isinstance(e, Refused) else Refused(f"pack {pack!r}: {str(e).splitlines()[0]}") from e
    return [f["name"] for f, *_ in made]
