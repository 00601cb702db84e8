"""Scalar functions that Spark's SQL lacks or names otherwise, and packs: named bundles of functions for a domain.

All are SQL functions, so Catalyst inlines them. Null in any argument gives null; what has no honest answer is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from tessera.session import Refused


@dataclass(frozen=True)
class SqlFunction:
    name: str
    args: str
    returns: str
    body: str
    about: str = ""

    def create(self, spark: SparkSession) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {self.name}({self.args}) RETURNS {self.returns} RETURN {self.body}")


def _refuse(condition: str, why: str, body: str, kind: str) -> str:
    return f"CASE WHEN {condition} THEN CAST(raise_error('{why}') AS {kind}) ELSE {body} END"


#: Euclid's steps: 92 reach the end for any two 64-bit numbers.
_GCD = "aggregate(sequence(1, 92), named_struct('x', abs(a), 'y', abs(b)), (s, i) -> CASE WHEN s.y = 0 THEN s ELSE named_struct('x', s.y, 'y', s.x % s.y) END, s -> s.x)"

SCALARS = (
    SqlFunction("gcd", "a BIGINT, b BIGINT", "BIGINT", _GCD, "greatest common divisor"),
    SqlFunction("lcm", "a BIGINT, b BIGINT", "BIGINT", f"CASE WHEN a = 0 OR b = 0 THEN 0 ELSE abs(a) DIV {_GCD} * abs(b) END", "least common multiple"),
    SqlFunction("trunc_number", "a DOUBLE, d INT", "DOUBLE", "sign(a) * floor(abs(a) * power(10, d)) / power(10, d)", "digits cut off toward zero"),
    SqlFunction("iszero", "a DOUBLE", "BOOLEAN", "a = 0", "whether a number is zero"),
    SqlFunction("strpos", "s STRING, t STRING", "INT", "instr(s, t)", "place of t in s, from 1; 0: none"),
    SqlFunction("substr_index", "s STRING, t STRING, n INT", "STRING", "substring_index(s, t, n)", "part of s before the n-th t"),
    SqlFunction("to_hex", "a BIGINT", "STRING", "lower(hex(a))", "hexadecimal digits"),
    SqlFunction("starts_with", "s STRING, t STRING", "BOOLEAN", "startswith(s, t)", "whether s starts with t"),
    SqlFunction("ends_with", "s STRING, t STRING", "BOOLEAN", "endswith(s, t)", "whether s ends with t"),
    SqlFunction("regexp_match", "s STRING, p STRING", "STRING", "CASE WHEN s RLIKE p THEN regexp_extract(s, p, 0) END", "the first match; null: none"),
    SqlFunction("concat_known", "s STRING, t STRING", "STRING", "concat_ws('', s, t)", "joined text, nulls left out"),
    SqlFunction("date_bin", "w INTERVAL DAY TO SECOND, t TIMESTAMP, o TIMESTAMP", "TIMESTAMP", "timestamp_micros(unix_micros(o) + CAST(floor((unix_micros(t) - unix_micros(o)) / CAST(unix_micros(timestamp_seconds(0) + w) AS DOUBLE)) AS BIGINT) * unix_micros(timestamp_seconds(0) + w))", "start of the bin of width w from origin o"),
    SqlFunction("today", "", "DATE", "current_date()", "today"),
    SqlFunction("to_unixtime", "t TIMESTAMP", "BIGINT", "unix_seconds(t)", "seconds since 1970"),
    SqlFunction("to_timestamp_seconds", "a BIGINT", "TIMESTAMP", "timestamp_seconds(a)", "from seconds"),
    SqlFunction("to_timestamp_millis", "a BIGINT", "TIMESTAMP", "timestamp_millis(a)", "from milliseconds"),
    SqlFunction("to_timestamp_micros", "a BIGINT", "TIMESTAMP", "timestamp_micros(a)", "from microseconds"),
    SqlFunction("to_timestamp_nanos", "a BIGINT", "TIMESTAMP", "timestamp_micros(a DIV 1000)", "from nanoseconds"),
    SqlFunction("datetrunc", "u STRING, t TIMESTAMP", "TIMESTAMP", "date_trunc(u, t)", "start of the unit"),
    SqlFunction("to_local_time", "t TIMESTAMP", "TIMESTAMP_NTZ", "CAST(t AS TIMESTAMP_NTZ)", "the session's wall clock"),
)


@dataclass(frozen=True)
class Pack:
    """A named bundle. Names of its functions begin with the pack's."""

    name: str
    functions: tuple[SqlFunction, ...]

    def register(self, spark: SparkSession) -> None:
        if wrong := [f.name for f in self.functions if not f.name.startswith(f"{self.name}_")]:
            raise Refused(f"pack {self.name!r} may not add {', '.join(wrong)}")
        for f in self.functions:
            f.create(spark)


TELEMETRY = Pack("telemetry", (
    SqlFunction("telemetry_breach_severity", "reading DOUBLE, threshold DOUBLE", "DOUBLE", _refuse("threshold = 0", "a share of a zero threshold is undefined", "CASE WHEN reading IS NOT NULL AND threshold IS NOT NULL THEN greatest((reading - threshold) / threshold, 0D) END", "DOUBLE"), "share by which a reading exceeds its threshold"),
    SqlFunction("telemetry_window_start", "at BIGINT, width BIGINT", "BIGINT", _refuse("width <= 0", "a width is positive", "at - pmod(at, width)", "BIGINT"), "start of the window that holds an instant"),
    SqlFunction("telemetry_threshold_bands", "threshold DOUBLE", "TABLE(band STRING, lower DOUBLE, upper DOUBLE)", "SELECT band, least * t.k AS lower, least * t.m AS upper FROM (SELECT CASE WHEN threshold <= 0 THEN CAST(raise_error('a threshold is positive') AS DOUBLE) ELSE threshold END AS least) q, VALUES ('nominal', 0D, 1D), ('elevated', 1D, 1.5D), ('critical', 1.5D, CAST('Infinity' AS DOUBLE)) AS t(band, k, m)", "bands of a threshold"),
))
LOGISTICS = Pack("logistics", (
    SqlFunction("logistics_dwell_hours", "arrived TIMESTAMP, departed TIMESTAMP", "DOUBLE", _refuse("departed < arrived", "the departure is before the arrival", "(unix_micros(departed) - unix_micros(arrived)) / 3600000000D", "DOUBLE"), "hours between arrival and departure"),
    SqlFunction("logistics_leg_cost", "distance DOUBLE, rate DOUBLE", "DOUBLE", _refuse("distance < 0", "a distance is not negative", "distance * rate", "DOUBLE"), "cost of a leg"),
    SqlFunction("logistics_check_digit", "reference STRING", "BIGINT", _refuse("reference RLIKE '[^0-9]'", "a reference has digits only", "(11 - aggregate(transform(filter(split(reference, ''), c -> c <> ''), (c, i) -> CAST(c AS BIGINT) * (i % 6 + 2)), 0L, (s, x) -> s + x) % 11) % 11", "BIGINT"), "check digit modulo 11, weights 2 to 7"),
))
PACKS = (TELEMETRY, LOGISTICS)

_REGISTERED: set[str] = set()


def register(spark: SparkSession) -> None:
    """Make them known to this session's SQL."""
    key = f"{spark.sparkContext.applicationId}/{id(spark._jsparkSession)}"
    if key not in _REGISTERED:
        for f in SCALARS:
            f.create(spark)
        for p in PACKS:
            p.register(spark)
        _REGISTERED.add(key)
