"""Operator 6: judging urls by nested host and path rules, by a sort-merge range join.

A host's key is its labels reversed, each with "/" behind it (a sign no host holds): www.example.com is com/example/www/.
A rule's host is then a prefix, so it covers an interval of keys, and nested rules are nested intervals. Urls and rules are
range partitioned together by key (urls by path too) and sorted; one sweep over each cell keeps a stack of the hosts whose
intervals are open. Of those hosts' rules the ones whose path the url's path begins with fit; the longest (host and path
together, then the longer host) wins. Of rules with equal host and path the greatest verdict in byte order wins, whatever
their order: block before allow. A url that no rule fits is allowed unless `default` says otherwise.

The cells' bounds are drawn from both tables (a fixed number of keys for each cell). A rule goes to every cell that its
interval meets: one or two for most, many only for a rule above much of the urls. A third of all urls may have one host, or
be one and the same url: paths divide the first, and a value that is several bounds at once is dealt over all their cells by
a hash. Rules of one host are held as a dictionary of paths, so a url costs a look-up for each distinct length of path.
Any number of rules goes this one way; neither table is collected or broadcast.

Null urls and urls without "://" have empty host and path, and no rule fits them. Rules whose host or verdict is null are
ignored, a null path is an empty one. Repeated rows each give a row. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
RULES = "verdict string, host string, path string"

def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def key_of(host: Column) -> Column:
    """The reversed labels, each with "/" behind it; the empty host's key is empty."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "/"), F.lit("/")))


class Sweep:
    """The hosts whose intervals are open, and their rules; rules and urls must come in the order of their keys."""

    def __init__(self, default: str):
        self.default = default
        self.stack: list[tuple[str, str, dict[str, str], list[int]]] = []  # key, host, verdicts by path, lengths of paths, longest first

    def _close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, host: str, path: str, verdict: str) -> None:
        self._close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, host, {}, []))
        _, _, verdicts, lengths = self.stack[-1]
        verdicts[path] = verdict
        at = bisect_left(lengths, -len(path), key=lambda n: -n)
        if at == len(lengths) or lengths[at] != len(path):
            lengths.insert(at, len(path))

    def judge(self, key: str, path: str) -> tuple[str | None, str]:
        self._close(key)
        best, rule, verdict = (-1, -1), None, self.default
        for _, host, verdicts, lengths in self.stack:
            for n in lengths:
                if n <= len(path) and (found := verdicts.get(path[:n])) is not None:
                    if (len(host) + n, len(host)) > best:
                        best, rule, verdict = (len(host) + n, len(host)), host + path[:n], found
                    break
        return rule, verdict


def _place(x: Column, bounds: list[str], upto: bool) -> Column:
    """How many of the sorted `bounds` are below `x` (`upto`: or equal to it), through a list of every so many of them."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    below = (lambda b: b <= x) if upto else (lambda b: b < x)
    fine = F.array(*(F.array(*map(F.lit, g)) for g in groups))
    first = F.size(F.filter(F.array(*(F.lit(g[0]) for g in groups)), below))
    return F.when(first == 0, 0).otherwise((first - 1) * step + F.size(F.filter(F.get(fine, first - 1), below)))


def _bounds(places: DataFrame, cells: int, each: int = 32, longest: int = 256) -> list[str]:
    """Bounds of `cells` cells from a draw of about `each` places a cell. They decide where rows go, not what they give."""
    n = places.count()
    if cells < 2 or not n:
        return []
    drawn = places.select(F.substring("at", 1, longest).alias("at"))
    drawn = sorted(r[0].encode() for r in drawn.sample(min(1.0, cells * each / n), 1).collect())
    return [drawn[len(drawn) * k // cells].decode() for k in range(1, cells)] if drawn else []


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow", cells: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of `pages` (page_id, url). Rules are (verdict, host, path). `cells`:
    as many as the session's shuffles have partitions."""
    spark = pages.sparkSession
    ship(spark)
    cells = cells or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.coalesce(F.col("url"), F.lit("")))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", key_of(F.col("host")))
    given = rules.select("verdict", "host", "path") if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), RULES)
    given = given.where("host is not null and verdict is not null").groupBy("host", F.coalesce("path", F.lit("")).alias("path")).agg(F.max("verdict").alias("verdict"))
    given = given.withColumn("key", F.concat(F.array_join(F.reverse(F.split("host", "\\.", -1)), "/"), F.lit("/")))

    urls = urls.withColumn("at", F.concat("key", F.lit("\0"), "path"))
    bounds = _bounds(urls.select("at").unionByName(given.select(F.col("key").alias("at"))), cells)
    low, high = _place(F.col("at"), bounds, False), _place(F.col("at"), bounds, True)
    urls = urls.select(F.struct(low.alias("low"), high.alias("high")).alias("c"), F.lit(1).alias("role"), "at", "key", "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    urls = urls.withColumn("cell", F.expr("c.low + cast(pmod(xxhash64(page_id, at), c.high - c.low + 1) as int)")).drop("c")
    # "0" comes right behind "/": the first key behind the rule's interval.
    beyond = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("0"))
    spans = F.sequence(_place(F.col("key"), bounds, False), _place(beyond, bounds, False))
    given = given.select(F.explode(spans).alias("cell"), F.lit(0).alias("role"), F.col("key").alias("at"), "key", F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict")
    both = urls.unionByName(given).repartitionById(len(bounds) + 1, F.col("cell")).sortWithinPartitions("at", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(default)
        for b in batches:
            at, names, verdicts = [], [], []
            columns = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("role", "key", "host", "path", "verdict"))
            for i, (role, key, host, path, verdict) in enumerate(zip(*columns, strict=True)):
                if not role:
                    sweep.open(key, host, path, verdict)
                    continue
                name, found = sweep.judge(key, path) if key else (None, default)
                at.append(i)
                names.append(name)
                verdicts.append(found)
            own = b.select(["page_id", "host", "path"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())], schema=SCHEMA)

    return both.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
