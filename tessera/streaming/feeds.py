"""Declared feeds: newline-delimited JSON bound to declared columns without coercion; what does not fit is quarantined whole.

The binding is one projection: the record as a map of raw JSON values, a check for each column, the first failure's code.
The same projection serves batches and streams. A stream writes good rows and quarantined rows in foreachBatch, each as a
versioned commit named after the micro-batch, so a batch that runs again changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import Refused
from tessera.sources.warehouse import Warehouse

KINDS = {"string": r'^".*"$', "int": r"^-?[0-9]+$", "bigint": r"^-?[0-9]+$", "double": r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$", "boolean": "^(true|false)$", "date": r'^"[0-9]{4}-[0-9]{2}-[0-9]{2}"$', "timestamp": r'^"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+Z?"$', "decimal": r'^"-?[0-9]+(\.[0-9]+)?"$'}


@dataclass(frozen=True)
class FeedColumn:
    name: str
    kind: str
    nullable: bool = True
    key: str | None = None

    @property
    def source(self) -> str:
        return self.key or self.name


@dataclass(frozen=True)
class Feed:
    name: str
    columns: tuple[FeedColumn, ...]
    unknown_keys: str = "refuse"  # or "ignore"
    missing_keys: str = "refuse"  # or "null"
    stop_above: float = 0.5
    window: int = 1000

    def __post_init__(self) -> None:
        bad = [c.name for c in self.columns if c.kind.split("(")[0] not in KINDS]
        if bad or len({c.name for c in self.columns}) < len(self.columns):
            raise Refused(f"feed {self.name!r}: columns {bad or 'repeat'}")

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def bind(feed: Feed, lines: DataFrame, line: str = "value") -> DataFrame:
    """Each line with `reason_code` and `reason` (null if it fits) and the declared columns (null if it does not)."""
    raw = F.try_variant_get(F.try_parse_json(line), F.lit("$"), "map<string,variant>") if hasattr(F, "try_variant_get") and isinstance(line, Column) else F.expr(f"try_variant_get(try_parse_json({line}), '$', 'map<string,variant>')")
    df = lines.withColumn("_m", F.transform_values(raw, lambda k, v: F.to_json(v)))
    code = F.when(F.col("_m").isNull(), F.lit("not_an_object|the line is no JSON object"))
    names = [c.source for c in feed.columns]
    if feed.unknown_keys == "refuse":
        extra = F.array_except(F.map_keys("_m"), F.array(*map(F.lit, names)))
        code = code.when(F.size(extra) > 0, F.concat(F.lit("unknown_key|"), F.array_join(extra, ",")))
    values = []
    for c in feed.columns:
        v, base = F.col("_m")[c.source], c.kind.split("(")[0]
        if feed.missing_keys == "refuse":
            code = code.when(~F.map_contains_key("_m", c.source), F.lit(f"missing_key|{c.source}"))
        null = v.isNull() | (v == "null")
        if not c.nullable:
            code = code.when(null, F.lit(f"null_value|{c.source}"))
        code = code.when(~null & ~v.rlike(KINDS[base]), F.concat(F.lit(f"wrong_type|{c.source} is {c.kind}, not "), v))
        text = F.from_json(F.concat(F.lit('{"v":'), v, F.lit("}")), "v string")["v"]
        cast = (text if base in ("string", "date", "timestamp", "decimal") else v).try_cast(c.kind)
        value = F.when(~null, cast)
        code = code.when(~null & cast.isNull(), F.concat(F.lit(f"out_of_range|{c.source} = "), v))
        values.append((c.name, value))
    df = df.withColumn("_c", code)
    out = [F.when(F.col("_c").isNull(), v).alias(n) for n, v in values]
    parts = F.split("_c", "\\|", 2)
    return df.select(F.col(line).alias("payload"), *(c for c in lines.columns if c != line), F.get(parts, 0).alias("reason_code"), F.get(parts, 1).alias("reason"), *out)


def split(feed: Feed, bound: DataFrame, source: str, position: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that fit, and the quarantine's rows."""
    good = bound.where("reason_code is null").select(*(c.name for c in feed.columns))
    bad = bound.where("reason_code is not null").select(F.lit(feed.name).alias("feed"), F.lit(source).alias("source"), (position if position is not None else F.lit(None)).cast("string").alias("position"), "reason_code", "reason", "payload", F.lit(feed.fingerprint()).alias("declaration"))
    return good, bad


def should_stop(feed: Feed, good: int, bad: int) -> str | None:
    """Why the feed halts after a batch, or None."""
    if good + bad == 0:
        return None
    if good == 0:
        return "nothing in the batch was usable"
    if bad / (good + bad) > feed.stop_above:
        return f"{bad} of {good + bad} records were bad"
    return None


def run(spark: SparkSession, feed: Feed, path: str, warehouse: Warehouse, table: str, checkpoint: str, quarantine: str = "sys.quarantine", looked_at: int | None = None):
    """A stream over a folder of files that ends when all that is there has been read (its position survives). `looked_at`: a
    batch at which the feed has stopped and which is to be taken all the same; the stop rule holds again behind it."""
    lines = spark.readStream.text(path).select("value", F.col("_metadata.file_name").alias("_file"))

    def batch(df: DataFrame, number: int) -> None:
        bound = bind(feed, df).persist()
        try:
            good, bad = split(feed, bound, path, F.col("_file"))
            counts = bound.agg(F.count_if(F.col("reason_code").isNull()).alias("g"), F.count_if(F.col("reason_code").isNotNull()).alias("b")).first()
            if counts["b"]:
                warehouse.publish(quarantine, bad, txn=(f"{feed.name}/bad", number))
            if (why := should_stop(feed, counts["g"], counts["b"])) and number != looked_at:
                raise Refused(f"feed {feed.name!r} stopped at batch {number}: {why}")
            if counts["g"]:
                warehouse.publish(table, good, txn=(f"{feed.name}/good", number))
        finally:
            bound.unpersist()

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Feeds:
    """The feeds of a warehouse: declarations, where each stands, and what it has taken. Their states lie beside the tables, so
    they outlive a session: declared, running, done, or stopped at a batch with a reason until someone resumes them."""

    def __init__(self, warehouse: Warehouse):
        self.warehouse, self.root = warehouse, f"{warehouse.root}/_feeds"

    def declare(self, feed: Feed, path: str, table: str) -> None:
        if feed.name in self.states():
            raise Refused(f"feed {feed.name!r} is there already")
        self._write(feed.name, {"feed": asdict(feed), "path": path, "table": table, "state": "declared", "reason": None, "batch": None})

    def states(self) -> dict[str, dict]:
        store = self.warehouse.store
        return {n[:-5]: json.loads(store.read(f"{self.root}/{n}")) for n in store.names(self.root) if n.endswith(".json")}

    def _write(self, name: str, state: dict) -> None:
        self.warehouse.store.replace(f"{self.root}/{name}.json", json.dumps(state))

    def _of(self, name: str) -> dict:
        if (state := self.states().get(name)) is None:
            raise Refused(f"no feed {name!r}")
        return state

    def run(self, name: str, looked_at: int | None = None) -> str:
        """Take what is there; the feed's state afterwards. A feed that has stopped is only resumed."""
        s = self._of(name)
        if s["state"] == "stopped" and looked_at is None:
            raise Refused(f"feed {name!r} has stopped: {s['reason']}")
        feed = Feed(**s["feed"] | {"columns": tuple(FeedColumn(**c) for c in s["feed"]["columns"])})
        self._write(name, s | {"state": "running", "reason": None, "batch": None})
        try:
            run(self.warehouse.spark, feed, s["path"], self.warehouse, s["table"], f"{self.root}/{name}-position", looked_at=looked_at).awaitTermination()
        except Exception as e:
            found = re.search(r"stopped at batch (\d+): ([^\n]*)", str(e))
            self._write(name, s | {"state": "stopped", "reason": found[2] if found else str(e).splitlines()[0][:300], "batch": int(found[1]) if found else None})
            if not found:
                raise
            return "stopped"
        self._write(name, s | {"state": "done", "reason": None, "batch": None})
        return "done"

    def resume(self, name: str) -> str:
        """Go on behind a stop: the batch it stopped at is taken as it is, its bad records in quarantine."""
        s = self._of(name)
        if s["state"] != "stopped":
            raise Refused(f"feed {name!r} has not stopped")
        return self.run(name, s["batch"] if s["batch"] is not None else -1)

    def show(self) -> DataFrame:
        """feed, state, reason, target, rows taken and rows in quarantine."""
        out = []
        w = self.warehouse
        for name, s in sorted(self.states().items()):
            taken = sum(f["rows"] for f in w.state(s["table"])["files"].values()) if w.version(s["table"]) >= 0 else 0
            bad = w.table("sys.quarantine").where(F.col("feed") == name).count() if w.version("sys.quarantine") >= 0 else 0
            out.append((name, s["state"], s["reason"], s["table"], taken, bad))
        return w.spark.createDataFrame(out, "feed string, state string, reason string, target string, target_rows long, quarantined long")


def first_load(rows: DataFrame, warehouse: Warehouse, table: str, key: list[str], position: int) -> int:
    """The state of a source as of a position, as the first rows of a keyed table. `apply_changes` goes on right behind it."""
    if warehouse.version(table) >= 0:
        raise Refused(f"{table!r} is there already")
    return warehouse.publish(table, rows.withColumns({"commit_pos": F.lit(position).cast("long"), "op": F.lit("I")}), key=key, txn=(f"{table}/loaded", position))


def apply_changes(changes: DataFrame, warehouse: Warehouse, table: str, key: list[str], checkpoint: str, kept_from: int = 0, every: str | None = None):
    """A stream of change rows (key, columns, commit_pos, op) appended to a keyed table; reads show the latest of each key.
    Replays are harmless: a batch commits once, and repeated rows have equal positions. After a `first_load` changes up to its
    position are left out, since it holds them; a stream that keeps changes only `kept_from` a later one would leave a gap and
    is refused. `every`: flush so often and go on, instead of ending with what is there (the source's own options bound how
    much a flush takes)."""
    loaded = warehouse.state(table)["txns"].get(f"{table}/loaded") if warehouse.version(table) >= 0 else None
    if loaded is not None and kept_from > loaded + 1:
        raise Refused(f"positions {loaded + 1} to {kept_from - 1} are neither in the first load nor in the stream")

    def batch(df: DataFrame, number: int) -> None:
        df = df if loaded is None else df.where(F.col("commit_pos") > loaded)
        if not df.isEmpty():
            warehouse.publish(table, df, key=key, txn=(f"{table}/changes", number))

    stream = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()


def sealed(rows: DataFrame, xid: str = "xid") -> DataFrame:
    """Change rows of the transactions that have committed (a row with op "COMMIT"), at the commit's position and in their
    own order within it (`seq`). Transactions that are open or aborted (op "ABORT") give nothing."""
    ends = rows.where("op in ('COMMIT', 'ABORT')").groupBy(xid).agg(F.min(F.when(F.col("op") == "COMMIT", F.col("commit_pos"))).alias("_at"), F.count_if(F.col("op") == "ABORT").alias("_no"))
    done = ends.where("_at is not null and _no = 0").select(xid, "_at")
    return rows.where("op not in ('COMMIT', 'ABORT', 'BEGIN')").join(done, xid).withColumn("seq", F.col("commit_pos")).withColumn("commit_pos", F.col("_at")).drop("_at")


def fill_unchanged(changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Updates carry only what changed: other columns (null in an update) take the key's last value, up to its last delete."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*key).orderBy("commit_pos").rowsBetween(W.unboundedPreceding, 0)
    life = changes.withColumn("_life", F.sum(F.when(F.col("op") == "D", 1).otherwise(0)).over(w))
    v = W.partitionBy(*key, "_life").orderBy("commit_pos").rowsBetween(W.unboundedPreceding, 0)
    return life.select(*(F.when(F.col("op") == "U", F.last(c, ignorenulls=True).over(v)).otherwise(F.col(c)).alias(c) if c in columns else c for c in changes.columns))


def windowed(events: DataFrame, width: str, lateness: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Counts and sums in event-time windows, late rows beyond `lateness` left out; for streams and batches."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", lateness).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, lateness: str, by: list[str]) -> DataFrame:
    """Counts in sessions that end after a gap."""
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def digest(df: DataFrame) -> DataFrame:
    """Rows and an order-insensitive digest, to reconcile a copy with its origin."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("total"))
