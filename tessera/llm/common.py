"""What the text operators share: table access, bounded caches, batches by characters, node names."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import local_folder, ship

#: Letters, numbers and white space of the first 256 code points, as the tokenizers' Unicode classes have them.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\t-\r \x85\xa0"
BEYOND_LATIN1 = re.compile("[^\x00-\xff]")
BEYOND_BMP = re.compile("[^\x00-\uffff]")

#: White space that separates words in the contracts: space and U+0009 to U+000D.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns))


def spread(df: DataFrame, worth: int = 8 << 20) -> DataFrame:
    """`df`, dealt anew if it has fewer partitions than the cluster has cores (a file of one row group gives one) and is worth it,
    in bytes. A table of many files is left as it is."""
    query, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if int(str(query.optimizedPlan().stats().sizeInBytes())) < worth or query.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one is set only where the session names none (tests on one machine)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        at = local_folder(spark.sparkContext)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: computed once, written to the shared folder, read again from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def likely(df: DataFrame, ids: DataFrame, key: str, bits: int = 1 << 24) -> DataFrame:
    """Rows of `df` whose `key` may be among `ids`: all that are, and few others while there are fewer ids than `bits`. An exact join
    has to follow; it shuffles less. What is broadcast is a bit for each hash, never more than `bits` of them."""
    place = F.xxhash64(F.col(key).cast("string")).bitwiseAND(F.lit(bits - 1)) + 1
    maps = ids.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("of")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
    held = df.select(F.struct(*df.columns).alias("row"), place.alias("at")).join(F.broadcast(maps), F.bitmap_bucket_number("at") == F.col("of"))
    bit = F.bitmap_bit_position("at")
    byte = F.conv(F.hex(F.substring("map", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return held.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select("row.*")


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what `cut` has written for frames that nothing reads any more, and let Spark's cleaner take away the shuffles
    behind them: it waits for the driver's garbage collection, which may not come for long."""
    for df in frames:
        at = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if at.isDefined():
            path = spark._jvm.org.apache.hadoop.fs.Path(at.get())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.java.lang.System.gc()


_used = 0.0


class BoundedCache:
    """A worker's memory of values by string, in two generations of at most `limit` entries (a long string counts for several):
    the older one is dropped when the younger is full, so memory stays bounded."""

    def __init__(self, compute: Callable[[list[str]], Iterable], limit: int = 200_000):
        self.young: dict = {}
        self.old: dict = {}
        self.compute, self.limit, self.size = compute, limit, 0

    def ready(self, keys: list[str]) -> dict:
        """A dictionary that holds every one of `keys`."""
        global _used
        _used = time.monotonic()
        missing = set(filterfalse(self.young.__contains__, keys))
        if missing:
            if self.size + self._weight(missing) > self.limit and self.young:
                self.old, self.young, self.size = self.young, {}, 0
                missing = set(keys)
            self.size += self._weight(missing)
            found = {k: self.old[k] for k in missing if k in self.old}
            self.young.update(found)
            if rest := [k for k in missing if k not in found]:
                self.young.update(zip(rest, self.compute(rest), strict=True))
        return self.young

    @staticmethod
    def _weight(keys: set) -> int:
        return len(keys) + sum(map(len, keys)) // 64

    def values(self, keys: list[str]) -> list:
        """The value of each of `keys`, by one look-up for each that is held."""
        out = list(map(self.young.get, keys))
        if at := [i for i, v in enumerate(out) if v is None]:
            held = self.ready([keys[i] for i in at])
            for i in at:
                out[i] = held[keys[i]]
        return out


_PER_PROCESS: dict = {}
_IDLE_SECONDS = 3.0


def once(key, make: Callable[[], object]):
    """A value made once in a Python worker and kept for its later tasks, until another is asked for: a stage has one, and what
    the stage before has left goes at once. A worker that has used none for `_IDLE_SECONDS` gives the memory back too: Spark lets
    idle workers live on beside the next stage's."""
    global _used
    _used = time.monotonic()
    if key in _PER_PROCESS:
        return _PER_PROCESS[key]
    if _PER_PROCESS:
        _drop_all()
    value = _PER_PROCESS[key] = make()
    if not any(t.name == "give-back" for t in threading.enumerate()):
        threading.Thread(target=_give_back, name="give-back", daemon=True).start()
    return value


def _give_back() -> None:
    while time.monotonic() - _used < _IDLE_SECONDS:
        time.sleep(_IDLE_SECONDS / 4)
    _drop_all()


def _drop_all() -> None:
    _PER_PROCESS.clear()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the batches, a few hundred at a time as Python objects, so a batch of long texts is never held twice."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(c.slice(at, 256).to_pylist() for c in columns), strict=True)


def chunks(items: Iterator[tuple], text_at: int = 1, chars: int = 1_000_000) -> Iterator[list[tuple]]:
    """Lists of whole rows with about `chars` characters of text; a longer text is a list of its own."""
    held, size = [], 0
    for item in items:
        n = len(item[text_at] or "") + 64
        if held and size + n > chars:
            yield held
            held, size = [], 0
        held.append(item)
        size += n
    if held:
        yield held


def ranked(least: Column, key: Column) -> Column:
    """A node's name that sorts by its least id (nulls last), then by its key: the smallest node of a component tells the
    component's smallest id, with no grouping by component."""
    sign = F.when(least.isNull(), "02").when(least < 0, "00").otherwise("01")
    return F.concat(F.unhex(F.concat(sign, F.lpad(F.hex(F.coalesce(least, F.lit(0))), 16, "0"))), key)


def least_of(node: Column) -> Column:
    """The least id in a node's name."""
    return F.when(F.hex(F.substring(node, 1, 1)) != "02", F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("long"))


#: Bytes before the key in a node's name.
RANK_BYTES = 9


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def arrow(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
