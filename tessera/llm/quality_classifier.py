"""Operator 7: a quality classifier by supervised subword embeddings.

A word's features are itself and its character n-grams, hashed to a table of learned vectors. A document is the average
of all its words' features' vectors; a softmax layer gives the classes. Vectors and layer are one model, trained on every
labelled row at once: workers read the rows' features (written once, in blocks of about `PIECE`) in some twenty passes, each of
which gives the loss and its gradient over all rows, and the driver takes a step by L-BFGS. So how rows are dealt to parts (by
a hash of the id, about `sample_rows` each) and blocks decides nothing, nor do parts with one class only. A worker has a block
at a time; the driver gets one sum a pass. Everything is seeded and sums are exact, so a table gives the same model each time.

Averaging and the layer are linear, so a word adds a fixed number to the log odds: workers keep that number and the
feature count of each word in a bounded cache, and score whole texts with one look-up a word.

Null texts and texts without words have no features: their score comes from the bias alone. Rows whose label is null are
not learned from. With no labelled rows, or of one class only, the bias is that class's smoothed share and nothing else is
learned. Repeated rows each give a row. Other columns (labels, lang, source) are never inputs of a score.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.common import BoundedCache, arrow, cut, forget, likely, mix, once, rows, ship

#: Features of documents that a worker holds at once to learn from.
PIECE = 500_000
#: Numbers of a gradient that travel in one row, the fixed point in which they are summed, and what the loss is divided by there.
SLICE = 4_096
POINT = 1 << 32
LOSS = 4_096
#: Steps that L-BFGS remembers, and trials for the length of one.
MEMORY, TRIALS = 8, 10
#: Units of the vectors and of the layer: how far a step moves them.
VECTOR_UNIT, LAYER_UNIT = 16.0, 0.1


@dataclass(frozen=True)
class Parameters:
    buckets: int = 1 << 16
    dim: int = 8
    shortest: int = 2
    longest: int = 4
    sample_rows: int = 4_000
    steps: int = 16
    ridge: float = 0.3
    seed: int = 7


def features(words: list[bytes], p: Parameters) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words, in their order, and how many each word has: the word itself, and the n-grams of its characters
    between marks. All words of a call are hashed together, as arrays of code points."""
    marked = [f"<{w.decode()}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    c = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner, ends = np.repeat(np.arange(len(marked)), lengths), np.repeat(np.cumsum(lengths), lengths)
    places = np.arange(len(c))
    owners = [np.arange(len(marked))]
    hashes = [np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))]
    h = c
    for n in range(1, p.longest + 1):
        if n > 1:
            h = mix(h[:-1]) + c[n - 1 :]
        if n >= p.shortest:
            inside = places[: len(h)] + n <= ends[: len(h)]
            owners.append(owner[: len(h)][inside])
            hashes.append(mix(h[inside] ^ np.uint64(n << 32)))
    of, ids = np.concatenate(owners), (np.concatenate(hashes) % np.uint64(p.buckets)).astype(np.int64)
    return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


class Model:
    """Feature vectors and the softmax layer of two classes."""

    def __init__(self, p: Parameters):
        rng = np.random.default_rng(p.seed)
        self.p = p
        self.vectors = rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim))
        self.layer = np.zeros((p.dim, 2))
        self.bias = np.zeros(2)

    def train(self, classes: np.ndarray, loss: Callable[[np.ndarray, float], tuple[float, np.ndarray, float]]) -> Model:
        """classes: the numbers of documents of each. loss: the mean loss of all of them for some odds, and its gradient by
        features and by the bias."""
        self.bias = np.log((classes + 1.0) / (classes.sum() + 2.0))
        if not classes.all():
            return self
        p, size, ridge = self.p, self.vectors.size, self.p.ridge / classes.sum()
        unit = np.repeat([VECTOR_UNIT, LAYER_UNIT, 1.0], [size, p.dim, 1])
        start = np.concatenate((self.vectors.ravel(), np.resize([1.0, -1.0], p.dim), [self.bias[1] - self.bias[0]])) / unit

        def value(x: np.ndarray) -> tuple[float, np.ndarray]:
            vectors, layer, bias = np.split(x * unit, [size, size + p.dim])
            vectors = vectors.reshape(-1, p.dim)
            mean, by_feature, by_bias = loss(vectors @ layer, float(bias[0]))
            moved = np.where(np.arange(len(x)) < size, x - start, 0.0)
            slope = np.concatenate((np.outer(by_feature, layer).ravel(), by_feature @ vectors, [by_bias]))
            return mean + ridge / 2 * float(moved @ moved), slope * unit + ridge * moved

        *_, layer, bias = np.split(found := lbfgs(value, start, p.steps) * unit, [size, size + p.dim])
        self.vectors = found[:size].reshape(-1, p.dim)
        self.layer = np.outer(layer, [-0.5, 0.5])
        self.bias = bias * [-0.5, 0.5]
        return self

    def odds(self) -> tuple[np.ndarray, float]:
        """What each feature adds to the log odds of class 1, before averaging, and the bias."""
        return self.vectors @ (self.layer[:, 1] - self.layer[:, 0]), float(self.bias[1] - self.bias[0])


def lbfgs(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int) -> np.ndarray:
    """Where `value` (with its gradient) is less than at `x`, after at most so many steps of L-BFGS with halved trial lengths."""
    held: deque = deque(maxlen=MEMORY)
    now, g = value(x)
    for _ in range(steps):
        if not np.linalg.norm(g) > 1e-7:
            break
        d, shares = -g, []
        for s, y in reversed(held):
            shares.append(s @ d / (s @ y))
            d = d - shares[-1] * y
        d = d * (held[-1][0] @ held[-1][1] / (held[-1][1] @ held[-1][1]) if held else 1 / np.linalg.norm(g))
        for (s, y), share in zip(held, reversed(shares), strict=True):
            d = d + s * (share - y @ d / (s @ y))
        for trial in range(TRIALS):
            step = 0.5**trial * d
            then, slope = value(x + step)
            if then <= now + 1e-4 * float(g @ step):
                break
        else:
            break
        if step @ (slope - g) > 1e-12:
            held.append((step, slope - g))
        x, now, g = x + step, then, slope
    return x


class Scorer:
    """Scores texts in one worker."""

    def __init__(self, odds: np.ndarray, bias: float, p: Parameters, cache: int = 150_000):
        self.odds, self.bias, self.p = odds, bias, p
        self.words = BoundedCache(self._words, cache)

    def _words(self, words: list[bytes]) -> list[complex]:
        """The sum over a word's features, and their number as the imaginary part."""
        out: list[complex] = []
        for k in range(0, len(words), 20_000):
            ids, counts = features(words[k : k + 20_000], self.p)
            out += (np.add.reduceat(self.odds[ids], np.cumsum(counts) - counts) + 1j * counts).tolist()
        return out

    def score(self, text: str | None) -> float:
        words = words_of(text)
        total = complex(np.fromiter(map(self.words.ready(words).__getitem__, words), np.complex128, len(words)).sum()) if words else 0j
        z = self.bias + (total.real / total.imag if total.imag else 0.0)
        return float(1 / (1 + np.exp(-z))) if z > -500 else 0.0


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _block(held: list[tuple]) -> list[bytes]:
    """Documents (class, feature ids in rising order, their counts) as bytes: numbers of features, classes, the ids' distances and
    the counts. A count above 255 is that of several features of one id, a distance from 255 takes several bytes."""
    parts = [-(n // -255) for _, _, n in held]
    ids = [np.repeat(i, k) for (_, i, _), k in zip(held, parts, strict=True)]
    counts = np.full(sum(map(len, ids)), 255, np.uint8)
    every, n = np.concatenate(parts), np.concatenate([n for *_, n in held])
    counts[np.cumsum(every) - 1] = n - 255 * (every - 1)
    gaps = np.concatenate([np.diff(i, prepend=0) for i in ids])
    more = gaps // 255
    coded = np.full(len(gaps) + int(more.sum()), 255, np.uint8)
    coded[np.cumsum(more + 1) - 1] = gaps % 255
    return [np.array(list(map(len, ids)), "<i4").tobytes(), bytes(c for c, *_ in held), coded.tobytes(), counts.tobytes()]


def _documents(lengths: bytes, classes: bytes, gaps: bytes, counts: bytes) -> tuple[np.ndarray, ...]:
    """What `_block` has made bytes of: numbers of features, classes, ids and counts."""
    n, coded = np.frombuffer(lengths, "<i4").astype(np.int64), np.frombuffer(gaps, np.uint8)
    ids = np.cumsum(coded, dtype=np.int64)[coded != 255]
    ids -= np.repeat(np.append(0, ids[np.cumsum(n)[:-1] - 1]), n)
    return n, np.frombuffer(classes, np.uint8), ids, np.frombuffer(counts, np.uint8).astype(np.float64)


def _loss(block: tuple[np.ndarray, ...], odds: np.ndarray, bias: float) -> np.ndarray:
    """Of a block's documents: the gradient of the loss by each feature's odds and by the bias, and the loss, in fixed point."""
    lengths, classes, ids, counts = block
    starts = np.cumsum(lengths) - lengths
    total = np.add.reduceat(counts, starts)
    z = np.add.reduceat(odds[ids] * counts, starts) / total + bias
    wrong = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - classes
    by_feature = np.bincount(ids, weights=counts * np.repeat(wrong / total, lengths), minlength=len(odds))
    loss = (np.logaddexp(0, z) - classes * z).sum() / LOSS
    return np.rint(np.append(by_feature, (wrong.sum(), loss)) * POINT).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, p: Parameters = Parameters(), piece: int = PIECE) -> Model:  # noqa: B008
    """A model of all `labels` (doc_id, quality) over `docs` (doc_id, text). Labelled texts, and few others, are shuffled once, and
    their features written once; a pass over these sends each task `p.buckets` numbers, and the driver as many."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").cast("int").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    parts = max(1, math.ceil(known.count() / p.sample_rows))
    texts = likely(docs.select("doc_id", "text").where(~held_out(F.col("doc_id"))), known, "doc_id")
    both = texts.withColumn("quality", F.lit(None).cast("int")).unionByName(known.withColumn("text", F.lit(None).cast("string")))
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(parts)).cast("int")
    # A document's labels come before its texts.
    dealt = both.withColumn("part", part).repartitionById(parts, "part").sortWithinPartitions("doc_id", F.col("quality").asc_nulls_last(), "text")
    names = ["lengths", "classes", "gaps", "counts"]
    written = pa.schema([("bad", pa.int64()), ("good", pa.int64()), *((n, pa.binary()) for n in names)])
    summed = pa.schema([("slice", pa.int32()), ("sums", pa.list_(pa.int64()))])

    def block(held: list[tuple]) -> pa.RecordBatch:
        good = sum(q for q, *_ in held)
        return arrow(written, [[x] for x in (len(held) - good, good, *_block(held))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now, classes = [], 0, None, []
        for doc_id, text, quality in rows(batches, "doc_id", "text", "quality"):
            if doc_id != now:
                now, classes = doc_id, []
            if quality is not None:
                classes.append(quality)
            elif classes and (words := Counter(words_of(text))):
                ids, counts = features(list(words), p)
                total = np.bincount(ids, weights=np.repeat(np.fromiter(words.values(), np.int64), counts), minlength=p.buckets).astype(np.int64)
                found = np.flatnonzero(total)
                held += [(q, found, total[found]) for q in classes]
                size += len(found)
                if size > piece:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for k, values in rows(batches, "slice", "sums"):
            sums[k] = sums.get(k, 0) + np.array(values, np.int64)
        yield arrow(summed, [list(sums), list(sums.values())])

    blocks = cut(dealt.mapInArrow(write, "bad long, good long, lengths binary, classes binary, gaps binary, counts binary"))
    classes = np.array(blocks.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first(), np.int64)
    read = blocks.select(*names).coalesce(spark.sparkContext.defaultParallelism)

    def loss(odds: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        given = spark.sparkContext.broadcast((odds.tobytes(), bias))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = np.frombuffer(given.value[0]), given.value[1]
            sums = np.zeros(p.buckets + 2, np.int64)
            for b in batches:
                for k in range(b.num_rows):
                    sums += _loss(_documents(*(c[k].as_buffer() for c in b.columns)), *at)
            pieces = np.split(sums, range(SLICE, len(sums), SLICE))
            yield arrow(summed, [range(len(pieces)), pieces])

        of = "slice int, sums array<long>"
        found = dict(read.mapInArrow(run, of).repartition("slice").mapInArrow(add, of).collect())
        given.destroy()
        sums = np.concatenate([found[k] for k in sorted(found)]) / (float(POINT) * classes.sum())
        return float(sums[-1]) * LOSS, sums[:-2], float(sums[-2])

    try:
        return Model(p).train(classes, loss)
    finally:
        forget(spark, blocks)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs` (doc_id, text)."""
    scored, name = _scored(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` with a score of at least `threshold`, with all their columns, whatever they are called."""
    scored, name = _scored(docs, model)
    return scored.where(F.col(name) >= threshold).drop(name)


def _scored(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """`docs` with the score in a column of a name that none of its own has, and that name."""
    ship(docs.sparkSession)
    name, taken = "score", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    odds, bias = model.odds()
    given = docs.sparkSession.sparkContext.broadcast((odds.tobytes(), bias, model.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, bias, p = given.value
        scorer = once(("quality", hash(data), bias, p), lambda: Scorer(np.frombuffer(data), bias, p))
        for b in batches:
            scores = [scorer.score(t) for (t,) in rows(iter([b]), "text")]
            yield b.append_column(name, pa.array(scores, pa.float64()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())])), name
