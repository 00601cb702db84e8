"""Operator 3: near-duplicate vectors by an exact metric range join.

Cosine of at least c between two vectors is a Euclidean distance of at most r = sqrt(2 - 2c) between their unit vectors.
Pivots (vectors drawn by hash) partition the unit vectors into cells, each vector at home with its nearest pivot. A vector
is also sent to every cell that could hold a home vector within r of it: by the triangle inequality its distance to that
cell's pivot exceeds the distance to its own by at most 2r, and exceeds the cell's covering radius by at most r (the
bisecting plane of the two pivots bounds it more closely still). So a link between vectors of two homes could be seen in
both; of each two cells only one sends to the other (turn and turn about, so none is favoured), and each link is seen once.
Cells join independently: a cell is cut into blocks of bounded size, which compare single-precision products first and
decide all that are near the threshold in double precision. Vectors that single precision holds exactly travel as such.

A block returns for each home vector the number of vectors linked with it, and edges of a spanning forest of its links,
never the pairs. Vectors with the same components are one class from the start, counted with their number.

Null vectors, those with null or non-finite components and zero vectors are linked with nothing and are their own
component. Rows with a null vec_id are returned with their class's figures. Vectors of
different lengths are never linked. Repeated vec_ids are vectors of their own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow, cut, least_of, ranked, rows, ship
from tessera.operators.components import connected_components

BAND = 1e-4  # single precision decides outside of it


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrices(b: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a batch that can be compared, as one matrix for each length, and their rows' places. Vectors whose
    squares would overflow or vanish are scaled first."""
    column = b.column(b.schema.get_field_index(name))
    values = pa.compute.cast(column.values, pa.float64()).to_numpy(zero_copy_only=False)
    begins, sizes = column.offsets.to_numpy()[:-1], np.diff(column.offsets.to_numpy())
    there = column.is_valid().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[there]).tolist():
        if not n:
            continue
        at = np.flatnonzero(there & (sizes == n))
        x = values[begins[at][:, None] + np.arange(n)]  # null elements are not numbers here
        fine = np.isfinite(x).all(axis=1)
        at, x = at[fine], x[fine]
        with np.errstate(over="ignore"):
            norm = np.linalg.norm(x, axis=1)
        largest = np.abs(x).max(axis=1, initial=0)
        at, x, norm, largest = (v[largest > 0] for v in (at, x, norm, largest))
        odd = ~np.isfinite(norm) | (norm < 1e-150)
        x[odd] /= largest[odd][:, None]
        yield at, x + 0.0


def _classes(vectors: DataFrame) -> DataFrame:
    """vec_id, the key of the class of equal vectors (null: linked with nothing), and the vector's numbers: as singles where
    these hold them exactly."""
    schema = pa.schema([("vec_id", pa.int64()), ("key", pa.binary()), ("dim", pa.int32()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: list = [None] * b.num_rows
            dims, vecs = keys.copy(), keys.copy()
            for at, x in _matrices(b, "embedding"):
                small = x.astype(np.float32)
                exact = (small == x).all(axis=1)
                for k, i in enumerate(at.tolist()):
                    data = x[k].tobytes()
                    keys[i], dims[i], vecs[i] = xxhash.xxh3_128_digest(data), x.shape[1], small[k].tobytes() if exact[k] else data
            yield arrow(schema, [b.column(b.schema.get_field_index("vec_id")).to_pylist(), keys, dims, vecs])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, key binary, dim int, vec binary")


def _numbers(data: list[bytes], dim: int) -> np.ndarray:
    """Vectors that have travelled as singles or doubles, in double precision."""
    out = np.empty((len(data), dim))
    single = np.fromiter((len(d) == 4 * dim for d in data), bool, len(data))
    for which, kind in ((single, np.float32), (~single, np.float64)):
        out[which] = np.frombuffer(b"".join(d for d, w in zip(data, which.tolist(), strict=True) if w), kind).reshape(-1, dim)
    return out


def _by_dim(b: pa.RecordBatch, each: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and unit vectors of at most `each` rows of a batch."""
    dims = b.column(b.schema.get_field_index("dim")).to_numpy()
    data = b.column(b.schema.get_field_index("vec"))
    for dim in np.unique(dims).tolist():
        rows_ = np.flatnonzero(dims == dim)
        for k in range(0, len(rows_), each):
            some = rows_[k : k + each]
            yield dim, some, _unit(_numbers(data.take(pa.array(some)).to_pylist(), dim))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def _assign(reps: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Home cell of every class and its distance to the home pivot."""
    given = reps.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home, d = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for dim, some, x in _by_dim(b, 512):
                if (p := given.value.get(dim)) is not None:
                    far = _apart(x, p)
                    home[some], d[some] = far.argmin(axis=1), far.min(axis=1)
            yield b.append_column("home", pa.array(home)).append_column("d", pa.array(d))

    return reps.mapInArrow(run, "key binary, w long, dim int, vec binary, home int, d double")


def _sent(cells: DataFrame, pivots: dict[int, np.ndarray], radius: dict[tuple[int, int], float], r: float) -> DataFrame:
    """The cells that each class goes to, its home among them."""
    cover = {dim: np.array([radius.get((dim, j), -1.0) for j in range(len(p))]) for dim, p in pivots.items()}
    given = cells.sparkSession.sparkContext.broadcast((pivots, cover))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, cover = given.value
        e = 1e-6  # rounding
        for b in batches:
            homes = b.column(b.schema.get_field_index("home")).to_numpy()
            counts, parts = np.ones(b.num_rows, np.int64), [(np.arange(b.num_rows), homes)]
            for dim, some, x in _by_dim(b, 512):
                if (p := pivots.get(dim)) is None:
                    continue
                own = homes[some]
                far = _apart(x, p)
                near = far[np.arange(len(some)), own][:, None]
                go = (cover[dim] >= 0) & (far - near <= 2 * r + e) & (far <= cover[dim] + r + e)
                go &= far * far - near * near <= 2 * _apart(p[own], p) * (r + e) + e
                others = np.arange(len(p))
                go &= np.where((others + own[:, None]) % 2 == 1, others < own[:, None], others > own[:, None])  # never the own
                i, j = np.nonzero(go)
                parts.append((some[i], j))
                counts[some] += go.sum(axis=1)
            of, to = (np.concatenate(v) for v in zip(*parts, strict=True))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(to[np.argsort(of, kind="stable")].astype(np.int32)))
            yield b.append_column("cells", lists)

    return cells.mapInArrow(run, "key binary, w long, dim int, vec binary, home int, cells array<int>")


def _join(x: list, y: list, dim: int, cos: float) -> tuple[list, list]:
    """(key, linked weight) of the rows with links, and forest edges. Rows: key, weight, numbers, whether it is at home here.
    A visitor's links are counted here for both ends, as its own cell does not see them."""
    ua, ub = (_unit(_numbers([r[2] for r in rows_], dim)) for rows_ in (x, y))
    wa, wb = np.array([r[1] for r in x], np.int64), np.array([r[1] for r in y], np.int64)
    visits = ~np.array([r[3] for r in y])
    place = {r[0]: j for j, r in enumerate(y)}
    a32, b32 = ua.astype(np.float32), ub.astype(np.float32).T
    label = np.arange(len(x) + len(y))
    touched = np.zeros(len(label), bool)
    counts, back = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    for at in range(0, len(x), 512):
        s = a32[at : at + 512] @ b32
        linked = s > cos + BAND
        for i, j in np.argwhere((s >= cos - BAND) & ~linked):
            linked[i, j] = float(np.dot(ua[at + i], ub[j])) >= cos
        for i in np.flatnonzero(linked.any(axis=1)).tolist():
            js = np.flatnonzero(linked[i])
            me = place.get(x[at + i][0])
            js = js[js != me] if me is not None else js
            if not len(js):
                continue
            counts[at + i] = wb[js].sum()
            back[js[visits[js]]] += wa[at + i]
            nodes = np.append(js + len(x), at + i)
            touched[nodes] = True
            if len(found := np.unique(label[nodes])) > 1:
                label[np.isin(label, found)] = found[0]
    keys = [r[0] for r in x] + [r[0] for r in y]
    edges = [(keys[n], keys[label[n]]) for n in np.flatnonzero(touched & (label != np.arange(len(label)))).tolist()]
    return [(r[0], int(c)) for rows_, found in ((x, counts), (y, back)) for r, c in zip(rows_, found, strict=True) if c], edges


def components(vectors: DataFrame, cos: float = 0.95, cell: int = 8192, block: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of `vectors` (vec_id, embedding). A block has at most `block` rows
    a side, fewer if vectors have over 512 numbers. There is a pivot for every `cell` classes, but no more than the root of
    their number: all pivots are sent to every task, and every class is compared with each."""
    ship(vectors.sparkSession)
    r = float(np.sqrt(2 - 2 * cos))
    base = cut(_classes(vectors))
    reps = cut(base.where("key is not null").groupBy("key").agg(F.count("*").alias("w"), F.min("vec_id").alias("least"), F.first("dim").alias("dim"), F.first("vec").alias("vec")).select(F.col("key").alias("class"), ranked(F.col("least"), F.col("key")).alias("key"), "w", "dim", "vec"))
    n = reps.count()
    wanted = max(1, min(-(-n // cell), int(n**0.5)))
    pivots: dict[int, list] = {}
    for row in reps.select("dim", "vec", "class").orderBy("class").limit(wanted).collect():  # classes are hashes: a uniform draw
        pivots.setdefault(row["dim"], []).append(bytes(row["vec"]))
    points = {k: _unit(_numbers(v, k)) for k, v in pivots.items()}
    cells = cut(_assign(reps.select("key", "w", "dim", "vec"), points))
    radius = {(x["dim"], x["home"]): x["d"] for x in cells.groupBy("dim", "home").agg(F.max("d").alias("d")).collect()}  # a row for each cell
    sent = cut(_sent(cells.drop("d"), points, radius, r))

    # Blocks: home rows of a cell against all its rows.
    side = F.least(F.lit(block), F.ceil(512 * block / F.col("dim")))
    at_home = sent.groupBy("dim", F.col("home").alias("cell")).agg(F.ceil(F.count("*") / side).cast("int").alias("nx"))
    spread = sent.select("key", "w", "dim", "vec", "home", F.explode("cells").alias("cell"))
    sizes = at_home.join(sent.select("dim", F.explode("cells").alias("cell")).groupBy("dim", "cell").agg(F.ceil(F.count("*") / side).cast("int").alias("ny")), ["dim", "cell"])
    h = F.abs(F.hash("key").cast("long"))
    x = sent.withColumnRenamed("home", "cell").join(sizes, ["dim", "cell"]).select("dim", "cell", (h % F.col("nx")).cast("int").alias("bx"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("by"), F.lit(0).alias("role"), "key", "w", "vec", F.lit(True).alias("own"))
    y = spread.join(sizes, ["dim", "cell"]).select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("bx"), (h % F.col("ny")).cast("int").alias("by"), F.lit(1).alias("role"), "key", "w", "vec", (F.col("home") == F.col("cell")).alias("own"))
    both = x.unionByName(y).repartition("dim", "cell", "bx", "by").sortWithinPartitions("dim", "cell", "bx", "by", "role")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])

        def solved() -> Iterator[pa.RecordBatch]:
            if sides[0] and sides[1]:
                counts, edges = _join(*sides, at[0], cos)
                out = [(k, None, c) for k, c in counts] + [(a, b, None) for a, b in edges]
                if out:
                    yield arrow(schema, list(zip(*out, strict=True)))

        for dim, c, bx, by, role, key, w, vec, own in rows(batches, "dim", "cell", "bx", "by", "role", "key", "w", "vec", "own"):
            if at != (dim, c, bx, by):
                yield from solved()
                at, sides = (dim, c, bx, by), ([], [])
            sides[role].append((key, w, vec, own))
        yield from solved()

    found = cut(both.mapInArrow(run, "a binary, b binary, n long"))
    known = connected_components(found.where("b is not null").select("a", "b"), cut)
    degree = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    named = reps.select("class", "key", "w").join(known.withColumnRenamed("node", "key"), "key", "left").join(degree, "key", "left")
    of = named.select(F.col("class").alias("key"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), least_of(F.coalesce("component", "key")).alias("component_id"))
    out = base.select("vec_id", "key").join(of, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
