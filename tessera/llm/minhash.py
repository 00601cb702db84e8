"""Operator 8: near-duplicate documents by bottom-k sketches of one hash function.

1. Each document's distinct word shingles are hashed once; the k smallest hashes are its sketch, k growing with the set
   (`_kept`: about a quarter of it). Documents with the same full set are one class, so any number of exact copies costs one
   row from there on.
2. Inverted lists of retained values. In a pair over the threshold each set has at most `n - ceil(0.8 n)` values that the
   other lacks, so of two sketches the one that ends first shares all but so many of its values with the other. A sketch may
   therefore leave out its most common values, as many as the shortest possible partner is sure to share (`_dropped`), and
   both still list the rarest shared one. Common passages mostly fall out there. Each list names one leader, the member
   with the most common values (of a group of copies: the one nearest to all).
3. Members meet their leaders, which is linear in the lists' rows. Below the smaller of two sketches' largest values, the
   union sketch shows what each set has alone: that bounds the intersection from above. Pairs that can reach the threshold
   are verified on the full sets; the others are ruled out for sure.
4. Jaccard distance is a metric. Two members of one leader's lists that are still in different components can be linked
   only if their distances to the leader, or their bounds, differ by no more than the threshold's distance. What that leaves is
   verified on full sets in blocks of bounded size; only links leave the blocks, never pairs.
5. Components of the verified links, in contraction rounds.

No step is an estimate, so no link is lost (but for collisions of 64-bit hashes). Rows that share a value or a leader are
dealt over as many places as their number asks for, and what they meet is sent to each of those.

Null and empty texts, and texts without a word, have no shingles and are linked with nothing. Rows with a null doc_id take
the smallest id of their text's copies and of what is linked with those; a component without any id has a null one.
Repeated rows are copies of one another; a doc_id with several texts gives a row for each. Other columns are ignored by
`components` and kept by `keep`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import RANK_BYTES, BoundedCache, arrow, chunks, cut, forget, least_of, mix, once, ranked, rows, shared_dir, ship
from tessera.operators.components import connected_components

#: Members of a leader, and of a list, that meet it in one place.
MEMBERS_EACH, LISTED_EACH = 256, 4096


def _needed(n, percent: int):
    """How many values of a set are sure to hold one that a partner over the threshold has."""
    return n + n * percent // -100 + 1


def _kept(n: int, percent: int) -> int:
    """Values that a set of n retains."""
    need = _needed(n, percent)
    return min(n, need + need // 4 + 4)


def _dropped(n: int, percent: int) -> int:
    """Of the retained values, how many of the most common need not be listed: one less than the values that the sketches of a
    pair over the threshold share at least, whatever the partner's size (the shortest partner's sketch shares fewest)."""
    least = -(n * percent // -100)
    return _kept(least, percent) - _needed(least, percent)


class Shingles:
    """Hashed shingle sets in one worker; word hashes are kept in a bounded cache."""

    def __init__(self, width: int, cache: int = 150_000):
        self.width = width
        self.words = BoundedCache(lambda ws: map(xxhash.xxh3_64_intdigest, ws), cache)

    def set(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles. bytes.lower() and bytes.split() know A-Z and the six white
        space characters of the contract, and no others."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.int64)
        a = np.fromiter(map(self.words.ready(words).__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(a))
        h = a[: len(a) - k + 1]
        for j in range(1, k):
            h = mix(h) + a[j : len(a) - k + 1 + j]
        return np.unique(mix(h).view(np.int64))


def _shingles(width: int) -> Shingles:
    return once(("shingles", width), lambda: Shingles(width))


def _key(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, the class key of the full set, the sketch, and how many values may be left out."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("sketch", pa.list_(pa.int64())), ("listed", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _shingles(width)
        for held in chunks(rows(batches, "doc_id", "text", "th")):
            sets = [of.set(t) for _, t, _ in held]
            sizes = list(map(len, sets))
            kept = [_kept(n, percent) for n in sizes]
            yield arrow(schema, [[r[0] for r in held], [r[2] for r in held], sizes, [_key(s) if len(s) else None for s in sets], [s[:k] for s, k in zip(sets, kept, strict=True)], [k - _dropped(n, percent) for n, k in zip(sizes, kept, strict=True)]])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, n_shingles long, key binary, sketch array<long>, listed int")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


#: A row's place: its id, whether it has none, and its text's hash.
PLACE = ["own_id", "no_id", "th"]


def _placed(df: DataFrame, th: Column) -> DataFrame:
    return df.withColumns({"own_id": F.coalesce("doc_id", F.lit(0)), "no_id": F.col("doc_id").isNull(), "th": th})


def components(docs: DataFrame, width: int = 5, percent: int = 80, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs` (doc_id, text). Documents are linked if the
    intersection of their sets is at least `percent` hundredths of the union."""
    base, named = _named(docs.select("doc_id", "text"), width, percent, block)
    of_class = named.select(F.col("class").alias("key"), least_of("component").alias("component_id"))
    out = base.select("doc_id", "n_shingles", "key").join(of_class, "key", "left")
    out = cut(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of `docs`, with all its columns: of the first id (rows without one come last) and, of its
    rows, of the text with the smallest hash. Rows whose texts have no words are no one's duplicates and all stay."""
    _, named = _named(docs.select("doc_id", "text"), width, percent, 512)
    first = named.where("component = key").select("own_id", "no_id", "th")
    taken = {c.lower() for c in docs.columns}
    mark = "place"
    while mark in taken:
        mark += "_"
    placed = docs.withColumn(mark, F.struct(F.coalesce("doc_id", F.lit(0)).alias("own_id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("th")))
    words = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    chosen = placed.where(words).join(first.select(F.struct(*PLACE).alias(mark)), mark, "left_semi").dropDuplicates([mark])
    return chosen.drop(mark).unionByName(docs.where(~words))


def _named(docs: DataFrame, width: int, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The rows' sketches, and of every class its key (`class`), name (`key`), first row's place, and component's name."""
    spark = docs.sparkSession
    ship(spark)
    whole = cut(sketches(docs, width, percent))
    base = cut(whole.select("doc_id", "n_shingles", "key"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first")
    reps = whole.where("key is not null").groupBy("key").agg(first, *(F.any_value(c).alias(c) for c in ("n_shingles", "listed", "sketch")))
    reps = reps.select(F.monotonically_increasing_id().alias("id"), F.col("key").alias("class"), ranked(F.col("first.doc_id"), F.col("key")).alias("key"), "first.doc_id", "first.th", F.col("n_shingles").alias("n"), "listed", "sketch")
    reps = cut(_placed(reps, F.col("th")))
    forget(spark, whole)
    lists = _lists(reps)
    forget(spark)
    pairs, spent = _met_pairs(reps, lists, percent)
    forget(spark, lists, spent)

    members = pairs.select("key").union(pairs.select(F.col("leader").alias("key"))).distinct().join(reps.select("key", *PLACE), "key")
    at = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    try:
        texts = members.join(_placed(docs, F.xxhash64("text")), PLACE).dropDuplicates(PLACE)
        texts.select("key", "text").write.option("compression", "zstd").parquet(at)
        texts = spark.read.parquet(at)
        forget(spark)
        dist = cut(_verify(pairs.where("near"), texts, width))
        measured = dist.select("key", "leader", "parts", "part", F.col("d").alias("lo"), F.col("d").alias("hi"), (100 * F.col("i") >= percent * F.col("u")).alias("link"))
        far = pairs.where("not near").select("key", "leader", "parts", "part", "lo", "hi", F.lit(False).alias("link"))
        links = cut(measured.where("link").select(F.col("key").alias("a"), F.col("leader").alias("b")))
        known = connected_components(links, cut)

        # What the leaders have not settled.
        met = measured.unionByName(far).join(known.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("component", "key")).drop("component")
        more = cut(_unsettled(cut(met), texts, width, percent, block))
        final = known if more.isEmpty() else connected_components(links.unionByName(more), cut)
    finally:
        _remove(spark, at)
    named = reps.select("class", "key", *PLACE).join(final.withColumnRenamed("node", "key"), "key", "left")
    return base, named.withColumn("component", F.coalesce("component", "key"))


def _lists(reps: DataFrame) -> DataFrame:
    """Inverted lists of the rarest values: id, the sum of its shared values' counts, a value, and the list's places. A value is
    listed by its 48 upper bits: where two become one, more sets meet, and none less."""
    values = reps.select("id", F.explode("sketch").alias("v")).withColumn("v", F.shiftright("v", 16))
    shared = values.join(values.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "v")
    listed = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("vs"), F.sum("c").alias("score"))  # one sketch's values
    listed = listed.join(reps.select("id", "listed", F.size("sketch").alias("k")), "id")
    alone = F.col("k") - F.size("vs")
    listed = listed.withColumn("vs", F.slice("vs", F.lit(1), F.greatest(F.lit(0), F.col("listed") - alone)))
    return cut(_dealt(listed.select("id", "score", F.explode("vs").alias("x")).select("id", "score", "x.v", "x.c"), LISTED_EACH))


def _met_pairs(reps: DataFrame, lists: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """key, leader, the place where they meet (parts, part), bounds of their distance, and whether they can be over the threshold;
    and what was written on the way and is read no more."""
    leaders = lists.groupBy("v").agg(F.max_by("id", F.struct("score", "id")).alias("lid"), F.max("parts").alias("parts"), F.count("*").alias("m")).where("m > 1")
    leaders = leaders.select("v", "lid", "m", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = lists.join(leaders, ["v", "part"]).where("id <> lid").groupBy("id", "lid").agg(F.max("m").alias("c"))
    pairs = cut(_dealt(pairs, MEMBERS_EACH))

    # The union sketch: what each set has alone below both ends.
    a = reps.select("id", "key", F.col("sketch").alias("sa"), F.col("n").alias("na"))
    b = reps.select(F.col("id").alias("lid"), F.col("key").alias("leader"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    places = pairs.select("lid", "parts", "part").distinct().join(b, "lid")
    both = pairs.join(a, "id").join(places, ["lid", "parts", "part"])
    end = lambda s, n: F.when(F.size(s) == F.col(n), F.lit(2**63 - 1)).otherwise(F.element_at(s, -1))
    both = both.withColumns({"end": F.least(end("sa", "na"), end("sb", "nb")), "i": F.size(F.array_intersect("sa", "sb"))})
    below = lambda s: F.size(F.filter(s, lambda x: x <= F.col("end")))
    both = both.withColumn("most", F.least(F.col("na") - below("sa") + F.col("i"), F.col("nb") - below("sb") + F.col("i")))
    share = lambda i: F.col(i) / (F.col("na") + F.col("nb") - F.col(i))
    near = 100 * F.col("most") >= percent * (F.col("na") + F.col("nb") - F.col("most"))
    met = cut(both.select("key", "leader", "parts", "part", (1 - share("most")).alias("lo"), (1 - share("i")).alias("hi"), near.alias("near")))
    return met, pairs


def _dealt(df: DataFrame, each: int) -> DataFrame:
    """Rows with the place (part of parts) among those that their group, of about `c` rows, is dealt over."""
    df = df.withColumn("parts", F.ceil(F.col("c") / each).cast("int"))
    return df.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("c")


def _remove(spark, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _verify(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """key, leader, their place, intersection, union and distance of every pair. A leader's text goes to each of its places."""
    place = ["leader", "parts", "part"]
    one = pairs.select("key", *place).join(texts, "key").select(*place, F.lit(1).alias("role"), "key", "text")
    two = pairs.select(*place).distinct().join(texts.withColumnRenamed("key", "leader"), "leader")
    two = two.select(*place, F.lit(0).alias("role"), F.col("leader").alias("key"), "text")
    schema = pa.schema([("key", pa.binary()), ("leader", pa.binary()), ("parts", pa.int32()), ("part", pa.int32()), ("i", pa.int64()), ("u", pa.int64()), ("d", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, head, name = _shingles(width), None, None
        for held in chunks(rows(batches, "leader", "text", "parts", "part", "role", "key")):
            out = []
            for leader, text, parts, part, role, key in held:
                s = of.set(text)
                if _key(s) != key[RANK_BYTES:]:
                    raise ValueError("a text is not the one its sketch was made of: the input changed between two reads")
                if role == 0:
                    head, name = s, leader
                elif name == leader:
                    i = _overlap(head, s)
                    u = len(head) + len(s) - i
                    out.append((key, leader, parts, part, i, u, 1 - i / u))
            if out:
                yield arrow(schema, list(zip(*out, strict=True)))

    both = two.unionByName(one).repartition(*place).sortWithinPartitions(*place, "role")
    return both.mapInArrow(run, "key binary, leader binary, parts int, part int, i long, u long, d double")


def _unsettled(met: DataFrame, texts: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Links (a, b) between members of one leader that are in different components. One of the two is no neighbour of the
    leader; it meets, block by block, the members whose distance to the leader differs by no more than the threshold's."""
    reach = 1 - percent / 100 + 1e-9
    sums = met.groupBy("leader").agg(F.count("*").alias("n"), F.count_if(~F.col("link")).alias("m"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    open_ = sums.where("n > 1 and m > 0 and c1 <> c2").select("leader", F.ceil(F.col("n") / block).cast("int").alias("ny"), F.ceil(F.col("m") / block).cast("int").alias("nx"))
    open_ = met.select("leader", "parts", "part").distinct().join(open_, "leader")
    rows_ = met.join(open_, ["leader", "parts", "part"]).withColumn("h", F.abs(F.hash("key").cast("long")))
    x = rows_.where("not link").select("leader", "key", "lo", "hi", "comp", (F.col("h") % F.col("nx")).cast("int").alias("bx"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("by"), F.lit(0).alias("role"))
    y = rows_.select("leader", "key", "lo", "hi", "comp", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("bx"), (F.col("h") % F.col("ny")).cast("int").alias("by"), F.lit(1).alias("role"))
    both = x.unionByName(y).join(texts, "key").repartition("leader", "bx", "by").sortWithinPartitions("leader", "bx", "by", "role", "key")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def solve(xs: list, ys: list) -> list[tuple[bytes, bytes]]:
        """One link at most between any two components: more would change nothing."""
        if not xs or not ys:
            return []
        values = np.concatenate([s for *_, s in ys])
        owner = np.repeat(np.arange(len(ys)), [len(s) for *_, s in ys])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        sizes = np.array([len(s) for *_, s in ys])
        lo, hi = np.array([r[1] for r in ys]), np.array([r[2] for r in ys])
        names = {c: i for i, c in enumerate({r[3] for r in ys} | {r[3] for r in xs})}
        comp = np.array([names[r[3]] for r in ys])
        out = []
        root = list(range(len(names)))

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for key, l, h, c, s in xs:  # noqa: E741
            can = (comp != names[c]) & (l - hi <= reach) & (lo - h <= reach) & (100 * np.minimum(sizes, len(s)) >= percent * np.maximum(sizes, len(s)))
            if not can.any():
                continue
            first, last = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
            n = last - first
            at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            i = np.bincount(owner[at], minlength=len(ys))
            for j in np.flatnonzero(can & (100 * i >= percent * (sizes + len(s) - i))).tolist():
                p, q = find(names[c]), find(int(comp[j]))
                if p != q:
                    root[p] = q
                    out.append((key, ys[j][0]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, at = _shingles(width), None
        sides: tuple[list, list] = ([], [])
        for leader, text, bx, by, role, key, lo, hi, comp in rows(batches, "leader", "text", "bx", "by", "role", "key", "lo", "hi", "comp"):
            if at != (leader, bx, by):
                if found := solve(*sides):
                    yield arrow(schema, list(zip(*found, strict=True)))
                at, sides = (leader, bx, by), ([], [])
            s = of.set(text)
            sides[role].append((key, lo, hi, comp, s))
        if found := solve(*sides):
            yield arrow(schema, list(zip(*found, strict=True)))

    return both.mapInArrow(run, "a binary, b binary")
