"""Operator 10: quality rules by divergence from a language's reference, in DataFrame functions only.

Base rules: too few words, or too large a part of the words inside 8-word windows that occur twice or more in the text.
Divergence rules: the Jensen-Shannon distance (base 2, 0 to 1) between the document's histogram of character classes
and its language's, and between its histogram of common words and its language's. Each has a least length, under which
it says nothing; a document in a language without a reference passes both.

References are fitted to all documents labelled good (or, if the caller asks for it, to `sample_rows` of them, drawn by a hash of
the id): each language's shares of the character classes, and of its `COMMON_WORDS` most frequent words
(runs of letters, as written; of equally frequent ones the first in byte order); the rest of the words is one more class. A
language needs `MIN_REFERENCE_WORDS` words there to have a reference. The word rule rejects what is further from the
reference than `WORD_LIMIT` of the distance that a text without any common word has.

Judging shuffles nothing: every figure comes from the row itself and its language's reference, a row of at most
`COMMON_WORDS` words for each of at most `MAX_LANGUAGES` languages, which is broadcast (more are refused). Windows are compared
by a 64-bit hash first; windows whose hashes meet are compared as text, so hash collisions change nothing.

Null and empty texts have no words: all figures are 0, base_failed is true. Null languages have no reference. Labels that are
null or have no document count for nothing; with no good label no language has a reference. Repeated rows each give a row
(and count as often for a reference); other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import likely

#: Character classes: lower-case and other letters, capitals, numbers, white space, punctuation, other signs.
CLASSES = ("lower", "upper", "number", "space", "punct", "sign")
COMMON_WORDS = 32
#: Only the SQL twin still draws (`oracles.py`): its rows are the query's while no more documents are labelled good.
SAMPLE_ROWS = 8_000
MIN_REFERENCE_WORDS = 1_000
MAX_LANGUAGES = 1_000
MAX_CLASS_DISTANCE = 0.20
WORD_LIMIT = 0.85
MIN_CHARS = 200
MIN_WORDS = 100
SYMBOLS = "[^#*$%&|<>]+"


def _let(value: Column, body) -> Column:
    """`body` of a value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _adjacent(sorted_rows: Column, key: str) -> Column:
    """Rows of a sorted array of structs whose `key` a neighbour shares."""
    same = lambda s, e, j: ((j > 0) & (F.get(s, j - 1)[key] == e[key])) | F.coalesce(F.get(s, j + 1)[key] == e[key], F.lit(False))
    return _let(sorted_rows, lambda s: F.filter(s, lambda e, j: same(s, e, j)))


def _window_hashes(words: Column) -> Column:
    """A hash of each window of 8 words, by doubling: of words, pairs, fours, eights."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        hashes = _paired(hashes, step)
    return F.slice(hashes, F.lit(1), F.size(words) - 7)


def _paired(hashes: Column, step: int) -> Column:
    return _let(hashes, lambda h: F.zip_with(h, F.slice(h, F.lit(step + 1), F.size(h)), lambda a, b: F.xxhash64(a, b)))


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words covered by windows that occur twice or more."""
    met = _adjacent(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("k"), i.alias("i")))), "k")
    text = F.sort_array(F.transform(met, lambda e: F.struct(F.array_join(F.slice(words, e["i"] + 1, F.lit(8)), " ").alias("k"), e["i"].alias("i"))))
    at = F.sort_array(F.transform(_adjacent(text, "k"), lambda e: e["i"]))
    steps = _let(at, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(8), F.coalesce(F.get(p, j + 1) - x, F.lit(8)))), F.lit(0), lambda a, b: a + b))
    return steps.cast("long")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, each of sum 1."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: _let((a + b) / 2, lambda m: (part(a, m) + part(b, m)) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b), F.lit(0.0)))


def _with_rest(shares: Column) -> Column:
    """Shares and what they leave of 1."""
    return _let(shares, lambda a: F.array_append(a, F.lit(1.0) - F.aggregate(a, F.lit(0.0), lambda x, y: x + y)))


@dataclass(frozen=True)
class Reference:
    """What a language's good texts look like: shares of the character classes, common words and their shares."""

    lang: str
    classes: tuple[float, ...]
    words: tuple[str, ...]
    shares: tuple[float, ...]

    @property
    def without(self) -> float:
        """The word distance of a text that has none of the common words: p is 0, ..., 0, 1."""
        rest = 1 - sum(self.shares)
        m = (1 + rest) / 2
        return math.sqrt((sum(self.shares) - math.log2(m) + (rest * math.log2(rest / m) if rest > 0 else 0)) / 2)


def fit(docs: DataFrame, labels: DataFrame, common_words: int = COMMON_WORDS, min_reference_words: int = MIN_REFERENCE_WORDS, sample_rows: int | None = None) -> list[Reference]:
    """References of the languages of `docs` (doc_id, text, lang), over all documents whose label is good in `labels` (doc_id,
    quality), or `sample_rows` of them. Documents are met with labels twice, by their id: once their figures are shuffled, once the
    texts of those that may be good. Counts are pre-aggregated; the driver gets a row a language, and one for each common word."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    if sample_rows is not None:
        good = good.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(sample_rows)
    docs = likely(docs.select("doc_id", F.col("lang").alias("ref_lang"), F.coalesce("text", F.lit("")).alias("t")).where("ref_lang is not null"), good, "doc_id")
    labelled = lambda df: df.join(good.hint("shuffle_hash"), "doc_id", "left_semi")
    figures = _once(docs.select("doc_id", "ref_lang", "t", _words(F.col("t")).alias("words")))
    figures = _once(figures.select("doc_id", "ref_lang", F.size("words").alias("n"), F.length(F.array_join("words", "")).alias("word_chars"), F.length("t").alias("chars"), "t", F.regexp_replace("t", "\\p{L}+", "").alias("rest")))
    counts = labelled(_class_counts(_once(figures.select("doc_id", "ref_lang", "n", "chars", "word_chars", *_class_columns())), "doc_id", "ref_lang", "n"))
    sums = counts.groupBy("ref_lang").agg(F.sum("n").alias("n"), *(F.sum(F.get("classes", i)).alias(c) for i, c in enumerate(CLASSES))).where(F.col("n") >= min_reference_words)
    total = {r["ref_lang"]: r for r in sums.limit(MAX_LANGUAGES + 1).collect()}
    if len(total) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    each = labelled(docs).select("ref_lang", F.explode(_words(F.col("t"))).alias("w")).groupBy("ref_lang", "w").agg(F.count("*").alias("c")).where(F.col("w").rlike("^\\p{L}+$"))
    first = F.row_number().over(Window.partitionBy("ref_lang").orderBy(F.desc("c"), "w"))
    top = each.withColumn("k", first).where(F.col("k") <= common_words).where(F.col("ref_lang").isin(list(total)))
    words: dict[str, list] = {}
    for r in sorted(top.collect(), key=lambda r: r["k"]) if total else []:
        words.setdefault(r["ref_lang"], []).append((r["w"], r["c"] / total[r["ref_lang"]]["n"]))
    out = []
    for k in sorted(words):
        chars = sum(total[k][c] for c in CLASSES)
        out.append(Reference(k, tuple(total[k][c] / chars for c in CLASSES), tuple(w for w, _ in words[k]), tuple(x for _, x in words[k])))
    return out


def _once(df: DataFrame) -> DataFrame:
    """The same rows from a generator, so that no expression above repeats one below."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _table(spark: SparkSession, references: list[Reference], word_limit: float) -> DataFrame:
    """The references as rows of literals."""
    doubles = lambda values: F.array(*(F.lit(float(v)) for v in values))
    empty = F.array().cast("array<string>"), F.array().cast("array<double>")
    row = lambda r: F.struct(F.lit(r.lang).alias("ref_lang"), F.array(*map(F.lit, r.words)).alias("ref_words"), doubles([*r.shares, 1 - sum(r.shares)]).alias("ref_shares"), doubles(r.classes).alias("ref_classes"), F.lit(word_limit * r.without).alias("ref_limit"))
    none = F.struct(F.lit(None).cast("string").alias("ref_lang"), empty[0].alias("ref_words"), empty[1].alias("ref_shares"), empty[1].alias("ref_classes"), F.lit(0.0).alias("ref_limit"))
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*(map(row, references) if references else [none]))))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t-\\r]+", -1), lambda w: w != "")


def _class_columns() -> list[Column]:
    """Figures of `t`, and of `rest`: `t` without its letters."""
    return [
        (F.col("chars") - F.length("rest")).alias("letters"),
        F.length(F.regexp_replace("t", "[^\\p{Lu}]+", "")).alias("upper"),
        F.length(F.regexp_replace("rest", "[^\\p{N}]+", "")).alias("number"),
        F.length(F.regexp_replace("rest", "[^.,;:!?'\"()\\-]+", "")).alias("punct"),
    ]


def _class_counts(a: DataFrame, *more: str) -> DataFrame:
    """`more` and the number of characters of each class, as an array."""
    space = F.col("chars") - F.col("word_chars")
    counts = [F.col("letters") - F.col("upper"), F.col("upper"), F.col("number"), space, F.col("punct"), F.col("chars") - F.col("letters") - F.col("number") - F.col("punct") - space]
    return a.select(*more, F.array(*(c.cast("double") for c in counts)).alias("classes"))


def judge(docs: DataFrame, references: list[Reference], **parameters) -> DataFrame:
    """Figures and verdict for every row of `docs` (doc_id, text, lang)."""
    return _figures(docs, references, **parameters).select("row.doc_id", *FIGURES)


def keep(docs: DataFrame, references: list[Reference], **parameters) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns."""
    return _once(_figures(docs, references, **parameters).select("row", "kept")).where("kept").select("row.*")


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def _figures(docs: DataFrame, references: list[Reference], max_class_distance: float = MAX_CLASS_DISTANCE, word_limit: float = WORD_LIMIT, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """Each row of `docs` as one column, so that no name of its own clashes, with its figures and verdict."""
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("lang").alias("doc_lang"), text.alias("t"), _words(text).alias("words"))
    given = F.broadcast(_table(docs.sparkSession, references, word_limit))
    a = a.join(given, F.col("doc_lang") == F.col("ref_lang"), "left")
    own = ["row", "ref_words", "ref_shares", "ref_classes", "ref_limit"]
    a = a.select(
        *own, "t", "words",
        F.size("words").alias("n"),
        F.when(F.size("words") > 8, _window_hashes(F.col("words"))).alias("h"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike("[^ \\t-\\r]")).alias("lines"),
        F.regexp_replace("t", "\\p{L}+", "").alias("rest"),
        F.length("t").alias("chars"),
    )
    repeats = F.when(F.col("h").isNull() | (F.size(F.array_distinct("h")) == F.size("h")), F.lit(0).cast("long")).otherwise(_repeat_words(F.col("words"), F.col("h")))
    any_common = sorted({w for r in references for w in r.words})
    share = _let(F.filter("words", lambda w: w.isin(any_common)), lambda c: F.transform("ref_words", lambda k: F.size(F.filter(c, lambda w: w == k)) / F.col("n")))
    a = a.select(
        *own, "chars",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("rest", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        F.when((F.col("n") >= min_words) & F.col("ref_words").isNotNull(), share).alias("common"),
        *_class_columns(),
    )
    a = _class_counts(a, *own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common")
    classes = F.transform("classes", lambda c: c / F.col("chars"))
    a = a.select(
        "row", "ref_limit", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        F.when((F.col("chars") >= min_chars) & F.col("ref_classes").isNotNull(), js_distance(classes, F.col("ref_classes"))).alias("class_distance"),
        F.when(F.col("common").isNotNull(), js_distance(_with_rest(F.col("common")), F.col("ref_shares"))).alias("word_distance"),
    )
    fits = (F.coalesce(F.col("class_distance"), F.lit(0.0)) <= max_class_distance) & F.coalesce(F.col("word_distance") <= F.col("ref_limit"), F.lit(True))
    return a.withColumn("kept", ~F.col("base_failed") & fits)
