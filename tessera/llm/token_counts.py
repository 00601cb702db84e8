"""Operator 4: tokens of every text, by a map-side look-up in two tiers.

The first tier is a compact table of the lengths of frequent pre-tokens: one joined string and one array of 16-bit
lengths, broadcast (its size is a parameter) and opened as a hash table once per Python worker. A pre-token that is
not in it is encoded once by the tokenizer itself and remembered in the worker's bounded cache. Pre-tokens are never
shuffled, and no count depends on what either tier holds.

All texts go this way: the pattern's classes of letters, numbers and white space are those of `pretokens`, of all code points,
written up to U+00FF, U+FFFF or the last one as a text needs, since short classes are matched faster.

Nulls and empty texts count 0 tokens and 0 bytes. Repeated rows each give a row. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import BEYOND_BMP, BEYOND_LATIN1, LETTERS, NUMBERS, SPACES, BoundedCache, arrow, once, rows, ship
from tessera.llm.pretokens import LETTER_KINDS, NUMBER_KINDS, SPACE_KINDS, class_of


def _pretoken(letters: str, numbers: str, spaces: str) -> re.Pattern:
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


PRETOKEN = _pretoken(LETTERS, NUMBERS, SPACES)


@cache
def pretoken_upto(last: int) -> re.Pattern:
    return _pretoken(*(class_of(last, *kinds) for kinds in (LETTER_KINDS, NUMBER_KINDS, SPACE_KINDS)))


def pretokens_of(text: str) -> list[str]:
    if not BEYOND_LATIN1.search(text):
        return PRETOKEN.findall(text)
    return pretoken_upto(0x10FFFF if BEYOND_BMP.search(text) else 0xFFFF).findall(text)
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Lengths:
    """Counts the tokens of texts in one worker. `frequent`: pre-tokens joined by U+0001, and their lengths as 16-bit numbers."""

    def __init__(self, path: str, frequent: tuple[str, bytes] = ("", b""), cache: int = 200_000):
        self.tok = tokenizer(path)
        lengths = array("H")
        lengths.frombytes(frequent[1])
        self.first = dict(zip(frequent[0].split("\x01"), lengths, strict=True)) if len(lengths) else {}
        self.second = BoundedCache(self._encode, cache)
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def _encode(self, pretokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch_fast(pretokens, add_special_tokens=False)]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        found = pretokens_of(text)
        known = list(map(self.first.get, found))
        if None not in known:
            return sum(known)
        rest = [t for t, n in zip(found, known, strict=True) if n is None]
        held = self.second.ready(rest)
        return sum(filter(None, known)) + sum(map(held.__getitem__, rest))


def frequent_lengths(docs: DataFrame, path: str, size: int, sample_rows: int) -> tuple[str, bytes]:
    """The lengths of the most frequent pre-tokens, at most `size`, among about `sample_rows` rows drawn from all of the table.
    Each partition tallies what is drawn from it to one row, so nothing is shuffled, and the driver gets no more than those
    rows' own pre-tokens. The draw only decides which lengths are shipped ahead."""
    if not (n := docs.count()):
        return "", b""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for (text,) in rows(batches, "text"):
            if text:
                seen.update(t for t in pretokens_of(text) if "\x01" not in t and len(t) < 64)
        if top := seen.most_common(size):
            yield pa.RecordBatch.from_pydict({"t": pa.array([[t for t, _ in top]], pa.list_(pa.string())), "n": pa.array([[n for _, n in top]], pa.list_(pa.int64()))})

    total: Counter = Counter()
    drawn = docs.select("text").sample(min(1.0, sample_rows / n), 1)
    for found in drawn.mapInArrow(tally, "t array<string>, n array<long>").collect():
        total.update(dict(zip(found["t"], found["n"], strict=True)))
    if not (top := [t for t, n in total.most_common(size) if n > 1]):
        return "", b""
    lengths = Lengths(path)._encode(top)
    kept = [(t, n) for t, n in zip(top, lengths, strict=True) if n < 65536]
    return "\x01".join(t for t, _ in kept), array("H", [n for _, n in kept]).tobytes()


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, table_size: int = 32_768, sample_rows: int = 2_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens is over `limit`, for every row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    frequent = spark.sparkContext.broadcast(frequent_lengths(docs, path, table_size, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(("token_counts", path, hash(frequent.value)), lambda: Lengths(path, frequent.value))
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in rows(iter([batch]), "doc_id", "text"):
                n = counter.count(text)
                out.append((doc_id, len((text or "").encode()), n, n > limit))
            yield arrow(SCHEMA, list(zip(*out, strict=True)) if out else [[], [], [], []])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
