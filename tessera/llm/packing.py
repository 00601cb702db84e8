"""Operator 1: packing documents into sequences by vector best-fit.

Every sequence has three capacities: tokens, documents, and attention cost (the sum of squared lengths of what it
holds). A piece goes to the open sequence that is best among those with room under every one of them: the one whose
weighted residual norm after placing is least ("norm"), or whose residual the piece is best aligned with ("dot": the
weighted dot product of need and residual over the residual's squared norm). Where none has room a new one opens.
Pieces come by decreasing length. Documents longer than the token capacity are cut into full pieces and a rest.

Pieces are dealt round-robin to groups of a bounded number of rows, and each group is packed by itself, so nothing
depends on keys and no group grows with the data. The sequences that a group leaves part empty are opened again and
their pieces packed together in fewer groups, until one group is left or nothing is gained.

Null and empty texts are one piece: the end token alone. Repeated rows are packed each for itself. Other columns are
ignored. A piece that alone breaks a capacity is refused.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BEYOND_LATIN1, LETTERS, NUMBERS, SPACES, BoundedCache, chunks, cut, once, rows, ship
from tessera.llm.pretokens import SPACE_KINDS, class_of

WORD_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")


@cache
def white_space() -> re.Pattern:
    return re.compile(f"[{class_of(0xFFFF, *SPACE_KINDS)}]+")


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Ids of texts in one worker, through a bounded cache: word by word, and what stands between white space as a whole where
    it has a code point above U+00FF (its lower case and composed form may depend on its neighbours; white space parts them)."""

    def __init__(self, path: str, cache: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.cache = BoundedCache(self._encode, cache)
        vocabulary = self.tok.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in self.tok.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _encode(self, words: list[str]) -> list[bytes]:
        """Many words go to the tokenizer as one text, with spaces between: each is a piece of its own and ends with the only
        token that closes a word, where the ids are cut. Should the ends not be as many as the words, each goes alone."""
        if any(map(BEYOND_LATIN1.search, words)):
            wide = [w for w in words if BEYOND_LATIN1.search(w)]
            found = dict(zip(wide, (np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(wide, add_special_tokens=False)), strict=True))
            plain = [w for w in words if w not in found]
            found |= zip(plain, self._encode(plain), strict=True)
            return [found[w] for w in words]
        out: list[bytes] = []
        for k in range(0, len(words), 1000):
            some = words[k : k + 1000]
            ids = np.array(self.tok.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
                out += [data[a:b] for a, b in zip(at, at[1:], strict=False)]
            else:
                out += [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self.split and self.split.search(text):
            return b"".join(self.special[p] if p in self.special else self._plain(p) for p in self.split.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not BEYOND_LATIN1.search(text):
            words = WORD_PIECES.findall(text.lower())
        else:
            words = []
            for part in white_space().split(text):
                if BEYOND_LATIN1.search(part):
                    words.append(part)
                else:
                    words += WORD_PIECES.findall(part.lower())
        return b"".join(self.cache.values(words))


def tokenize(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, cache: int = 500_000) -> DataFrame:
    """The pieces of every row of `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32, and ids if wanted. A worker
    remembers at most twice `cache` words; fewer cost time and save memory."""
    ship(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = once(("word_tokenizer", path, cache), lambda: WordTokenizer(path, cache))
        for held in chunks(rows(batches, "doc_id", "text")):
            out = []
            for doc_id, text in held:
                ids = tok.ids(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype(np.int32)] if with_ids else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE + ", ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece and its offset there. `lengths` come in decreasing order."""
    n = len(lengths)
    cap, w = np.array(capacities, float), np.array(weights, float)
    room = np.empty((3, 1024))  # residual capacities of the open bins, as shares of the capacity
    names = np.empty(1024, np.int64)
    opened, total = 0, 0
    bins, offsets, used = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    least = np.array([lengths.min(), 1.0, float(lengths.min()) ** 2]) / cap if n else None
    tiny = 1e-12
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1.0, float(length) ** 2]) / cap
        if (need > 1 + tiny).any():
            raise ValueError("a piece alone is over a capacity")
        best = -1
        if opened:
            r = room[:, :opened]
            left = r - need[:, None]
            fits = left.min(axis=0) >= -tiny
            if fits.any():
                cost = w @ (left * left) if rule == "norm" else -((w * need) @ r) / np.maximum(w @ (r * r), tiny)
                cost[~fits] = np.inf
                best = int(cost.argmin())
        if best < 0:
            if opened == room.shape[1]:
                keep = (room[:, :opened] >= least[:, None] - tiny).all(axis=0)
                if keep.sum() > opened // 2:
                    room, names = np.concatenate((room, np.empty_like(room)), axis=1), np.concatenate((names, np.empty_like(names)))
                else:
                    room[:, : keep.sum()], names[: keep.sum()] = room[:, :opened][:, keep], names[:opened][keep]
                    opened = int(keep.sum())
            best, total = opened, total + 1
            room[:, best], names[best] = 1.0, total - 1
            opened += 1
        room[:, best] -= need
        name = names[best]
        bins[i], offsets[i] = name, used[name]
        used[name] += length
        if (room[:, best] < least - tiny).any():  # full: no piece fits any more
            opened -= 1
            room[:, best], names[best] = room[:, opened], names[opened]
    return bins, offsets


def pack(pieces: DataFrame, max_tokens: int = 2048, max_docs: int = 2048, max_attention: float | None = None, weights: tuple[float, float, float] = (1.0, 0.001, 0.001), rule: str = "norm", group_rows: int = 16_384, full: float = 0.995) -> DataFrame:
    """`pieces` (doc_id, piece, start, length, ids_crc32) with sequence_id, offset. max_attention: none by default, which is
    the square of max_tokens, since the sum of squares never exceeds the square of the sum."""
    ship(pieces.sparkSession)
    capacities = (float(max_tokens), float(max_docs), float(max_attention or max_tokens**2))
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out_schema = PIECE + ", sequence_id long, offset long, fill double"

    def packer(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not (got := [b for b in batches if b.num_rows]):
                return
            t = pa.Table.from_batches(got).select(own)
            t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
            lengths = t.column("length").to_numpy()
            bins, offsets = best_fit(lengths, capacities, weights, rule)
            fill = np.bincount(bins, weights=lengths) / max_tokens
            name = (np.int64(turn) << 58) + (np.int64(TaskContext.get().partitionId()) << 28) + bins
            for c, x in (("sequence_id", name), ("offset", offsets), ("fill", fill[bins])):
                t = t.append_column(c, pa.array(x))
            yield from t.to_batches()

        return run

    done, rest, n, turn = None, pieces.select(*own), None, 0
    rest = cut(rest)
    n = rest.count()
    while True:
        groups = max(1, -(-n // group_rows))
        packed = cut(rest.repartition(groups).mapInArrow(packer(turn), out_schema))
        turn += 1
        if groups == 1 or turn == 8:
            part = packed
        else:
            part = packed.where(F.col("fill") >= full)
            rest = packed.where(F.col("fill") < full).select(*own)
            before, n = n, rest.count()
        done = part if done is None else done.unionByName(part)
        if groups == 1 or turn == 8 or not n:
            break
        if n > 0.9 * before:  # hardly anything filled: packing again gains nothing
            done = done.unionByName(packed.where(F.col("fill") < full))
            break
    return done.drop("fill")


def sequences(packed: DataFrame, pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and tokens, from `pieces` made with ids."""
    joined = packed.select("doc_id", "piece", "sequence_id", "offset").join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most one sequence's tokens
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("tokens"))
