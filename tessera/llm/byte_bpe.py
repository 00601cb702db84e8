"""Operator 9: byte-level BPE encoding and decoding by ranks.

Pre-tokens are located by the scans of `pretokens` (no regular expressions); each distinct slice is merged once per
worker by ranks and kept in a bounded cache, as the little-endian bytes of its ids. Token offsets (byte positions in the
text, one more than the tokens) are kept, so that any token's bytes can be cut from the text, and decoding puts the
vocabulary's byte strings at those offsets.

Null texts are empty: no ids. Texts hold any code points; special strings are ordinary text. Repeated rows each give a
row, other columns are ignored. Ids that the vocabulary lacks are refused on decoding.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import BoundedCache, arrow, chunks, once, rows, ship
from tessera.llm.pretokens import pretokens


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: of all neighbouring pairs the one of least rank is joined, leftmost first, until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 96:
        return _merge_long(parts, ranks)
    get, none = ranks.get, 1 << 60
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        if (least := min(pairs)) == none:
            break
        at = pairs.index(least)
        parts[at] += parts.pop(at + 1)
        pairs.pop(at)
        if at:
            pairs[at - 1] = get(parts[at - 1] + parts[at], none)
        if at < len(pairs):
            pairs[at] = get(parts[at] + parts[at + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over a linked list: n log n for very long pre-tokens."""
    import heapq

    n = len(parts)
    after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    live: list[bytes | None] = list(parts)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i] if live[i] is left else n
        if j >= n or live[j] is not right:
            continue
        live[i], live[j] = left + right, None
        after[i] = after[j]
        if after[i] < n:
            prior[after[i]] = i
        for a, b in ((prior[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(live[a] + live[b])) is not None:
                heapq.heappush(heap, (r, a, live[a], live[b]))
    return [ranks[p] for p in live if p is not None]


class ByteBPE:
    """Encoder and decoder of one vocabulary in one worker."""

    def __init__(self, path: str, cache: int = 150_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        lengths = np.zeros(size, np.int64)
        for token, i in self.ranks.items():
            lengths[i] = len(token)
        self.lengths, self.places = lengths, np.concatenate(([0], np.cumsum(lengths)))
        by_id = {i: t for t, i in self.ranks.items()}
        self.bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)
        self.cache = BoundedCache(self._encode, cache)

    def _encode(self, slices: list[str]) -> list[bytes]:
        return [np.array(merge(s.encode(), self.ranks), "<u4").tobytes() for s in slices]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        joined, places, counts = pretokens(texts)
        at = places.tolist()
        cuts = [joined[a:b] for a, b in zip(at, at[1:], strict=False)]
        out, k = [], 0
        for n in counts.tolist():
            own = cuts[k : k + n]
            out.append(b"".join(map(self.cache.ready(own).__getitem__, own)))
            k += n + 1
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offsets of the tokens, and the end."""
        if len(ids) and (int(ids.max()) >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return np.concatenate(([0], np.cumsum(self.lengths[ids])))

    def decode(self, ids: np.ndarray, part: int = 1 << 16) -> bytes:
        """The tokens' bytes, put at their offsets, `part` tokens at a time."""
        out = []
        for k in range(0, len(ids), part):
            some = ids[k : k + part]
            ends = self.offsets(some)
            shift = np.repeat(self.places[some] - ends[:-1], self.lengths[some])
            out.append(self.bytes[shift + np.arange(ends[-1])].tobytes())
        return b"".join(out)


def _bpe(path: str) -> ByteBPE:
    return once(("byte_bpe", path), lambda: ByteBPE(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and offsets (byte positions, one more than ids) of every row of `docs` (doc_id, text)."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for held in chunks(rows(batches, "doc_id", "text")):
            ids = [np.frombuffer(b, "<u4") for b in bpe.encode_batch([t or "" for _, t in held])]
            yield arrow(schema, [[i for i, _ in held], [x.astype(np.int32) for x in ids], [bpe.offsets(x) for x in ids]])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, offsets array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded bytes of every row of `encoded` (doc_id, ids); null ids give empty bytes."""
    ship(encoded.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for held in chunks(rows(batches, "doc_id", "ids")):
            yield arrow(schema, [[i for i, _ in held], [bpe.decode(np.array(x or [], np.int64)) for _, x in held]])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to, for every row of `docs` (doc_id, text)."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for held in chunks(rows(batches, "doc_id", "text")):
            out = []
            for (doc_id, _), ids in zip(held, bpe.encode_batch([t or "" for _, t in held]), strict=True):
                decoded = bpe.decode(np.frombuffer(ids, "<u4"))
                out.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield arrow(schema, list(zip(*out, strict=True)))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
