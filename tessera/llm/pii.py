"""Operator 2: personal data in texts, by base patterns and a character-level BiLSTM-CRF.

Base spans are the contract's patterns, leftmost and without overlap in each kind, with its checks (parts of an address,
digits and Luhn of a card, digits of a phone number); a match that fails its check is dropped and not retried. The model
(`char_tagger`, trained in numpy from labelled spans) adds spans that overlap no base span and pass a plausibility check of
their kind. It reads every character of every text.

Whole texts are read. Null and empty texts have no spans. Repeated rows each give a row. `redact` keeps every column and
puts the kind's mark in the place of each span; overlapping spans are replaced as one, under the kind that begins first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.char_tagger import KINDS, Tagger, trained
from tessera.llm.common import arrow, chunks, once, rows, ship

Span = tuple[str, int, int]
CHARS = 4_000_000  # of texts tagged at a time: with many windows, those of a batch are nearly as long
TRIGGER = re.compile("[0-9@]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit is right: every second digit from the right is doubled."""
    d = np.frombuffer(digits.encode(), np.uint8)[::-1].astype(np.int64) - 48
    d[1::2] *= 2
    return int((d - 9 * (d > 9)).sum()) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Each "@" in turn: a domain behind it, and before it as many signs of a local part as no earlier match has taken."""
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            taken = m.end()
        else:
            # A run of local signs that leads nowhere is not walked again.
            taken = max(taken, at + 1)
        at = text.find("@", max(at + 1, taken))


def base_spans(text: str | None) -> list[Span]:
    if not text or not TRIGGER.search(text):
        return []
    out = list(_emails(text)) if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


AT = r"(?:\s*@\s*|\s*[(\[]\s*(?:@|at|AT)\s*[)\]]\s*|\s+(?:at|AT)\s+)"
POINT = r"(?:\.|\s\.\s|\s*[(\[]\s*(?:\.|dot|DOT)\s*[)\]]\s*|\s+(?:dot|DOT)\s+)"
EMAIL_LIKE = re.compile(rf"[A-Za-z0-9._%+-]+{AT}[A-Za-z0-9-]+(?:{POINT}[A-Za-z0-9-]+)*{POINT}[A-Za-z]{{2,24}}")
IP_LIKE = re.compile(rf"[0-9]{{1,3}}(?:(?:{POINT}|\.\s)[0-9]{{1,3}}){{3}}")
CARD_LIKE = re.compile(r"[0-9](?:[\s./_-]{0,3}[0-9])+")
PHONE_LIKE = re.compile(r"(?:\+|00|0|\()?[0-9(][0-9\s()./-]*[0-9]")
DATE_LIKE = re.compile(r"(?:1[89]|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:1[89]|20)[0-9]{2}")


def plausible(kind: str, text: str) -> bool:
    """A check of what the model adds: the shape of its kind, and the base patterns' checks of numbers. A phone number has a
    separator, or begins with "+" or "00"; a date is none."""
    digits = NOT_DIGIT.sub("", text)
    if kind == "email":
        return len(text) <= 254 and EMAIL_LIKE.fullmatch(text) is not None
    if kind == "ip":
        return len(text) <= 40 and IP_LIKE.fullmatch(text) is not None and all(int(p) <= 255 for p in re.findall("[0-9]+", text))
    if kind == "card":
        return len(text) <= 64 and 12 <= len(digits) <= 19 and CARD_LIKE.fullmatch(text) is not None and luhn(digits)
    separate = len(digits) < len(text) or text.startswith(("+", "00"))
    return len(text) <= 32 and 9 <= len(digits) <= 15 and separate and PHONE_LIKE.fullmatch(text) is not None and not DATE_LIKE.search(text)


def all_spans(texts: list[str | None], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and these with what the model adds, of each text."""
    base = [base_spans(t) for t in texts]
    both = []
    for text, own, tagged in zip(texts, base, tagger.tag([t or "" for t in texts]), strict=True):
        ends = [(s, e) for _, s, e in own]
        added = []
        for kind, s, e in tagged:
            piece = text[s:e].rstrip(" \t\r\n.,:;!?")
            s, e = s + len(piece) - len(piece.lstrip()), s + len(piece)
            if s < e and plausible(kind, text[s:e]) and not _meets(ends, s, e):
                added.append((kind, s, e))
        both.append((own, sorted(own + added, key=_order) if added else own))
    return both


def _meets(spans: list[tuple[int, int]], s: int, e: int) -> bool:
    return any(a < e and s < b for a, b in spans)


def _said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _tagger(w: dict, h: int) -> Tagger:
    out = Tagger.__new__(Tagger)
    out.w, out.h = w, h
    return out


def _name(tagger: Tagger) -> str:
    return hashlib.sha256(b"".join(tagger.w[k].tobytes() for k in sorted(tagger.w))).hexdigest()


def find(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, base counts by kind, the digest of the base spans, and all spans, of every row of `docs` (doc_id, text)."""
    ship(docs.sparkSession)
    tagger = tagger or trained()
    given, name = docs.sparkSession.sparkContext.broadcast((tagger.w, tagger.h)), _name(tagger)  # a few thousand numbers
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(("tagger", name), lambda: _tagger(*given.value))
        for held in chunks(rows(batches, "doc_id", "text"), chars=CHARS):
            out = []
            for (doc_id, _), (base, spans) in zip(held, all_spans([t for _, t in held], model), strict=True):
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                out.append((doc_id, *counts, hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans), len(spans) - len(base)))
            yield arrow(schema, list(zip(*out, strict=True)))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span's kind in its place."""
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: Tagger | None = None, length_column: str | None = None) -> DataFrame:
    """`docs` with all spans masked in `text`; `length_column`, if given, is set to the new length."""
    ship(docs.sparkSession)
    tagger = tagger or trained()
    given, name = docs.sparkSession.sparkContext.broadcast((tagger.w, tagger.h)), _name(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(("tagger", name), lambda: _tagger(*given.value))
        for b in batches:
            texts: list = []
            for held in chunks(rows(iter([b]), "text"), text_at=0, chars=CHARS):
                own = [t for (t,) in held]
                texts += [t if t is None or not s else mask(t, s) for t, (_, s) in zip(own, all_spans(own, model), strict=True)]
            new = {"text": pa.array(texts, b.schema.field("text").type)}
            if length_column:
                new[length_column] = pa.array([None if t is None else len(t) for t in texts], b.schema.field(length_column).type)
            yield pa.RecordBatch.from_arrays([new.get(f.name, b.column(i)) for i, f in enumerate(b.schema)], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
