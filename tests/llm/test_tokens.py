"""Packing, token counts and byte-level BPE against the tokenizers' own libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import byte_bpe, common, packing, pretokens, queries, token_counts
from tests.llm.helpers import frame

SCHEMA = "doc_id long, text string, ids string, length int"
TEXTS = [
    None, "", " ", "  \n\t ", "Hello world", "don't DON'T we'll I've they're it's 'tis ''s rock'n'roll x'S", "tabs\tand\nlines\r\n  double  spaces   ", "123 4567 ½ ² ٣ Ⅷ", "naïve café Größe ÀÉÎ ß", "日本語 テキスト 中文", "emoji 😀👩‍👩‍👧 flags 🇩🇪",
    "<|endoftext|>", "a <|endoftext|> b<|startoftext|>c <|endoftext", "\x00\x01 control \x7f \x85 \xa0nbsp", "ﬁ ligature é combining ​ zero", "a" * 5000, "ab " * 3000, "!@#$%^&*()_+-=[]{};':\",./<>?`~" * 20, "\n\n\n   x", "x   \n", "   ", "'", "''", "' s", "A'S b'T", "  ogham em", "\U00010400 deseret",
]


@pytest.fixture(scope="module")
def documents(spark, small):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


def tokenizer(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def encoding():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def all_texts(spark, documents):
    texts = TEXTS + [t for _, t in documents]
    return texts, frame(spark, [(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)


# Operator 4
def test_token_counts(spark, documents):
    tok = tokenizer("byte_bpe_50k.json")
    texts, docs = all_texts(spark, documents)
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"], rows[i]["over_limit"]) == (len((t or "").encode()), n, n > 1024), t


@pytest.mark.parametrize("table_size", [1, 100])
def test_counts_do_not_depend_on_the_tiers(spark, table_size):
    docs = frame(spark, [(i, t, None, None) for i, t in enumerate(TEXTS)], SCHEMA)
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, path).collect()}
    assert want == {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, path, table_size=table_size, sample_rows=1).collect()}


def test_small_cache_counts_alike():
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, tok = token_counts.Lengths(path, cache=3), tokenizer("byte_bpe_50k.json")
    for t in TEXTS:
        assert counter.count(t) == len(tok.encode(t or "", add_special_tokens=False).ids)


WIDE = ["“curly” quotes—dashes… and € signs, it’s ‘so’", "中文字符，没有空格的一段文字。日本語のテキスト", "emoji 😀 👩‍👩‍👧 🇩🇪 and ① Ⅷ 𝔘𝔫𝔦 𐐀𐐁", "ΣΑΣ Σ ΟΔΥΣΣΕΥΣ. İstanbul ǅ ẞ", "e\u0301 a\u0308\u0323 \u0301x K Å ﬁ", "a\u2003b\u3000c\u2028d\u1680 e\u200bf\ufeff g", "don’t 'll ’ll it's “it's”", "क्षि हिन्दी ไทย עברית العربية ٣٤ 12٣", "a\u00a0“\u0085”\u2029"]


def test_wide_texts_go_through_both_tiers(monkeypatch):
    """Counts and ids of texts beyond U+00FF are the libraries', and no such text is encoded whole."""
    r = random.Random(3)
    signs = "ab Z1'.,\n’“”—€é中文😀Σς\u0301\u2003\u3000ıİǅ٣"
    texts = WIDE + [" ".join(WIDE)] + ["".join(r.choice(signs) for _ in range(r.randint(1, 60))) for _ in range(2000)]
    a, b = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")
    counter, words = token_counts.Lengths(public_tokenizers.path("byte_bpe_50k.json")), packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for t in texts:
        assert counter.count(t) == len(a.encode(t, add_special_tokens=False).ids), t
        assert words.ids(t) == np.array(b.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
    assert "“" in counter.second.young and " quotes" in counter.second.young
    assert "“curly”" in words.cache.young and "quotes" not in words.cache.young and "dashes" not in words.cache.young


def test_frequent_table_holds_wide_pretokens(spark):
    docs = frame(spark, [(i, "“so” — 中文 é", None, None) for i in range(50)], SCHEMA)
    table, lengths = token_counts.frequent_lengths(docs, public_tokenizers.path("byte_bpe_50k.json"), 100, 40)
    assert {"“", "so", "”", " —", " 中文", " é"} <= set(table.split("\x01")) and len(lengths) == 2 * len(table.split("\x01"))


def test_caches_stay_bounded():
    cache = common.BoundedCache(lambda keys: [k + "!" for k in keys], 10)
    for i in range(200):
        key = str(i) * (1 + 40 * (i % 7))
        assert cache.values([key, "0"]) == [key + "!", "0!"]
        assert len(cache.young) + len(cache.old) <= 22


# Operator 9
def test_round_trip(spark, documents):
    enc = encoding()
    texts, docs = all_texts(spark, documents)
    rows = {r["doc_id"]: r for r in byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    for i, t in enumerate(texts):
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), t


def test_offsets_and_decoding(spark):
    docs = frame(spark, [(i, t, None, None) for i, t in enumerate(TEXTS)], SCHEMA)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(docs, path)
    enc = encoding()
    for r in encoded.collect():
        data = (TEXTS[r["doc_id"]] or "").encode()
        assert [data[a:b] for a, b in zip(r["offsets"], r["offsets"][1:], strict=False)] == [enc.decode_single_token_bytes(i) for i in r["ids"]]
    assert {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode(encoded, path).collect()} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("'stmdrevl \n\t ab1.!é\xa0"), st.characters(exclude_categories=["Cs", "Cn"], exclude_characters="\x00"))), max_size=5))
def test_pretokens_are_the_patterns(texts):
    import regex

    joined, places, counts = pretokens.pretokens(texts)
    at = places.tolist()
    cuts = [joined[a:b] for a, b in zip(at, [*at[1:], len(joined)], strict=True)]
    found, k = [], 0
    for n in counts.tolist():
        found.append(cuts[k : k + n])
        k += n + 1
    assert found == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]


def test_unknown_ids_are_refused():
    with pytest.raises(ValueError):
        byte_bpe.ByteBPE(public_tokenizers.path("byte_bpe_50k.tiktoken")).decode(np.array([10**6]))


# Operator 1
def packed_rows(spark, texts, **parameters):
    docs = frame(spark, [(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    return packing.pack(packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json")), **parameters).collect()


def check_packed(rows, texts, capacity=2048, max_docs=2048):
    tok = tokenizer("word_bpe_49k.json")
    want = {}
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want[i, k] = (at, len(own), zlib.crc32(own.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert len(rows) == len(want)
    held: dict = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and len(parts) <= max_docs
    return len(held), sum(n for _, n, _ in want.values())


def test_packing(spark, documents):
    texts = TEXTS + [t for _, t in documents]
    n, total = check_packed(packed_rows(spark, texts), texts)
    assert n <= -(-total // 2048) * 1.01 + 1


def test_groups_and_document_capacity(spark):
    r = random.Random(2)
    texts = [" ".join(f"w{r.randrange(50)}" for _ in range(r.choice([1, 5, 80, 600, 3000]))) for _ in range(120)]
    n, total = check_packed(packed_rows(spark, texts, group_rows=40), texts)
    assert n <= total / 2048 * 1.05 + 2
    check_packed(packed_rows(spark, texts, max_docs=3), texts, max_docs=3)
    check_packed(packed_rows(spark, texts, rule="dot"), texts)


def test_best_fit_obeys_every_capacity():
    r = np.random.default_rng(3)
    for rule in ("norm", "dot"):
        lengths = np.sort(r.integers(1, 200, 400))[::-1]
        bins, offsets = packing.best_fit(lengths, (256.0, 6.0, 40_000.0), (1.0, 0.3, 0.5), rule)
        for b in range(bins.max() + 1):
            own, at = lengths[bins == b], offsets[bins == b]
            assert own.sum() <= 256 and len(own) <= 6 and (own**2).sum() <= 40_000
            assert sorted(at) == [0, *np.cumsum(own[np.argsort(at)])[:-1]]
        assert bins.max() + 1 < 1.5 * lengths.sum() / 256


def test_best_fit_takes_the_fullest():
    """Residuals 10 and 30 are open; a piece of 10 goes to the first, one of 25 to the second."""
    bins, _ = packing.best_fit(np.array([90, 70, 25, 10]), (100.0, 9.0, 1e9), (1.0, 0.0, 0.0), "norm")
    assert bins.tolist() == [0, 1, 1, 0]
    with pytest.raises(ValueError):
        packing.best_fit(np.array([200]), (100.0, 9.0, 1e9), (1.0, 1.0, 1.0), "norm")


def test_sequences_hold_the_tokens(spark):
    texts = ["one two", None, "three " * 2500]
    docs = frame(spark, [(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    pieces = packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)
    made = packing.sequences(packing.pack(pieces), pieces).collect()
    tok = tokenizer("word_bpe_49k.json")
    assert sorted(x for s in made for x in s["tokens"]) == sorted(x for t in texts for x in [*tok.encode(t or "", add_special_tokens=False).ids, 0])
    assert all(len(s["tokens"]) <= 2048 for s in made)


def test_empty_tables(spark):
    docs = frame(spark, [], SCHEMA)
    for found in (token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")), byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")), packing.pack(packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json")))):
        assert found.count() == 0


def test_nulls_and_repeated_rows(spark):
    docs = frame(spark, [(1, "same", None, None), (1, "same", None, None), (None, "lost", None, None)], SCHEMA)
    assert token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 3
    assert byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 3
    rows = packing.pack(packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3


def test_queries_run_over_the_whole_table(spark, small, documents):
    for q in (queries.op4_token_counts, queries.op9_byte_bpe):
        assert sorted(r["doc_id"] for r in q(spark, small).collect()) == sorted(i for i, _ in documents)
    assert {r["doc_id"] for r in queries.op1_packing(spark, small).collect()} == {i for i, _ in documents}
