"""Near-dedup against all pairs on full sets."""

import random

import pytest

from tessera.llm import minhash, queries
from tests.llm.helpers import components, frame

SCHEMA = "doc_id long, text string, key string, component_id long, n int"


def sets(text: str | None, width: int) -> frozenset:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(docs: list[tuple[int, str | None]], width: int) -> dict[int, tuple]:
    found = {i: sets(t, width) for i, t in docs}
    ids = sorted(found)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if found[a] and found[b] and 100 * len(found[a] & found[b]) >= 80 * len(found[a] | found[b])]
    least = components(ids, links)
    return {i: (len(found[i]), least[i], least[i] == i) for i in ids}


def check(spark, docs, width=5):
    rows = minhash.components(frame(spark, [(i, t, "k", 1, 2) for i, t in docs], SCHEMA), width).collect()
    assert len(rows) == len(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == brute(docs, width)


def edited(r: random.Random, words: list[str], share: float) -> str:
    return " ".join(w if r.random() > share else f"n{r.randrange(10**6)}" for w in words)


@pytest.mark.parametrize("width", [4, 5])
def test_families_of_edits(spark, width):
    """Texts with edits that put pairs on both sides of the threshold, copies, and a passage that many share."""
    r = random.Random(width)
    passage = [f"p{i}" for i in range(40)]
    docs, n = [], 0
    for _ in range(8):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.choice([12, 60, 200]))] + passage
        for share in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1):
            docs.append((n, edited(r, base, share)))
            n += 1
    r.shuffle(docs)
    check(spark, docs, width)


def test_chain_and_hot_group(spark):
    """A chain whose ends are far apart, and a large group of copies and near copies."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    chain = [(i, " ".join(words[:i] + [f"x{k}" for k in range(i)] + words[2 * i :])) for i in range(0, 60, 3)]
    base = [f"h{r.randrange(10**5)}" for _ in range(80)]
    hot = [(1000 + i, " ".join(base)) for i in range(60)] + [(2000 + i, edited(r, base, 0.02)) for i in range(60)]
    check(spark, chain + hot)


def test_awkward_texts(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\x0btwo"), (6, "one two three four five"), (7, "One Two Three Four Five"), (8, "Éone two"), (9, "éone two"), (10, "one two"), (11, "one\x85two"), (12, "one two three four five six"), (13, "a a a a a a a a a a"), (14, "a a a a a a")]
    check(spark, docs)
    check(spark, docs, 4)


def test_repeated_ids_nulls_and_empty(spark):
    text, other = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = minhash.components(frame(spark, [(1, text), (1, text), (1, other), (None, text), (5, other)], "doc_id long, text string")).collect()
    assert len(rows) == 5
    assert {r["component_id"] for r in rows} == {1}
    assert minhash.components(frame(spark, [], "doc_id long, text string")).count() == 0
    kept = minhash.keep(frame(spark, [(1, text, "a"), (2, text, "b"), (3, other, None), (None, text, "c")], "doc_id long, text string, kept string"))
    assert sorted((str(r["doc_id"]), r["kept"]) for r in kept.collect()) == [("1", "a"), ("3", None)]


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, several texts of one id, and near copies without an id leave one row; rows without words all stay."""
    a, b = [f"w{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    text, upper, near, other = " ".join(a), " ".join(a).upper(), " ".join([*a, "x"]), " ".join(b)
    docs = [(7, text), (7, text), (7, upper), (9, near), (None, near), (None, other), (None, other), (None, " ".join([*b, "y"])), (3, ""), (3, ""), (None, None), (None, " ")]
    for n in (1, 3):
        kept = minhash.keep(frame(spark, [(i, t, "x", 1) for i, t in docs], "doc_id long, text string, place string, PLACE_ int").repartition(n))
        assert kept.columns == ["doc_id", "text", "place", "PLACE_"]
        found = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert sorted(map(str, (f for f in found if f[1] and f[1].strip() and f[0] is None))) in (["(None, '%s')" % other], ["(None, '%s')" % " ".join([*b, "y"])])
        assert len([f for f in found if f[0] == 7]) == 1 and not [f for f in found if f[0] == 9]
        assert sorted(str(f) for f in found if not (f[1] or "").strip()) == ["(3, '')", "(3, '')", "(None, ' ')", "(None, None)"]


def test_sketches_lose_no_pair():
    """Of any pair over the threshold, both sketches list the rarest value they share, however common the others are."""
    r = random.Random(11)
    for percent in (80, 60, 95):
        for n in range(1, 400):
            assert 1 <= minhash._kept(n, percent) - minhash._dropped(n, percent) <= minhash._kept(n, percent) <= n
        for _ in range(400):
            i = r.randint(1, 300)
            x = r.randint(0, int(i * (100 - percent) / percent))
            y = r.randint(0, max(0, int(i * 100 / percent) - i - x))
            values = r.sample(range(10**6), i + x + y)
            r.shuffle(values)
            one, two = sorted(values[: i + x]), sorted(values[:i] + values[i + x :])
            if 100 * i < percent * (i + x + y):
                continue
            counts = {v: r.choice([1, 2, 9]) for v in values}
            lists = []
            for s in (one, two):
                sketch = s[: minhash._kept(len(s), percent)]
                lists.append(set(sorted(sketch, key=lambda v: (counts[v], v))[: len(sketch) - minhash._dropped(len(s), percent)]))
            assert lists[0] & lists[1]


def test_hot_values_and_leaders_are_dealt(spark, monkeypatch):
    """The same links when every list and leader is dealt over many places."""
    monkeypatch.setattr(minhash, "MEMBERS_EACH", 3)
    monkeypatch.setattr(minhash, "LISTED_EACH", 4)
    r = random.Random(21)
    base = [f"h{i}" for i in range(150)]
    docs = [(i, edited(r, base, 0.004 * (i % 12))) for i in range(90)] + [(200 + i, " ".join(base[:60] + [f"q{i}_{j}" for j in range(90)])) for i in range(40)]
    check(spark, docs)


def test_blocks_lose_no_link(spark):
    """Small blocks and one leader of many."""
    r = random.Random(4)
    common = [f"c{i}" for i in range(100)]
    docs = [(i, " ".join(edited(r, common, 0.01).split() + [f"u{i % 9}_{k}" for k in range(25)])) for i in range(120)]
    rows = minhash.components(frame(spark, docs, "doc_id long, text string"), 5, block=8).collect()
    assert {q["doc_id"]: (q["n_shingles"], q["component_id"], q["kept"]) for q in rows} == brute(docs, 5)


def test_whole_table(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op8_minhash(spark, small).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == brute(docs, 4)
