"""Quality rules against plain Python, and the base figures of awkward texts."""

import hashlib
import math
import re
from collections import Counter

import pytest

from tessera.llm import queries, quality_rules
from tests.llm.helpers import frame

SCHEMA = "doc_id long, text string, lang string, kept string, row int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", "   \t\n", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 500, "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3 + "end",
    "same line\nsame line\n\n \n same line\nsame line", "#*$%&|<> # *", "café naïve   em space  nbsp \x0b\x0c vertical", "\U0001f600 astral \U0001f600 signs " * 12,
    "ab " * 7 + "cd " + "ab " * 7, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8", "the of and to a in is that it was " * 30, "Der und die " * 60, "\n".join(f"row {i % 7}" for i in range(40)), "A\r\nA\r\nB",
]


def figures(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "base_failed": n < 20 or 100 * len(covered) > 30 * n}


def distance(p: list[float], q: list[float]) -> float:
    part = lambda a, m: a * math.log2(a / m) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum((part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2 for a, b in zip(p, q, strict=True))))


GOOD = "abcdefghij"
PROSE = {k: [f"the quick {k} fox ran over a hill and the dog saw that it was good . " + " ".join(GOOD[(i * j) % 10] * 3 for j in range(20)) for i in range(40)] for k in ("en", "de")}
LABELLED = [(1000 + 100 * n + i, t, k) for n, (k, ts) in enumerate(PROSE.items()) for i, t in enumerate(ts)]


@pytest.fixture(scope="module")
def references(spark):
    """Two languages of good texts; bad, unlabelled and unknown ones count for nothing."""
    docs = [*LABELLED, (1, "bad bad bad", "en"), (2, "unlabelled", "en"), (3, "few", "fr"), (4, "nolang", None), (5, None, "en")]
    labels = [(i, 1) for i, *_ in LABELLED] + [(1000, 1), (1, 0), (3, 1), (4, 1), (5, 1), (None, 1), (2, None), (99, 1)]
    return quality_rules.fit(frame(spark, docs, "doc_id long, text string, lang string"), frame(spark, labels, "doc_id long, quality int"))


def test_references(references):
    assert [r.lang for r in references] == ["de", "en"]
    for r in references:
        words = [w for t in PROSE[r.lang] for w in WORD.findall(t)]
        letters = Counter(w for w in words if w.isalpha())
        assert list(r.words) == [w for w, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[: quality_rules.COMMON_WORDS]]
        assert r.shares == pytest.approx([letters[w] / len(words) for w in r.words])
        text = "".join(PROSE[r.lang])
        assert r.classes == pytest.approx([sum(c.isalpha() for c in text) / len(text), 0, 0, text.count(" ") / len(text), text.count(".") / len(text), 0])
        assert r.without == pytest.approx(distance([0.0] * len(r.words) + [1.0], [*r.shares, 1 - sum(r.shares)]))


def test_references_of_a_sample(spark):
    """A draw by hash: the same whatever the order of rows, and of no more documents than asked for."""
    docs, labels = frame(spark, LABELLED, "doc_id long, text string, lang string"), frame(spark, [(i, 1) for i, *_ in LABELLED], "doc_id long, quality int")
    some = quality_rules.fit(docs, labels, min_reference_words=1, sample_rows=5)
    assert some == quality_rules.fit(docs.repartition(5), labels.orderBy("doc_id"), min_reference_words=1, sample_rows=5)
    drawn = sorted((i for i, *_ in LABELLED), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:5]
    assert {r.lang for r in some} == {k for i, _, k in LABELLED if i in drawn}


def test_references_of_all_good_texts(spark):
    """More documents than a draw would take: a word's share is that among all of them, repeated rows and null texts included."""
    n = quality_rules.SAMPLE_ROWS + 500
    docs = spark.range(n).selectExpr("id AS doc_id", "if(id = 7, null, if(id % 3 = 0, 'ab ab c1', 'cd')) AS text", "'en' AS lang")
    docs = docs.union(docs.where("doc_id = 9")).unionByName(spark.range(n, 2 * n).selectExpr("id AS doc_id", "'unlabelled' AS text", "'en' AS lang"))
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality").union(spark.range(n, n + 100).selectExpr("id", "0"))
    (found,) = quality_rules.fit(docs, labels)
    three = sum(i % 3 == 0 for i in range(n)) + 1
    words = 3 * three + n + 1 - three - 1
    assert found.words == ("ab", "cd") and found.shares == (2 * three / words, (n + 1 - three - 1) / words)


def word_distance(text: str, reference: quality_rules.Reference | None) -> float | None:
    words = WORD.findall(text)
    if reference is None or len(words) < quality_rules.MIN_WORDS:
        return None
    p = [words.count(k) / len(words) for k in reference.words]
    return distance([*p, 1 - sum(p)], [*reference.shares, 1 - sum(reference.shares)])


def test_figures(spark, references):
    langs = ["en", "de", None, "xx"]
    texts = TEXTS + [" ".join(PROSE["en"][:4])] * 4
    docs = frame(spark, [(i, t, langs[i % 4], "no", 7) for i, t in enumerate(texts)], SCHEMA)
    of = {r.lang: r for r in references}
    for r in quality_rules.judge(docs, references).collect():
        text, lang = texts[r["doc_id"]], langs[r["doc_id"] % 4]
        assert {k: r[k] for k in figures(text)} == figures(text), text
        expected = word_distance(text or "", of.get(lang))
        assert r["word_distance"] == (expected and pytest.approx(expected, abs=1e-9))
        far = (r["class_distance"] or 0) > quality_rules.MAX_CLASS_DISTANCE or expected is not None and expected > quality_rules.WORD_LIMIT * of[lang].without
        assert r["kept"] == (not r["base_failed"] and not far)


def test_keep_has_all_columns(spark, references):
    docs = frame(spark, [(i, t, "en", "no", 7) for i, t in enumerate(TEXTS)] + [(None, TEXTS[14], None, None, None)], SCHEMA)
    verdicts = quality_rules.judge(docs, references).where("kept")
    kept = quality_rules.keep(docs, references)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in verdicts.collect())
    clash = docs.selectExpr("doc_id", "text", "lang", "kept AS ref_lang", "row AS n", "row AS words", "row AS ref_limit")
    assert quality_rules.keep(clash, references).columns == clash.columns and quality_rules.keep(clash, references).count() == kept.count()


def test_empty_table(spark):
    none = quality_rules.fit(frame(spark, [], SCHEMA), frame(spark, [], "doc_id long, quality int"))
    assert none == []
    assert quality_rules.judge(frame(spark, [], SCHEMA), none).count() == 0
    assert quality_rules.keep(frame(spark, [], SCHEMA), none).count() == 0
    r = quality_rules.judge(frame(spark, [(1, " ".join(f"w{i}" for i in range(200)), "en", "", 0)], SCHEMA), none).first()
    assert r["kept"] and r["class_distance"] is None and r["word_distance"] is None


def test_prose_stays_and_junk_goes(spark, small):
    """Of the documents, those labelled good are kept; no Python runs."""
    found = queries.op10_quality_rules(spark, small)
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString())
    good = found.join(spark.read.parquet(f"{small}/labels.parquet").where("quality = 1"), "doc_id").select("kept").collect()
    assert sum(r["kept"] for r in good) >= 0.95 * len(good)


def test_prose_without_common_words_goes(spark, small):
    """Long prose with none of a language's common words is rejected in every language, the same with a usual share of them stays."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    references = quality_rules.fit(docs, labels)
    assert {r.lang for r in references} == {"en", "de", "fr", "es"}
    made = lambda i: "".join("bdfgklmnprstvz"[i // 14**j % 14] + "aeiou"[(i + j) % 5] for j in range(3))
    prose = lambda words: " ".join(w.capitalize() if i % 8 == 0 else w + "." if i % 8 == 7 else w for i, w in enumerate(words))
    rows = []
    for k, ref in enumerate(references):
        bare = [made(i) for i in range(400)]
        usual = [w for w, s in zip(ref.words, ref.shares, strict=True) for _ in range(round(400 * s))]
        mixed = [usual[i // 2] if i % 2 and i // 2 < len(usual) else w for i, w in enumerate(bare)]
        rows += [(2 * k, prose(bare), ref.lang, "", 0), (2 * k + 1, prose(mixed), ref.lang, "", 0)]
    found = {r["doc_id"]: r for r in quality_rules.judge(frame(spark, rows, SCHEMA), references).collect()}
    assert all(r["class_distance"] <= quality_rules.MAX_CLASS_DISTANCE and not r["base_failed"] for r in found.values())
    assert {i: r["kept"] for i, r in found.items()} == {i: i % 2 == 1 for i in range(2 * len(references))}


def test_very_long_text(spark, references):
    text = " ".join(f"w{i % 50_000}" for i in range(60_000))
    r = quality_rules.judge(frame(spark, [(1, text, "en", "", 0)], SCHEMA), references).first()
    assert {k: r[k] for k in figures(text)} == figures(text)
