"""Personal data: base spans against the contract's patterns, and what the model adds."""

import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
import pytest

from tessera.llm import char_tagger, pii, queries
from tests.llm.helpers import frame

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def good(kind: str, text: str) -> bool:
    digits = re.sub("[^0-9]", "", text)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in text.split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def brute(text: str | None) -> list[tuple]:
    found = [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PATTERNS[k], text or "") if good(k, m[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def said(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


TEXTS = [
    None, "", "nothing here", "a@b.c", "mail joe.x+y@mail-host.example.com now", "a@b", "@b.c x@y.z@w.v", "x@@y.z", "a@b..c", "a@b.c.", "%@-.-", "é@b.cc ü.a@b.cc", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1 2.2.2.2", "01.002.0003.4", "1.2.3", "999999999999999999999.1.1.1 1.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 x 4111111111111112", "4111  1111 1111 1111", "4111 1111 1111 1111 4111 1111 1111 1111", "000000000000", "+1 (555) 123-4567", "+49 170 1234567 and +49", "+1 2", "++12345678901", "+12.34.56.78.90", "+1(((((((((23456789", "٣٤٥@b.c +٣٤٥٦٧٨٩٠١", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    "\U0001f600 a@b.co \U0001f600 +1 555 123 4567", "a" * 3000 + "@" + "b." * 500, "@" * 2000, "1" * 3000, "1.1." * 800, "+" + "1 " * 900, "a@" * 900,
]


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_are_the_patterns(seed):
    r = random.Random(seed)
    for _ in range(800):
        text = "".join(r.choice(["@", ".", "a", "B", "1", "0", "4", "+", "-", " ", "(", ")", "%", "é", "\n", "1.2", "a@b.c", "4111 1111 1111 1111", "+1 555 123 4567", "10.0.0.1"]) for _ in range(r.randint(1, 25)))
        assert pii.base_spans(text) == brute(text), repr(text)
    for text in TEXTS:
        assert pii.base_spans(text) == brute(text)


def test_find(spark):
    docs = frame(spark, [(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string, n_ip int")
    rows = pii.find(docs).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        base = brute(TEXTS[r["doc_id"]])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in base) for k in KINDS]
        assert r["base_sha256"] == hashlib.sha256(said(base).encode()).hexdigest()
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))
        assert all(0 <= s < e <= len(TEXTS[r["doc_id"]]) for _, s, e in spans)


def test_model_finds_unusual_spellings():
    """On unseen labelled texts, spans of the four kinds in spellings that the base patterns miss."""
    tagger, examples = char_tagger.trained(), char_tagger.labelled(400, seed=77)
    found = tagger.tag([t for t, _ in examples])
    truth = [(i, *s) for i, (_, spans) in enumerate(examples) for s in spans]
    got = [(i, *s) for i, spans in enumerate(found) for s in spans]
    hit = len(set(truth) & set(got))
    assert hit / len(truth) > 0.95 and hit / len(got) > 0.95
    both = pii.all_spans([t for t, _ in examples], tagger)
    missed = [(i, s) for i, (_, spans) in enumerate(examples) for s in spans if s not in both[i][0]]
    missed = [(i, s) for i, s in missed if not any(a < s[2] and s[1] < e for _, a, e in both[i][0])]  # base spans stay
    assert len(missed) > 300 and sum(s in both[i][1] for i, s in missed) > 0.95 * len(missed)
    added = [(i, s) for i, (base, spans) in enumerate(both) for s in spans if s not in base]
    assert sum(s in examples[i][1] for i, s in added) > 0.98 * len(added)


@pytest.mark.parametrize("kind,spelling", [("card", "4111.1111.1111.1111"), ("card", "5555/5555/5555/4444"), ("card", "4111  1111  1111  1111"), ("phone", "(555) 123-4567"), ("phone", "555.867.5309"), ("phone", "0049 170 1234567"), ("ip", "192[.]168[.]10[.]1"), ("ip", "10 . 20 . 30 . 40"), ("email", "anna.stone (at) larende.org"), ("email", "Rolande at tingerhan dot com"), ("email", "resti @ landering.de")])
def test_real_spellings(kind, spelling):
    """Spellings without a base span; some have neither a digit nor "@", so all of a text must be read."""
    assert not [s for s in brute(spelling) if s[0] == kind]
    for before, after in (("the tingen de la ", " and the onder."), ("Erander ouch: ", "\nLa reti onande"), ("nd the anti. " * 70, " that en la chande" * 40)):
        assert (kind, len(before), len(before) + len(spelling)) in pii.all_spans([before + spelling + after], char_tagger.trained())[0][1], before[-20:]


def test_prose_is_left_alone():
    """Dates, versions, amounts and words are no personal data."""
    for text in ("meet at noon. Then at the dot of two.", "on 2024-05-12 and 12.05.2024, 2024/05/12 10:30", "version 1.2.3 of 10.4", "1.234.567,89 or 12,50", "pages 123-456", "#123456 is order 4155"):
        assert pii.all_spans([text * 5], char_tagger.trained())[0][1] == pii.all_spans([text * 5], char_tagger.trained())[0][0], text


def test_decoding_is_the_best_path():
    """Viterbi against all paths; a window's own padding changes nothing."""
    rng = np.random.default_rng(4)
    model = char_tagger.Tagger(hidden=3, seed=2)
    model.w["a"] = rng.normal(0, 1, (5, 5))
    e = rng.normal(0, 1, (4, 5, 6))
    found = model._viterbi(e)
    for j in range(6):
        score = lambda y, j=j: sum(e[k, y[k], j] for k in range(4)) + sum(model.w["a"][a, b] for a, b in zip(y, y[1:], strict=False))
        assert tuple(found[:, j]) == max(itertools.product(range(5), repeat=4), key=score)
    texts = ["tel. (555) 123-4567", "", "x", "mail a @ bonde.de " * 80]
    tagger = char_tagger.trained()
    assert tagger.tag(texts) == [tagger.tag([t])[0] for t in texts]


def _decoded(model, e, lengths):
    """Labels of windows (time, label, batch), by runs of positions that may be labelled."""
    window, at, begin, scores = model._open(e, lengths)
    out = np.zeros((e.shape[0], e.shape[2]), np.int8)
    out[at, window] = model._decode(scores, begin, cells=50)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_have_the_best_path_of_the_window(seed):
    """What is left out of decoding has no label on the best path, whatever the steps between labels cost."""
    rng = np.random.default_rng(seed)
    model = char_tagger.Tagger(hidden=3, seed=2)
    for scale, none in itertools.product((0.0, 1.0, 4.0), (-3.0, 0.0, 3.0, 9.0)):
        model.w["a"] = rng.normal(0, scale, (5, 5)) + rng.choice([0.0, 2.0]) * np.eye(5)
        lengths = np.sort(rng.integers(1, 31, 40))
        lengths[-1] = 30
        e = rng.normal(0, 2, (30, 5, 40)).astype(np.float32)
        e[:, 0] += np.float32(none)
        found = _decoded(model, e, lengths)
        for j, n in enumerate(lengths):
            assert (found[:n, j] == model._viterbi(np.ascontiguousarray(e[:n, :, j : j + 1]))[:, 0]).all() and not found[n:, j].any()


def test_decoding_skips_plain_prose(monkeypatch):
    """Every character is scored; the best path is searched for only where it may have a label."""
    decoded, scored, tagger = [], [], char_tagger.trained()
    viterbi, scores = char_tagger.Tagger._viterbi, char_tagger.Tagger.scores
    monkeypatch.setattr(char_tagger.Tagger, "_viterbi", lambda self, e, **k: decoded.append(e.shape[0] * e.shape[2]) or viterbi(self, e, **k))
    monkeypatch.setattr(char_tagger.Tagger, "scores", lambda self, x: scored.append(x.size) or scores(self, x))
    texts = ["nd the anti. " * 200, "La reti onande erander ouch " * 150, "so it is " * 100 + "call (555) 123-4567" + " and the onder" * 50]
    found = tagger.tag(texts)
    assert [s for s in found[2] if s[0] == "phone"] == [("phone", 905, 919)]
    assert sum(scored) >= sum(map(len, texts)) > 5 * sum(decoded)


def test_single_precision_scores():
    model = char_tagger.Tagger(hidden=5, seed=3)
    x = np.random.default_rng(1).integers(0, 130, (40, 7))
    assert np.allclose(model.scores(x), model.emissions(x), atol=1e-4)


def test_work_on_a_character():
    """Scores of all windows keep no states: what is held at once is little more than the scores themselves."""
    model, x = char_tagger.Tagger(seed=3).single(), np.random.default_rng(1).integers(0, 130, (512, 400))
    tracemalloc.start()
    e = model.scores(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert e.transpose(0, 2, 1).flags.c_contiguous and most < e.nbytes + 2 * x.nbytes + (4 << 20)


def test_repeated_rows(spark):
    docs = frame(spark, [(1, "call (555) 123-4567"), (1, "call (555) 123-4567"), (None, "a@b.cc")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["spans"]) for r in pii.find(docs).collect()) == [(0, "email:0:6"), (1, "phone:5:19"), (1, "phone:5:19")]


def test_windows_agree_with_the_whole():
    """Long texts are decoded across windows: the same entity is found wherever the windows fall."""
    tagger = char_tagger.trained()
    for pad in (0, 1, 31, 63, 64, 95, 200):
        text = "so " * pad + "call (555) 123-4567 or write to joe.smith@mail.example.com today"
        at = text.index("(555)")
        kinds = {k for k, s, e in pii.all_spans([text], tagger)[0][1] if s >= at}
        assert "email" in kinds and "phone" in kinds, pad


def test_gradients():
    """Backpropagation against finite differences."""
    model = char_tagger.Tagger(hidden=3, seed=1)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 100, (7, 4)), rng.integers(0, 5, (7, 4))
    _, g = model.loss(x, y)
    for name, w in model.w.items():
        for at in [tuple(int(rng.integers(n)) for n in w.shape) for _ in range(6)]:
            if name in ("tf", "tb"):
                at = (int(x[int(rng.integers(7)), int(rng.integers(4))]), at[1])
            old, e = w[at], 1e-5
            w[at] = old + e
            up = model.loss(x, y)[0]
            w[at] = old - e
            down = model.loss(x, y)[0]
            w[at] = old
            assert g[name][at] == pytest.approx((up - down) / (2 * e) * 7, abs=1e-5), name


def test_redact(spark):
    docs = frame(spark, [(1, "mail a.b@c.de or 10.0.0.1", 25, "x"), (2, None, None, None), (3, "clean", 5, None)], "doc_id long, text string, n_chars long, kind string")
    rows = {r["doc_id"]: r for r in pii.redact(docs, length_column="n_chars").collect()}
    assert rows[1]["text"] == "mail [EMAIL] or [IP]" and rows[1]["n_chars"] == 20 and rows[1]["kind"] == "x"
    assert rows[2]["text"] is None and rows[2]["n_chars"] is None and rows[3]["text"] == "clean"
    assert pii.mask("abcdef", [("ip", 1, 4), ("phone", 2, 5)]) == "a[IP]f"


def test_empty_and_whole_table(spark, small):
    assert pii.find(frame(spark, [], "doc_id long, text string")).count() == 0
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op2_pii(spark, small).collect():
        assert r["base_sha256"] == hashlib.sha256(said(brute(docs[r["doc_id"]])).encode()).hexdigest()
