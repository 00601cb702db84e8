"""The quality classifier, and the pipeline stage by stage on the rows that each stage gets."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import minhash, pii, quality_classifier, quality_rules, queries
from tests.llm.helpers import components, frame
from tests.llm.test_minhash import sets


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op7_quality_classifier(spark, sf).toPandas()
    assert ((found.score >= 0) & (found.score <= 1)).all() and (found.predicted == (found.score >= 0.7)).all()
    assert found.held_out.tolist() == [held_out(i) for i in found.doc_id]
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    unseen = found[found.held_out].merge(labels, on="doc_id")
    assert len(unseen) > 50 and (unseen.predicted == unseen.quality).mean() > 0.93


def test_labels_of_held_out_rows_change_nothing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality")
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_classifier.fit(docs, labels), quality_classifier.fit(docs, turned)
    assert (a.vectors == b.vectors).all() and (a.layer == b.layer).all() and (a.bias == b.bias).all()


def test_features_are_hashed_words_and_ngrams():
    p = quality_classifier.Parameters()
    words = ["a", "naïve", "日本語", "long-er", "a"]
    ids, counts = quality_classifier.features([w.encode() for w in words], p)
    grams = [[w] + [f"<{w}>"[i : i + n] for n in (2, 3, 4) for i in range(len(w) + 3 - n)] for w in words]
    assert counts.tolist() == list(map(len, grams))
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert parts[0].tolist() == parts[4].tolist()
    names: dict = {}
    for ngrams, got in zip(grams, parts, strict=True):  # equal n-grams have equal buckets, wherever they stand
        for g, b in zip(ngrams[1:], got[1:].tolist(), strict=True):
            assert names.setdefault(g, b) == b
    assert (ids >= 0).all() and (ids < p.buckets).all()


def test_score_is_the_models_softmax(spark):
    """The look-up of words gives what averaging the vectors and the softmax layer give."""
    p = quality_classifier.Parameters(buckets=512)
    good, bad = ["fine prose of the land", "the land was fine and calm"], ["buy now cheap cheap", "click buy cheap now"]
    docs = frame(spark, [(i, t) for i, t in enumerate((good + bad) * 20)], "doc_id long, text string")
    labels = frame(spark, [(i, int(i % 4 < 2)) for i in range(80)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels, p)
    texts = [*good, *bad, None, "", "  \n", "Unseen wörds"]
    rows = {r["doc_id"]: r for r in quality_classifier.score(frame(spark, list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        mean = model.vectors[quality_classifier.features(words, p)[0]].mean(axis=0) if words else np.zeros(p.dim)
        z = mean @ model.layer + model.bias
        assert rows[i]["score"] == pytest.approx(1 / (1 + math.exp(z[0] - z[1])), abs=1e-9)
    assert min(rows[0]["score"], rows[1]["score"]) > 0.7 > 0.3 > max(rows[2]["score"], rows[3]["score"])


@pytest.mark.parametrize("more", [{}, {"piece": 300}])
def test_every_labelled_row_is_learned(spark, more):
    """There are more rows than a part holds; a part is learned in pieces too. Any row's label changes the model, the order of rows
    and labels does not."""
    p, n = quality_classifier.Parameters(buckets=1 << 10, sample_rows=20), 200
    docs = frame(spark, [(i, f"w{i} {'good' if i % 2 else 'bad'}", "x") for i in range(n)] + [(3, "again", "x"), (None, "none", "y")], "doc_id long, text string, lang string")
    given = {i: i % 2 for i in range(n)}
    fit = lambda labels, docs=docs: quality_classifier.fit(docs, frame(spark, [*labels.items(), (None, 1), (7, None)], "doc_id long, quality int"), p, **more)
    model = fit(given)
    for i in [i for i in range(n) if not held_out(i)][::30]:
        assert (fit(given | {i: 1 - given[i]}).odds()[0] != model.odds()[0]).any(), i
    again = fit(dict(reversed(given.items())), docs.repartition(7))
    assert (again.odds()[0] == model.odds()[0]).all() and (again.bias == model.bias).all()


@pytest.mark.parametrize("more", [{"piece": 1}, {"sample_rows": 4}])
def test_one_model_of_all_rows_however_they_are_dealt(spark, more):
    """Blocks and parts that hold one class only, and few of the rarer one, give the model of all rows in one."""
    n, few = 120, 12
    rows = [(i, f"the land was {'fine and calm' if i >= few else 'cheap buy now'} w{i % 7}") for i in range(n)]
    docs, labels = frame(spark, rows, "doc_id long, text string"), frame(spark, [(i, int(i >= few)) for i in range(n)], "doc_id long, quality int")
    size = {"buckets": 1 << 10}
    whole = quality_classifier.fit(docs, labels, quality_classifier.Parameters(**size, sample_rows=n))
    dealt = quality_classifier.fit(docs, labels, quality_classifier.Parameters(**size, sample_rows=more.get("sample_rows", n)), piece=more.get("piece", quality_classifier.PIECE))
    of = lambda m: {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, m).collect()}
    a, b = of(whole), of(dealt)
    assert all((b[i] >= 0.7) == (i >= few) for i in range(n))
    assert all(b[i] == pytest.approx(a[i], abs=1e-3) for i in range(n))


def test_blocks_hold_all_features():
    """Counts and distances of more than a byte, the first and the last bucket, documents of one feature."""
    docs = [(1, [0, 1, 255, 256, 511, 65_535], [1, 255, 256, 510, 511, 70_000]), (0, [65_535], [3]), (0, [0], [1]), (1, [254, 509, 1_020], [254, 1, 2])]
    lengths, classes, ids, counts = quality_classifier._documents(*quality_classifier._block([(c, np.array(i), np.array(n)) for c, i, n in docs]))
    ends = np.cumsum(lengths)[:-1]
    for (c, i, n), got, ids_, counts_ in zip(docs, classes, np.split(ids, ends), np.split(counts, ends), strict=True):
        total = np.bincount(ids_, weights=counts_)
        assert got == c and np.flatnonzero(total).tolist() == i and total[i].tolist() == n


def test_few_labels_nulls_and_empty(spark):
    docs = frame(spark, [(1, "a b", "x"), (3, None, None), (None, "c", "y")], "doc_id long, text string, score string")
    none = quality_classifier.fit(docs, frame(spark, [], "doc_id long, quality int"))
    assert {r["score"] for r in quality_classifier.score(docs, none).collect()} == {0.5}
    one = quality_classifier.fit(docs, frame(spark, [(1, 1), (3, None), (None, 0)], "doc_id long, quality int"))
    assert all(r["score"] > 0.5 for r in quality_classifier.score(docs, one).collect())
    assert quality_classifier.score(frame(spark, [], "doc_id long, text string"), one).count() == 0
    clash = docs.selectExpr("doc_id", "text", "score", "1 AS score_", "2 AS predicted")
    assert quality_classifier.keep(clash, one, 0.5).columns == clash.columns
    assert sorted(str(r["score"]) for r in quality_classifier.keep(clash, one, 0.5).collect()) == ["None", "x", "y"]


# The pipeline
@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """What each stage was given and returned, written as Parquet and read again."""
    at = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, small).write.parquet(f"{at}/{k}")
        after = spark.read.parquet(f"{at}/{k}")
        out.append((name, docs, after))
        docs = after
    return out


def table(df) -> dict:
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_and_columns(stages, small, spark):
    columns = spark.read.parquet(f"{small}/documents.parquet").columns
    assert [s[0] for s in stages] == ["quality_rules", "quality_classifier", "minhash_dedup", "pii", "packing"]
    assert all(sorted(s[2].columns) == sorted(columns) for s in stages[:-1])


def test_rules_stage(stages, spark, small):
    _, before, after = stages[0]
    references = quality_rules.fit(before, spark.read.parquet(f"{small}/labels.parquet"))
    assert set(table(after)) == {r["doc_id"] for r in quality_rules.judge(before, references).where("kept").collect()}
    assert 0 < after.count() < before.count()


def test_classifier_stage(stages, spark, small):
    _, before, after = stages[1]
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    assert set(table(after)) == {r["doc_id"] for r in quality_classifier.score(before, model).where("predicted = 1").collect()}


def test_rules_stage_counts_every_label(spark, tmp_path):
    """A language has enough words for a reference among all good texts, but not in a draw of 8,000 of them."""
    n, few = 10_000, 104
    rows = [(i, "some words of the few " * 2 if i < few else "ab", "xx" if i < few else "yy") for i in range(n)]
    junk = " ".join(f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs") + " " + " ".join(f"{a}{b}" for a in "bdfgk" for b in "aeiou")
    spark.createDataFrame([*rows, (n, junk, "xx")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(n).selectExpr("id AS doc_id", "1 AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    asked = frame(spark, [(n, junk, "xx"), (n + 1, junk, "zz")], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.rules(spark, asked, str(tmp_path)).collect()] == [n + 1]


def test_dedup_stage(stages):
    _, before, after = stages[2]
    found = {i: sets(t, 5) for i, t in table(before).items()}
    ids = sorted(found)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if found[a] and found[b] and 100 * len(found[a] & found[b]) >= 80 * len(found[a] | found[b])]
    least = components(ids, links)
    assert set(table(after)) == {i for i in ids if least[i] == i}


def test_pii_stage(stages):
    _, before, after = stages[3]
    texts, masked = table(before), table(after)
    spans = dict(zip(texts, pii.all_spans(list(texts.values()), pii.trained()), strict=True))
    assert masked == {i: pii.mask(t, spans[i][1]) for i, t in texts.items()}
    assert all(not pii.base_spans(t) or spans[i][0] for i, t in masked.items())
    assert {r["doc_id"]: r["n_chars"] for r in after.collect()} == {i: len(t) for i, t in masked.items()}


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    _, before, after = stages[4]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in table(before).items()}
    rows = after.collect()
    got: dict = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == total
    assert len({r["sequence_id"] for r in rows}) <= math.ceil(sum(total.values()) / 2048) + 1


def test_run_gives_the_last_stages_rows(spark, small, stages):
    pick = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert pick(corpus_pipeline.run(spark, small)) == pick(stages[-1][2])


def test_stages_stand_nulls_and_no_rows(spark, small):
    schema = spark.read.parquet(f"{small}/documents.parquet").schema
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "x", "en", "s", 1), (3, "", "en", None, 0)], schema)
    for _, f in corpus_pipeline.STAGES:
        f(spark, docs, small).count()
        assert f(spark, spark.createDataFrame([], schema), small).count() == 0


def test_stages_keep_extra_columns_of_any_name(spark, small):
    """Names that the operators use themselves."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    docs = docs.selectExpr("*", "'x' AS score", "doc_id AS key", "1 AS kept", "lang AS ref_lang", "2 AS n_words", "'y' AS component_id", "3 AS row", "text AS t", "4 AS c")
    for _, f in corpus_pipeline.STAGES[:-1]:
        after = f(spark, docs, small)
        assert after.columns == docs.columns and after.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() >= 60


def test_copies_of_one_text_leave_one(spark):
    docs = frame(spark, [(i, "the same words again and again in one text", "x") for i in range(40)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in minhash.keep(docs).collect()] == [0]
