import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import language, quality, queries, toxicity, training
from noticeflow.llm.common import held_out

HELD = [k for k in range(5000) if zlib.crc32(str(k).encode()) % 5 == 0]


@pytest.fixture(scope="module")
def middle():
    return "/root/testdata/sf0.01"


def test_fold(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), held_out().alias("h")).collect()
    assert [r.doc_id for r in rows if r.h] == [k for k in HELD if k < 3000]


def test_language(spark, middle):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{middle}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op1_language_id(spark, middle).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    kept = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in kept]) > 0.97
    assert {r.lang_pred for r in rows} <= {*lang.values(), "und"}


def test_language_of_odd_rows(docs_of, odd_texts):
    texts = odd_texts + ["der die das und nicht " * 3, "the of and that " * 3] * 30
    docs = docs_of(texts, [None] * len(odd_texts) + ["de", "en"] * 30)
    rows = {r.doc_id: r for r in language.predict(docs, language.train(docs)).collect()}
    assert len(rows) == len(texts)
    assert [rows[i].lang_pred for i in (0, 1, 2, 3)] == ["und"] * 4
    assert rows[len(odd_texts)].lang_pred == "de" and rows[len(odd_texts) + 1].lang_pred == "en"
    assert language.train(docs_of([])) is None
    assert [r.lang_pred for r in language.predict(docs_of(["some text"]), None).collect()] == ["und"]
    assert language.has_letter("1²Ⅷ_é") and not language.has_letter("12²_ .") and not language.has_letter(None)


def test_ngram_counts_do_not_depend_on_blocks(monkeypatch):
    text = "Der schnelle braune Fuchs springt über den faulen Hund. " * 5
    whole = language.counts(text)
    monkeypatch.setattr(language, "BLOCK", 7)
    parts = language.counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_document_frequencies(docs_of):
    texts = [f"abc {i % 3}" for i in range(40)] + [None]
    total, n = language.document_frequencies(docs_of(texts), "lang", "text", "doc_id")
    own = [t for i, t in enumerate(texts) if t and i not in HELD]
    want = np.zeros(1 << language.BITS, int)
    for t in own:
        want[language.counts(t)[0]] += 1
    assert total == len(own) and (n == want).all()


@pytest.mark.parametrize("query,label,least", [(queries.op4_quality_classifier, "quality", 0.97), (queries.op8_toxicity, "toxic", 0.75)])
def test_labels_are_learned(spark, middle, query, label, least):
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{middle}/labels.parquet").select("doc_id", label).collect()}
    rows = query(spark, middle).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    kept = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    ones, zeros = [s for s, y in kept if y], [s for s, y in kept if not y]
    assert np.mean([[(a > b) + (a == b) / 2 for b in zeros] for a in ones]) > least


@pytest.mark.parametrize("kind,label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, docs_of, odd_texts, kind, label):
    docs = docs_of(odd_texts + ["good words of a text"] * 40 + ["bad bad bad trash"] * 40)
    first = len(odd_texts)
    labels = spark.createDataFrame([(i, int((i < first + 40) == (label == "quality"))) for i in range(first, first + 80)] + [(None, 1), (1, None), (first, 1)], f"doc_id long, {label} int")
    model = kind.train(docs, labels)
    rows = {r.doc_id: r for r in kind.scores(docs, model).collect()}
    assert len(rows) == first + 80 and rows[0].score == rows[1].score and rows[6].score == rows[7].score
    assert (rows[first].score > rows[first + 79].score) == (label == "quality")
    nothing = kind.train(docs_of([]), labels.limit(0))
    assert len({r.score for r in kind.scores(docs, nothing).collect()}) == 1
    assert kind.scores(docs_of([]), model).count() == 0


def test_word_cache_gives_the_average(docs_of):
    rows = [(i, t, i % 2) for i, t in enumerate(["aa bb cc", "dd ee ff ff", "aa dd", "bb ee é"] * 5)]
    model = quality.fit(rows)
    logits, bias = model
    got = {r.doc_id: r.score for r in quality.scores(docs_of([r[1] for r in rows]), model).collect()}
    for k, text, _ in rows:
        at, n = quality.bag(text)
        s = float(bias[1] - bias[0]) + ((logits[at, 1] - logits[at, 0]).astype(float) * n).sum() / (n.sum() + quality.PRIOR)
        assert abs(got[k] - 1 / (1 + np.exp(-s))) < 1e-6


def test_sample_is_bounded_and_repeatable(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    rows = training.sample(docs, labels, "toxic", 100, 7)
    assert rows == training.sample(docs.repartition(7), labels.repartition(3), "toxic", 100, 7)
    assert not {r[0] for r in rows} & set(HELD)
    assert all(60 < sum(r[2] == y for r in rows) < 140 for y in (0, 1))


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        t = list(rng.choice(words, 30))
        rows.append((i, " ".join(t + (["slur"] if i % 4 == 0 else [])), int(i % 4 == 0)))
    intercept, at, values = toxicity.fit(rows)
    assert toxicity.features("slur")[0] in at and len(at) < 1000 and intercept < 0


def test_quality_n_grams_are_of_characters():
    from noticeflow.llm import quality

    words = ["bug", "жук", "甲虫类", "é", "🎉\ud800x"]
    rows, counts = quality.rows_of(words)
    assert counts.tolist() == [1 + sum(max(0, len(w) + 3 - n) for n in quality.GRAMS) for w in words]
    grams = [set(r[r >= 1 << quality.BITS].tolist()) for r in (quality.rows_of([w])[0] for w in ("жук", "жар"))]
    assert len(grams[0] & grams[1]) == 1  # the mark and the first letter


def test_sample_takes_one_row_of_a_repeated_key(spark):
    docs = spark.createDataFrame([(1, "b")] * 500 + [(1, "a"), (2, None), (None, "x"), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (None, 1), (3, 0)], "doc_id long, toxic int")
    assert training.sample(docs, labels, "toxic", 100, 7) == [(1, "a", 1), (3, "c", 0)]
