"""Every operator's query functions on rows with null keys, repeated rows, clashing extra columns, and without rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from noticeflow.llm import bpe, jaccard, language, media, neighbours, packing, quality, secrets, sharding, toxicity

ROWS = [(None, "a text"), (None, None), (5, "a text"), (5, "a text"), (5, "another text"), (6, None), (7, "a text")]


def tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __salt int, score string, key string, n int, sid string, shard string, spans string"
    return spark.createDataFrame([(k, t, None, None, None, 1, "x", "x", 1, "x", "x", "x") for k, t in ROWS], schema)


OPERATORS = {
    "language": lambda d: language.predict(d, language.train(d)),
    "media": media.digests,
    "media_columns": media.media_columns,
    "secrets": secrets.digests,
    "find": secrets.find,
    "quality": lambda d: quality.scores(d, None),
    "packing": packing.pack,
    "sharding": sharding.shard_documents,
    "toxicity": lambda d: toxicity.scores(d, toxicity.fit([])),
    "jaccard": jaccard.classes,
    "bpe": bpe.digests,
    "round_trip": bpe.encode_decode,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_result_a_row(spark, name):
    df = tables(spark)
    rows = OPERATORS[name](df).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(k) for k, _ in ROWS)
    values = [tuple(r)[1:] for r in rows if r.doc_id == 5 and name not in ("packing", "sharding")]
    assert not values or len({repr(v) for v in values}) <= 2
    empty = OPERATORS[name](df.limit(0))
    assert empty.count() == 0 and empty.columns == OPERATORS[name](df).columns


def test_slots_with_repeated_and_null_keys(spark):
    rows = sharding.shard_documents(tables(spark)).collect()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    packed = packing.pack(tables(spark)).collect()
    assert sorted(r.offset for r in packed)[0] == 0 and len({(r.sequence_id, r.offset) for r in packed}) == len(packed)


def test_training_ignores_rows_without_key_label_or_text(spark):
    docs = tables(spark)
    labels = spark.createDataFrame([(None, 1, 1), (5, None, None), (6, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels) is None
    assert len(toxicity.train(docs, labels)[1]) == 0
    assert quality.scores(docs, quality.train(docs, labels)).where(F.col("predicted") != 1).count() == 0


def learned(kind, bad):
    rows = [(i, f"good words of text {i % 7}" if i % 2 else f"{bad} {i % 5}", int((i % 2 == 1) == (kind is quality))) for i in range(120)]
    return kind.fit(rows)


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_trained_models_on_odd_rows(spark, kind):
    model = learned(kind, "trash slur")
    long = "good words of text " * 60000
    rows = [(None, "good words of text 1"), (None, None), (5, "trash slur 1"), (5, "trash slur 1"), (5, "good words of text 1"), (6, None), (7, ""), (8, " \n"), (9, long), (10, "x" * 500000)]
    df = spark.createDataFrame([(*r, "s", "p", 1) for r in rows], "doc_id long, text string, score string, predicted string, n int")
    got = kind.scores(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r.score)
    assert len(of[5]) == 3 and len(set(of[5])) == 2
    assert of[6] == of[7] == of[8] and of[6][0] in of[None] and (of[9][0] > 0.5) == (kind is quality)
    kept = kind.keep(df, model)
    assert kept.columns == df.columns
    threshold = kind.THRESHOLD
    want = sorted(repr(r.doc_id) for r in got if (r.score >= threshold) == (kind is quality))
    assert sorted(repr(r.doc_id) for r in kept.collect()) == want
    assert kind.scores(df.limit(0), model).count() == 0 and kind.keep(df.limit(0), model).count() == 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_every_stage_on_odd_rows(spark, sf, stage):
    name, run = stage
    long = "long words of a text that goes on " * 30000
    rows = [(None, "a text of its own here"), (None, None), (None, None), (5, "same text as another one"), (5, "same text as another one"), (6, "same text as another one"), (6, "password=hunter22 is in here"), (7, ""), (8, long), (9, long + "and on"), (10, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars string, score double, sid int, row int, __text2 string"
    docs = spark.createDataFrame([(*r, None, None, "many", 1.0, 1, 2, "x") for r in rows], schema)
    got = run(spark, docs, sf)
    found = got.collect()
    empty = run(spark, docs.limit(0), sf)
    assert empty.count() == 0 and empty.columns == got.columns
    if name == "packing":
        pieces = {}
        for r in found:
            pieces.setdefault(r.doc_id, []).append(r.length)
        assert {k: sum(n) > 1 for k, n in pieces.items()} == {None: True, 5: True, 6: True, 7: False, 8: True, 9: True, 10: False}
        assert sum(r.piece == 0 for r in found) == len(rows) and max(r.length for r in found) <= 1024
        return
    assert got.columns == docs.columns and all((r.n_chars, r.score, r.sid, r.row) == ("many", 1.0, 1, 2) for r in found)
    texts = [(r.doc_id, r.text) for r in found]
    if name == "secrets":
        assert sorted(map(repr, texts)) == sorted(repr((k, t if k != 6 or "password" not in t else "[secret] is in here")) for k, t in rows)
    elif name == "near_duplicates":
        assert sorted(map(repr, texts)) == sorted(map(repr, [r for i, r in enumerate(rows) if i not in (4, 5, 9)]))
    else:  # equal texts have one fate
        assert all(texts.count(r) in (0, rows.count(r)) for r in rows)


def test_neighbours_keep_rows_with_odd_columns(spark):
    df = spark.createDataFrame([(i, [float(i % 5), 1.0], "x", 1, 2) for i in range(20)], "vec_id long, embedding array<float>, row string, cell int, score int")
    got = neighbours.search(df, F.col("vec_id") == 3, k=3).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got)] == [(1, 8, 0.0), (2, 13, 0.0), (3, 18, 0.0)]
