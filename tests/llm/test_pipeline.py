import corpus_pipeline
from noticeflow.llm import quality, secrets, toxicity
from noticeflow.llm.common import materialise

from .test_jaccard import brute
from .test_packing import check
from .test_secrets import plain


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name in ("toxicity", "quality"):
            kind = {"toxicity": toxicity, "quality": quality}[name]
            score = kind.scorer(kind.train(docs, labels))
            low = {k for k, r in rows.items() if score([r.text])[0] < kind.THRESHOLD}
            want = {k: r.text for k, r in rows.items() if (k in low) == (name == "toxicity")}
            assert 0 < len(rows) - len(want) < len(rows) / 3
        elif name == "near_duplicates":
            want = {k: rows[k].text for k, (_, c, _) in brute([(k, r.text) for k, r in rows.items()]).items() if k == c}
        else:
            want = {k: r.text for k, r in rows.items()}
        docs = materialise(stage(spark, docs, sf), name)
        assert docs.columns == columns
        rows = {r.doc_id: r for r in docs.collect()}
        if name == "secrets":
            assert set(rows) == set(want) and not any(plain(r.text) for r in rows.values())
            assert all(rows[k].text == t for k, t in want.items() if not secrets.Scanner().spans(t)) and any(rows[k].text != t for k, t in want.items())
            assert all(r.n_chars == len(r.text) for r in rows.values())
        else:
            assert {k: r.text for k, r in rows.items()} == want
    check(corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), {k: r.text for k, r in rows.items()})
    one = corpus_pipeline.run(spark, sf).select("doc_id", "piece").collect()
    assert {r.doc_id for r in one} == set(rows)


def test_odd_rows(spark, docs_of, odd_texts, sf):
    docs = docs_of(odd_texts)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    assert {1, 4} <= {r.doc_id for r in docs.collect()} and "score" in docs.columns
    packed = corpus_pipeline.pack_sequences(spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.pack_sequences(spark, docs_of([]), sf).count() == 0
