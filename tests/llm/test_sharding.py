import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from noticeflow.llm import sharding as R


def test_odd_rows(docs_of, odd_texts):
    rows = {r.doc_id: r for r in R.shard_documents(docs_of(odd_texts)).collect()}
    for i, text in enumerate(odd_texts):
        raw = (text or "").encode()
        assert rows[i].size == len(raw) + 8 and rows[i].text_crc32 == zlib.crc32(raw) and rows[i].law == "key"
    assert R.shard_documents(docs_of([])).count() == 0


def test_slots_and_growth(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = R.shard_documents(docs).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, R.SHARDS)
    assert len(slots) == R.SHARDS and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 20000 / 25 * 0.8 < sum(r.grown_shard == R.SHARDS for r in rows) < 20000 / 25 * 1.2
    assert max(map(len, slots.values())) < 1.25 * 20000 / R.SHARDS
    again = {r.doc_id: r.grown_shard for r in rows}
    more = {r.doc_id: r.shard for r in R.shard_documents(docs, R.SHARDS + 1).collect()}
    assert again == more


def test_weights(spark):
    placed = R.assign(spark.range(30000).withColumnRenamed("id", "k"), "k", [1.0, 2.0, 3.0])
    share = Counter(r.shard for r in placed.collect())
    assert [round(share[i] / 30000 * 6) for i in range(3)] == [1, 2, 3]
    assert placed.where("grown_shard is not null").count() == 0
