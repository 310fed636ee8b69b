import numpy as np
from pyspark.sql import functions as F

from noticeflow.llm import neighbours as N


def exact(ids, x, asked, k=10):
    """query -> [(distance, id)] by brute force in double precision."""
    x = x.astype(np.float64)
    out = {}
    for q in asked:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        out[q] = [(d[i], ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string")


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").toArrow()
    ids, x = rows.column(0).to_numpy(), np.array(rows.column(1).to_pylist(), np.float32)
    want = exact(ids, x, [i for i in ids.tolist() if i % 100 == 0])
    got = {}
    for r in N.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    assert set(got) == set(want) and all(sorted(v) == list(range(1, 11)) for v in got.values())
    recall = np.mean([len({v for _, v in got[q].values()} & {v for _, v in want[q]}) / 10 for q in want])
    assert recall >= 0.95
    for q, v in got.items():
        for score, i in v.values():
            assert abs(score - np.sqrt(((x[ids == q][0].astype(float) - x[ids == i][0]) ** 2).sum())) < 1e-12


def test_odd_vectors_ties_and_few_rows(spark):
    bad = [(None, [1.0, 2.0], 0, "a"), (1, None, 0, "a"), (2, [0.0, 0.0], 0, "a"), (3, [None, 1.0], 0, "a"), (4, [float("nan"), 1.0], 0, "a"), (5, [float("inf"), 1.0], 0, "a"), (6, [1.0], 0, "a"), (8, [], 0, "a")]
    rows = N.search(frame(spark, [*bad, (0, [1.0, 1.0], 0, "a"), (7, [1.0, 2.0], 0, "a"), (9, [1.0, 0.0], 0, "a"), (100, [3.0, 3.0], 0, "a")]), F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(rows)] == [(0, 1, 7), (0, 2, 9), (0, 3, 100), (100, 1, 7), (100, 2, 0), (100, 3, 9)]
    assert N.search(frame(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert N.search(frame(spark, bad), F.col("vec_id") % 100 == 0).count() == 0


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 3.0, 4.0, 5.0] if i % 2 else rng.normal(size=5).tolist(), 0, "a") for i in range(1, 900)] + [(1000, [1.0, 2.0, 3.0, 4.0, 5.1], 0, "a")]
    got = sorted(N.search(frame(spark, rows), F.col("vec_id") == 1000).collect())
    assert [r.vec_id for r in got] == list(range(1, 21, 2))


def test_a_crowd_of_nearly_equal_vectors(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    x = np.concatenate([rng.normal(size=(1500, 16)), centre + 0.01 * rng.normal(size=(1500, 16))]).astype(np.float32)
    ids = np.arange(len(x))
    want = exact(ids, x, [0, 500, 1500, 2000, 2500, 2900])
    got = {}
    for r in N.search(frame(spark, [(int(i), v.tolist(), 0, "a") for i, v in zip(ids, x)]), F.col("vec_id").isin(*want)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {i for _, i in want[q]}) / 10 for q in want]) > 0.97


def test_slices_and_parts(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    whole = sorted(N.search(df, F.col("vec_id") % 10 == 0).collect())
    monkeypatch.setattr(N, "SLICE", 30)
    monkeypatch.setattr(N, "PART", 4)
    assert sorted(N.search(df, F.col("vec_id") % 10 == 0).collect()) == whole


def test_parallel_error_is_smaller():
    for dim in (3, 16, 64):
        x = np.random.default_rng(2).normal(size=(3000, dim))
        q = N.fit(x)
        x = q.pad(x)
        scored, _ = N.assign(x, q.centres, 2, dim)
        nearest = np.stack([((x[:, None, 2 * s : 2 * s + 2] - c) ** 2).sum(axis=2).argmin(axis=1) for s, c in enumerate(q.centres)], axis=1)
        u = x / np.linalg.norm(x, axis=1)[:, None]

        def along(codes):
            return (((x - q.centres[np.arange(len(q.centres)), codes].reshape(len(x), -1)) * u).sum(axis=1) ** 2).mean()

        assert along(scored) < along(nearest) and N.eta(dim) >= 2
    assert N.eta(1) == 2 and abs(N.eta(64) - 63 * 0.04 / 0.96) < 1e-9


def test_tables_add_up_to_products():
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(200, 10)), rng.normal(size=(5, 10))
    quantiser = N.fit(x)
    codes, tables = quantiser.encode(x), quantiser.tables(q)
    four = np.stack([codes & 15, codes >> 4], axis=2).reshape(len(x), -1)
    chosen = quantiser.centres[np.arange(len(quantiser.centres)), four].reshape(len(x), -1)
    got = sum(tables[:, byte][:, codes[:, byte]] for byte in range(codes.shape[1]))
    assert np.abs(got - quantiser.pad(q) @ chosen.T).max() < 1e-5


def test_repeated_rows_each_have_their_list(spark):
    rows = [(i, [float(i), 1.0], 0, "a") for i in range(30)] + [(7, [7.0, 1.0], 0, "a"), (9, [9.0, 1.0], 0, "a"), (7, [7.5, 1.0], 0, "a")]
    got = N.search(frame(spark, rows), F.col("vec_id") == 7, k=4).collect()
    lists = sorted([r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.rank <= 4 and r.query_id == 7])
    assert len(got) == 12 and [sum(r.rank == n for r in got) for n in (1, 2, 3, 4)] == [3] * 4 and not any(r.vec_id == 7 for r in got)
    assert lists.count(8) == 3 and lists.count(6) == 3 and lists.count(9) == 4


def test_recall_on_growing_tables(spark):
    rng = np.random.default_rng(5)
    for rows in (300, 3000, 12000):
        x = rng.normal(size=(rows, 24)).astype(np.float32) + 3 * rng.normal(size=(8, 24))[rng.integers(0, 8, rows)].astype(np.float32)
        ids = np.arange(rows)
        want = exact(ids, x, ids[:: rows // 30].tolist())
        got = {}
        for r in N.search(frame(spark, [(int(i), v.tolist(), 0, "a") for i, v in zip(ids, x)]), F.col("vec_id") % (rows // 30) == 0).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert np.mean([len(got[q] & {i for _, i in want[q]}) / 10 for q in want]) >= 0.93
