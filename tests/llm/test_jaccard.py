import random
import re

import pytest

from noticeflow.llm import jaccard
from noticeflow.operators.components import components


def brute(rows):
    """(n_shingles, component_id, n_links) of (doc_id, text) rows, from the definition."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, degree = {}, [0] * len(rows)
    for i, s in enumerate(sets):
        near = {j for t in s for j in holders.get(t, ())}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
                degree[i] += 1
                degree[j] += 1
        for t in s:
            holders.setdefault(t, []).append(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(k, least.get(root(i), k))
    return {k: (len(sets[i]), least[root(i)], degree[i]) for i, (k, _) in enumerate(rows)}


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return " ".join(words)


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.classes(df).collect()}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    assert found(docs) == want
    assert sum(k != c for k, (_, c, _) in want.items()) > 50


@pytest.mark.parametrize("block,sets", [(1 << 19, 256), (300, 5)])
def test_large_groups(docs_of, monkeypatch, block, sets):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", sets)
    monkeypatch.setattr(jaccard, "KNOWN_POSTINGS", 18 if sets > 99 else 3)
    monkeypatch.setattr(jaccard, "KNOWN_SETS", 16 if sets > 99 else 1)
    rng = random.Random(4)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.randrange(20, 90))] for _ in range(6)]
    texts = [edited(b, rng, rng.randrange(4)) for b in base for _ in range(25)] + [" ".join(base[0])] * 40
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"u{j}x{i}" for i in range(rng.randrange(1, 40))) for j in range(60)]
    rng.shuffle(texts)
    assert found(docs_of(texts)) == brute(list(enumerate(texts)))


def test_odd_rows(docs_of, odd_texts):
    texts = [*odd_texts, "One two", "one TWO", "one two\x0b", "one\xa0two", "É É É É É", "é é é é é", "a b c d e", "a b c d e f"]
    assert found(docs_of(texts)) == brute(list(enumerate(texts)))
    assert jaccard.classes(docs_of([])).count() == 0
    assert jaccard.classes(docs_of([None, " "])).count() == 2


def test_repeated_and_null_keys(spark):
    text = "a b c d e f g h i j"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text + " k"), (3, "x y"), (3, "z")], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.n_links) for r in jaccard.classes(df).collect())
    assert rows == [(0, 6, 1, 3), (1, 6, 1, 3), (1, 6, 1, 3), (2, 7, 1, 3), (3, 1, 3, 0), (3, 1, 3, 0)]


def test_filters_are_bounds():
    import numpy as np

    rng = np.random.default_rng(1)
    for most in (12, 400):
        base = rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2)
        sets = [np.unique(rng.choice(base[: 3 * most], rng.integers(1, most))) for _ in range(25)] + [np.unique(base[: most - i]) for i in range(6)]
        i, j = np.triu_indices(len(sets), 1)
        both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
        assert (jaccard.overlaps(sets, i, j) == both).all() and (jaccard.suffix_bounds(sets, i, j) >= both).all()
        n = np.array([len(s) for s in sets])
        want = 100 * both >= 75 * (n[i] + n[j] - both)
        assert want.any() and (jaccard.joined_pairs(sets, None)[i, j] >= want).all()
        assert list(zip(*jaccard.links(sets))) == list(zip(i[want], j[want]))
        block = np.arange(len(sets)) % 2
        across = want & (block[i] != block[j])
        assert list(zip(*jaccard.links(sets, block))) == list(zip(i[across], j[across]))
    assert jaccard.least_overlap(4, 4) == 4 and jaccard.least_overlap(7, 7) == 6 and jaccard.prefix_length(4) == 2


def test_one_of_each(docs_of):
    same = "a b c d e f g h i j"
    kept = jaccard.one_of_each(docs_of([same, same, "other text", None, None, same + " k"]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4] and "score" in kept.columns


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i + 1000, i + 1001) for i in range(150)] + [(5000, i) for i in range(5001, 5100)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_null_ids_bridge(spark):
    words = [f"w{i}" for i in range(40)]
    left, middle, right = (" ".join(words[a : a + 33]) for a in (0, 3, 6))
    rows = [(1, left), (None, middle), (None, middle), (2, right), (None, "p q r s t u v"), (None, "p q r s t u v w")]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.n_links) for r in got if r.n_shingles > 9) == [(0, 29, 1, 3), (0, 29, 1, 3), (1, 29, 1, 2), (2, 29, 1, 2)]
    assert sorted((r.n_shingles, r.component_id, r.n_links) for r in got if r.n_shingles < 9) == [(3, None, 1), (4, None, 1)]


def test_one_of_each_goes_by_row(spark):
    a, b, c = ("a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z 1 2 3 4")
    near = " ".join(f"w{i}" for i in range(40))
    rows = [(1, a), (1, a), (1, a), (2, a), (2, b), (2, b), (None, a), (None, c), (None, c), (None, near), (None, near + " w"), (3, None), (3, None), (None, ""), (4, "only"), (4, b)]
    kept = jaccard.one_of_each(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string"))
    assert kept.columns == ["doc_id", "text", "score"]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert [r for r in got if r[1] and r[1].startswith("w0")] in ([(None, near)], [(None, near + " w")])
    assert [r for r in got if not (r[1] or "").startswith("w0")] == sorted([(1, a), (2, b), (None, c), (3, None), (3, None), (None, ""), (4, "only")], key=repr)


def test_candidates_connect_what_the_filters_let_pass(spark):
    """Postings of a few shingles at random places: the edges connect exactly the pairs that pass the length and positional filters."""
    rng = random.Random(5)
    rows, pairs, sizes = [], set(), [rng.randrange(8, 60) for _ in range(120)]
    at = {s: {t: p for t, p in zip(rng.sample(range(12), 4), rng.sample(range(jaccard.prefix_length(n)), min(4, jaccard.prefix_length(n))))} for s, n in enumerate(sizes)}
    for s, places in at.items():
        most = jaccard.largest_partner(sizes[s])
        rows += [(t, s, int(most[p]) << 32 | sizes[s]) for t, p in places.items()] * rng.randrange(1, 3)
        for r in range(s):
            a, b = sizes[s], sizes[r]
            if any(min(a - p, b - at[r][t]) >= jaccard.least_overlap(a, b) and 100 * min(a, b) >= 75 * max(a, b) for t, p in places.items() if t in at[r]):
                pairs.add((r, s))

    def classes(edges):
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[root(a)] = root(b)
        return {frozenset(y for y in parent if root(y) == root(x)) for x in parent}

    edges = {(r.a, r.b) for r in jaccard.candidate_edges(spark.createDataFrame(rows, "token long, sid long, size long")).collect()}
    assert edges <= pairs and classes(edges) == classes(pairs) and 10 < len(edges) < len(pairs)


@pytest.mark.parametrize("bits", [2, 18])
def test_what_a_task_leaves_out_stays_connected(spark, monkeypatch, bits):
    """Postings of one task and of many tasks connect the same sets, whatever a task remembers; one task posts less."""
    import numpy as np

    monkeypatch.setattr(jaccard, "KNOWN_POSTINGS", bits)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = [edited(base[: rng.randrange(90, 120)], rng, rng.randrange(3)) for _ in range(200)]
    shared = spark.sparkContext.broadcast(np.zeros(1 << 14, np.uint32))

    def found(parts):
        docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts)
        posts = jaccard.postings(docs, shared, 14, "text")
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for r in jaccard.candidate_edges(posts).collect():
            parent[root(r.a)] = root(r.b)
        return posts.where("size > 0").count(), {frozenset(y for y in parent if root(y) == root(x)) for x in parent}

    (few, one), (many, scattered) = found(1), found(200)
    assert one == scattered and (bits == 2 or few < 0.8 * many)


def copied_table(rng, n, words=60):
    """n near copies of one text, each of them with a few edits of its own, and as many other texts."""
    base = [f"w{i}" for i in range(words)]
    texts = [edited(base, rng, rng.randrange(3)) for _ in range(n)] + [" ".join(f"z{rng.random()}" for _ in range(20)) for _ in range(n)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("sent,edges", [(1 << 22, 1 << 17), (1500, 40)])
def test_blocks_meet_once_however_few_are_sent(docs_of, monkeypatch, sent, edges):
    monkeypatch.setattr(jaccard, "BLOCK", 400)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    monkeypatch.setattr(jaccard, "SENT", sent)
    monkeypatch.setattr(jaccard, "EDGES", edges)
    texts = copied_table(random.Random(11), 90)
    assert found(docs_of(texts)) == brute(list(enumerate(texts)))


def test_no_shuffle_grows_with_pairs_of_blocks(docs_of, monkeypatch):
    """Each set of a class travels once to where it is verified, however many blocks the class has."""
    monkeypatch.setattr(jaccard, "BLOCK", 400)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    seen, plain = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda sets: seen.append((sets.count(), sets.select("sid").distinct().count())) or plain(sets))
    texts = copied_table(random.Random(12), 60)
    assert found(docs_of(texts)) == brute(list(enumerate(texts)))
    (rows, sets), = seen
    assert rows == sets > 5 * jaccard.BLOCK_SETS


@pytest.mark.parametrize("ids", [True, False])
def test_texts_that_no_class_wants_are_not_shuffled(spark, docs_of, monkeypatch, ids):
    monkeypatch.setattr(jaccard, "BROADCAST_BYTES", 0)
    texts = copied_table(random.Random(13), 40)
    docs = docs_of(texts)
    if not ids:  # a chain that only rows without id hold
        docs = docs.selectExpr("if(doc_id < 0, doc_id, null) doc_id", "text")
        got = sorted((r.n_shingles, r.component_id, r.n_links) for r in jaccard.classes(docs).collect())
        assert got == sorted((n, None, d) for n, _, d in brute(list(enumerate(texts))).values())
        return
    assert found(docs) == brute(list(enumerate(texts)))
    wanted = docs.where("doc_id % 10 = 3").select("doc_id")
    rows = jaccard.may_be_in(docs, wanted, "doc_id")
    assert rows.columns == docs.columns and [r.doc_id for r in rows.orderBy("doc_id").collect()] == [r.doc_id for r in wanted.orderBy("doc_id").collect()]
    plan = jaccard.texts_of(docs, wanted, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "__bits" in plan
