import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from noticeflow.llm import bpe, packing


def best_fit_decreasing(lengths, capacity):
    """Remaining capacities after the plain algorithm, one piece after another."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(capacity - n)
    return Counter(left)


def test_plan_is_best_fit_decreasing():
    random.seed(2)
    for _ in range(150):
        capacity = random.choice([8, 10, 16, 50, 1024])
        lengths = [random.randint(1, capacity if random.random() < 0.8 else max(1, capacity // 8)) for _ in range(random.randint(0, 150))]
        histogram, taken, fill = Counter(lengths), set(), Counter()
        runs = packing.plan(histogram.items(), capacity)
        for n, count in histogram.items():
            for k in range(count):
                _, first, bin_, each, at = [r for r in runs if r[0] == n and r[1] <= k][-1]
                bin_, at = bin_ + (k - first) // each, at + (k - first) % each * n
                places = {(bin_, x) for x in range(at, at + n)}
                assert not places & taken and at + n <= capacity
                taken |= places
                fill[bin_] += n
        assert Counter(capacity - f for f in fill.values()) == best_fit_decreasing(lengths, capacity)
        assert all((b, x) in taken for b in fill for x in range(fill[b]))


def test_plan_of_many_pieces_is_short():
    assert len(packing.plan([(n, 10**9 + n) for n in range(1, 1025)])) < 8 * 1024


def test_lengths_beyond_the_capacity_are_refused():
    with pytest.raises(ValueError):
        packing.plan([(9, 1)], 8)


def test_odd_rows(docs_of, odd_texts):
    check(packing.pack(docs_of(odd_texts)).collect(), dict(enumerate(odd_texts)))
    assert packing.pack(docs_of([])).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(packing.pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def check(rows, texts):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for k, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4")
        own = sorted(by_doc[k], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == packing.CAPACITY for r in own[1:])
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(by_bin) == sum(best_fit_decreasing([r.length for r in rows], packing.CAPACITY).values())
