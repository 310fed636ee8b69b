import hashlib
import random

import pytest
from tokenizers import Tokenizer

from noticeflow.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.mark.parametrize("kind", [bpe.Bpe, bpe.LibraryBpe])
def test_same_as_the_library(library, kind):
    random.seed(3)
    bits = [" ", " ", "\n", "\t", "a", "b", "é", "1", "'s", "'", "!", "<|endoftext|>", "　", "\xa0", "the", "\x1c", "\r", "中", "🎉", "<|"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 30))) for _ in range(3000)] + ["a" * 3000, "xyq1" * 2000, " " * 2000, "", "é" * 500, " " * 200000, "\n" * 200000, "a1!" * 50000]
    texts += [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)} '{chr(c)}" for c in range(0x2100)]
    coder = kind(bpe.read_vocabulary())
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = coder.encode(text)
        assert ids.tolist() == e.ids
        assert coder.decode(ids).decode("utf-8", "replace") == library.decode(e.ids, skip_special_tokens=False)
        assert coder.decimals(ids).decode() == ",".join(map(str, e.ids))


def test_heap_and_scan_agree():
    coder = bpe.Bpe(bpe.read_vocabulary())
    random.seed(1)
    for _ in range(200):
        raw = [coder.first[b] for b in "".join(random.choices("abcdeth ", k=random.randint(2, 150))).encode()]
        assert coder.scan(list(raw)) == coder.heap(list(raw))


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 5)
    coder = bpe.Bpe(bpe.read_vocabulary())
    text = " ".join(f"word{i}" for i in range(50))
    assert coder.decode(coder.encode(text)).decode() == text
    assert len(coder.chunks) <= 5 and len(coder.words) <= 5


def test_odd_rows(docs_of, odd_texts, library):
    rows = {r.doc_id: r for r in bpe.digests(docs_of(odd_texts)).collect()}
    assert len(rows) == len(odd_texts)
    for i, text in enumerate(odd_texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    whole = {r.doc_id: r for r in bpe.encode_decode(docs_of(odd_texts)).collect()}
    assert [whole[i].decoded for i in range(len(odd_texts))] == [t or "" for t in odd_texts]
    assert bpe.digests(docs_of([])).count() == 0
