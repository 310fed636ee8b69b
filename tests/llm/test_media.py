import hashlib
import zlib

import numpy as np

from noticeflow.llm import media as M


def test_round_trip_and_rows(docs_of, odd_texts):
    rows = {r.doc_id: r for r in M.digests(docs_of(odd_texts)).collect()}
    whole = {r.doc_id: r for r in M.media_columns(docs_of(odd_texts)).collect()}
    for i, text in enumerate(odd_texts):
        raw = (text or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        assert M.from_wav(bytes(whole[i].media)) == padded
        assert r.media_bytes == len(whole[i].media) and r.media_sha256 == hashlib.sha256(bytes(whole[i].media)).hexdigest()
        assert r.feature == hashlib.sha256(np.array(whole[i].fingerprints, "<i8").tobytes()).hexdigest()
    assert rows[6].feature == rows[7].feature
    assert M.digests(docs_of([])).count() == 0


def test_blocks_do_not_change_fingerprints(monkeypatch):
    payload = np.random.default_rng(0).integers(0, 256, 64 * 600).astype(np.uint8).tobytes()
    whole = M.fingerprints(payload)
    monkeypatch.setattr(M, "FRAMES", 7)
    assert len(whole) and (M.fingerprints(payload) == whole).all()


def test_a_tone_is_found_at_its_frequency():
    t = np.arange(M.HOP * 20)
    payload = (128 + 100 * np.sin(2 * np.pi * 40 * t / M.WINDOW)).astype(np.uint8).tobytes()
    marks = M.fingerprints(payload)
    assert 40 in {int(x) >> 12 & 0x3FF for x in marks}
    assert (np.diff(marks >> 32) >= 0).all()
