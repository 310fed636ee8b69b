"""The learned and hashed operators against plain versions of their methods, written from the definitions with dictionaries and loops."""

import math
import random
import zlib

import numpy as np
import pytest

from noticeflow.llm import language, media, quality, sharding, toxicity


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def small_corpus(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)]
    rows = []
    for i in range(n):
        y = i % 3 == 0
        text = " ".join(rng.choices(words, k=rng.randrange(1, 15)) + (["slur", "bad"] if y else ["fine"]))
        rows.append((i, text, int(y)))
    return rows


def ftrl(examples, order, size, alpha, beta, l1, l2):
    """Per-coordinate FTRL-proximal over (indices, label) pairs, coordinate by coordinate."""
    z, n = {}, {}

    def weight(i):
        s = z.get(i, 0.0)
        return 0.0 if abs(s) <= l1 else (math.copysign(l1, s) - s) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for at in order:
        indices, y = examples[at]
        w = {i: weight(i) for i in indices}
        g = sigmoid(sum(w.values())) - y
        for i in indices:
            old = n.get(i, 0.0)
            n[i] = old + g * g
            z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / alpha * w[i]
    return {i: weight(i) for i in z if weight(i)}


def test_toxicity_is_plain_ftrl():
    rows, size = small_corpus(), 1 << toxicity.BITS
    intercept, at, values = toxicity.fit(rows, epochs=3)
    examples = [([*set(toxicity.features(t).tolist()), size], y) for _, t, y in rows]
    rng = np.random.default_rng(toxicity.SEED)
    order = [i for _ in range(3) for i in rng.permutation(len(rows))]
    model = toxicity.Ftrl(1)
    want = ftrl(examples, order, size, model.alpha, model.beta, model.l1, model.l2)
    assert abs(want.pop(size, 0.0) - intercept) < 1e-6
    assert set(want) == set(at.tolist()) and all(abs(want[i] - v) < 1e-5 for i, v in zip(at.tolist(), values.tolist()))
    score = toxicity.scorer((intercept, at, values))
    for _, text, _ in rows:
        assert abs(score([text])[0] - sigmoid(intercept + sum(want.get(i, 0.0) for i in set(toxicity.features(text).tolist())))) < 1e-5


def test_toxicity_features_are_words_pairs_and_skip_grams():
    def plain(text):
        words = ["".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower())]
        words = words[0].split()
        return len(words) + sum(max(0, len(words) - apart) for apart in (1, 2, 3))

    for text in ("one", "one, two", "a b c d e", "É-x!y  z", ""):
        assert len(toxicity.features(text)) == plain(text)
    near, far = set(toxicity.features("a b c").tolist()), set(toxicity.features("a x c").tolist())
    assert len(near & far) == 3  # a, c, and a with c one word apart


def plain_counts(text):
    out = {}
    for n in language.GRAMS:
        for i in range(len(text) - n + 1):
            out[text[i : i + n]] = out.get(text[i : i + n], 0) + 1
    return out


def hashed(gram):
    found, _ = language.counts(gram)
    short = set()
    for n in range(1, len(gram)):
        for i in range(len(gram) - n + 1):
            short |= {hashed(gram[i : i + n])}
    rest = [x for x in found.tolist() if x not in short]
    return rest[0] if rest else -1


def test_language_is_plain_multinomial_ftrl():
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["the", "of", "and"] if i % 2 else ["der", "und", "nicht"], k=4)), "en" if i % 2 else "de") for i in range(40)]  # too few for a calibration part
    idf = np.linspace(1, 2, 1 << language.BITS)
    langs, used, values, temperature = language.fit(rows, idf, epochs=2, alpha=1.0, beta=1.0, l1=0.02, l2=0.01)
    generator = np.random.default_rng(language.SEED)
    learn = generator.permutation(len(rows))
    examples = []
    for _, text, lang in rows:
        raw = {}
        for gram, n in plain_counts(text.lower()).items():
            h = GRAMS.setdefault(gram, hashed(gram))
            raw[h] = raw.get(h, 0) + n
        raw = {h: (1 + math.log(n)) * idf[h] for h, n in raw.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        examples.append(({h: v / norm for h, v in raw.items()}, langs.index(lang)))
    z, n = {}, {}

    def weight(h, c):
        s = z.get((h, c), 0.0)
        return 0.0 if abs(s) <= 0.02 else (math.copysign(0.02, s) - s) / ((1.0 + math.sqrt(n.get((h, c), 0.0))) / 1.0 + 0.01)

    for _ in range(2):
        for i in generator.permutation(learn):
            x, y = examples[i]
            w = {(h, c): weight(h, c) for h in x for c in range(2)}
            logits = [sum(v * w[h, c] for h, v in x.items()) for c in range(2)]
            top = max(logits)
            e = [math.exp(v - top) for v in logits]
            for (h, c), own in w.items():
                g = x[h] * (e[c] / sum(e) - (c == y))
                old = n.get((h, c), 0.0)
                n[h, c] = old + g * g
                z[h, c] = z.get((h, c), 0.0) + g - (math.sqrt(n[h, c]) - math.sqrt(old)) / 1.0 * own
    want = {(h, c): weight(h, c) for h, c in z if weight(h, c)}
    got = {(int(h), c): float(values[i, c]) for i, h in enumerate(used) for c in range(2) if values[i, c]}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in want) and temperature == 1.0 and langs == ["de", "en"]


GRAMS: dict = {}


def test_temperature_has_the_least_loss_of_those_tried(monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["aa", "bb", "cc", "dd"] if i % 2 else ["aa", "bb", "ee", "ff"], k=3)), "x" if i % 2 else "y") for i in range(200)]
    idf = np.ones(1 << language.BITS)
    langs, used, values, temperature = language.fit(rows, idf)
    dense = np.zeros((1 << language.BITS, 2))
    dense[used] = values
    kept = np.random.default_rng(language.SEED).permutation(len(rows))[: len(rows) // 5]

    def loss(t):
        total = 0.0
        for i in kept:
            at, v = language.vector(rows[i][1], idf)
            logits = v @ dense[at] / t
            total -= logits[langs.index(rows[i][2])] - math.log(sum(math.exp(x) for x in logits))
        return total

    assert all(loss(temperature) <= loss(t) + 1e-3 for t in np.geomspace(0.05, 20, 121))


def test_quality_is_plain_stochastic_gradient_descent(monkeypatch):
    rows = [(i, t, 1 - y) for i, t, y in small_corpus(30)]
    logits, bias = quality.fit(rows, epochs=2, rate=0.5)
    rng = np.random.default_rng(quality.SEED)
    start = ((rng.random((2 << quality.BITS, quality.DIM)) - 0.5) / quality.DIM).astype(np.float32)
    vectors, out, b = {}, [[0.0, 0.0] for _ in range(quality.DIM)], [0.0, 0.0]
    bags = []
    for _, text, _ in rows:
        words, counts = quality.words_of(text), {}
        for w in words:
            for r in quality.rows_of([w])[0].tolist():
                counts[r] = counts.get(r, 0) + 1
        total = quality.PRIOR + sum(counts.values())
        bags.append({r: n / total for r, n in counts.items()})
    steps, done = 2 * len(rows), 0
    for _ in range(2):
        for i in rng.permutation(len(rows)):
            bag, y = bags[i], rows[i][2]
            own = {r: vectors.setdefault(r, [float(v) for v in start[r]]) for r in bag}
            hidden = [sum(share * own[r][d] for r, share in bag.items()) for d in range(quality.DIM)]
            scores = [sum(hidden[d] * out[d][c] for d in range(quality.DIM)) + b[c] for c in range(2)]
            e = [math.exp(s - max(scores)) for s in scores]
            p = [e[c] / sum(e) - (c == y) for c in range(2)]
            step = 0.5 * (1 - done / steps)
            back = [sum(out[d][c] * p[c] for c in range(2)) for d in range(quality.DIM)]
            for d in range(quality.DIM):
                for c in range(2):
                    out[d][c] -= step * hidden[d] * p[c]
            b = [b[c] - 0.1 * step * p[c] for c in range(2)]
            for r, share in bag.items():
                vectors[r] = [own[r][d] - step * share * len(bag) ** 0.5 * back[d] for d in range(quality.DIM)]
            done += 1
    for r, v in vectors.items():
        for c in range(2):
            assert abs(logits[r, c] - sum(v[d] * out[d][c] for d in range(quality.DIM))) < 1e-4
    assert max(abs(bias[c] - b[c]) for c in range(2)) < 1e-4
    score = quality.scorer((logits, bias))
    for bag, (_, text, _) in zip(bags, rows):
        s = b[1] - b[0] + sum(share * sum(vectors[r][d] * (out[d][1] - out[d][0]) for d in range(quality.DIM)) for r, share in bag.items())
        assert abs(score([text])[0] - sigmoid(s)) < 1e-3


def test_quality_words_and_character_n_grams():
    def plain(word):
        marked = f"<{word}>"
        return 1 + sum(max(0, len(marked) - n + 1) for n in quality.GRAMS)

    for word in ("a", "ab", "über", "中文", "x" * 40):
        rows, n = quality.rows_of([word])
        assert n.tolist() == [plain(word)] and zlib.crc32(f"<{word}>".encode()) * 0x9E3779B1 % 2**32 >> 32 - quality.BITS == rows[rows < 1 << quality.BITS][0]
    assert quality.words_of("a a b b b") == ["a", "a", "b", "b", "b"] + [quality.REPEAT] * 3 and quality.words_of(None) == []


def plain_peaks(samples):
    """Peaks of each frame by a discrete Fourier transform from its definition."""
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / (media.WINDOW - 1)) for i in range(media.WINDOW)]
    frames = max(1, math.ceil((len(samples) - media.WINDOW) / media.HOP) + 1)
    out = []
    for f in range(frames):
        part = [(samples[f * media.HOP + i] if f * media.HOP + i < len(samples) else 128) for i in range(media.WINDOW)]
        signal = [(s - 128) / 128 * w for s, w in zip(part, window)]
        mean = sum(signal) / len(signal)
        signal = [s - mean for s in signal]
        size = []
        for k in range(media.WINDOW // 2 + 1):
            re = sum(s * math.cos(2 * math.pi * k * i / media.WINDOW) for i, s in enumerate(signal))
            im = sum(s * math.sin(2 * math.pi * k * i / media.WINDOW) for i, s in enumerate(signal))
            size.append(math.hypot(re, im))
        floor = 2 * sum(size) / len(size)
        out.append([max(range(low, high), key=lambda k: size[k]) if max(size[low:high]) > max(floor, 1e-3) else 0 for low, high in media.BANDS])
    return out


@pytest.mark.parametrize("text", ["", "short", "The quick brown fox jumps over the lazy dog. " * 20, "één twee drie vier vijf zes zeven acht " * 15])
def test_fingerprints_are_pairs_of_plain_spectral_peaks(text):
    _, payload = media.payload_of(text)
    peaks = plain_peaks(payload)
    want = sorted(
        f << 32 | a << 12 | b << 2 | apart
        for f in range(len(peaks))
        for apart in range(1, media.REACH + 1)
        if f + apart < len(peaks)
        for a in peaks[f]
        for b in peaks[f + apart]
        if a and b
    )
    assert media.fingerprints(media.from_wav(media.to_wav(payload))).tolist() == want


def xx64(values, seed=42):
    """Spark's xxhash64 of an int and a long, as its functions chain them: each value is hashed with the hash before as its seed."""
    m = (1 << 64) - 1
    p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    turn = lambda x, r: (x << r | x >> 64 - r) & m
    h = seed
    for value, size in values:
        h = (h + p5 + size) & m
        if size == 4:
            h ^= (value & 0xFFFFFFFF) * p1 & m
            h = (turn(h, 23) * p2 + p3) & m
        else:
            h ^= turn((value & m) * p2 & m, 31) * p1 & m
            h = (turn(h, 27) * p1 + p4) & m
        h ^= h >> 33
        h = h * p2 & m
        h ^= h >> 29
        h = h * p3 & m
        h ^= h >> 32
    return h


def test_shards_have_the_least_draw(docs_of):
    """The winner of every key by the definition, -ln(u) over all shards, with the same hash computed here."""
    docs = docs_of([f"text {i}" for i in range(150)])
    draws = lambda k, n: [-math.log(((xx64([(s, 4), (k, 8)]) >> 11) + 0.5) / 2**53) for s in range(n)]
    for r in sharding.shard_documents(docs).collect():
        own, grown = draws(r.doc_id, sharding.SHARDS), draws(r.doc_id, sharding.SHARDS + 1)
        assert r.shard == own.index(min(own)) and r.grown_shard == grown.index(min(grown))
    weights = [1.0, 4.0, 2.0]
    for r in sharding.assign(docs, "doc_id", weights).collect():
        own = [d / w for d, w in zip(draws(r.doc_id, 3), weights)]
        assert r.shard == own.index(min(own))
