"""Quality classifier: supervised subword embeddings.

A word (white-space separated, case and punctuation kept) is its own hashed vector and those of its hashed character n-grams between word marks; a document is
the average of all of them over its whole text (with PRIOR zero vectors, so that a few words alone don't decide); a word that repeats the one before it adds
the word REPEAT, since the repetition of a rare word shows in no word's own vector. A softmax layer gives the label. Both layers are learned by stochastic gradient descent in numpy.
As the output is linear in the average, a trained model needs only each row's two logits: words' sums are cached in a cache of bounded size.

Learns from a bounded sample (``per_label`` documents of each label) outside the held-out fold. Scores depend on the text alone, so repeated rows and equal
texts get equal ones, null ids included; a null or empty text has no words, so its score is that of the bias; without training rows all scores are 1, since
nothing speaks against a document. A score that equals the threshold is predicted 1. Texts are read whole; an empty table gives no rows; scores() has the key
and its own columns only, and keep() all columns of its input as they are.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from noticeflow.llm.common import keep_arrow, map_arrow
from noticeflow.llm.training import sample

BITS = 16
DIM = 16
GRAMS = (2, 3, 4)
PER_LABEL = 3000
SEED = 4
THRESHOLD = 0.3
CACHED = 150_000
#: Stands for the repetition of a word; it has white space, so no word of a text equals it.
REPEAT = " repeated"
PRIOR = 10.0


def words_of(text: str | None) -> list[str]:
    words = (text or "").split()
    return words + [REPEAT] * sum(map(operator.eq, words, words[1:]))


def rows_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed vector rows of words: all rows, and how many each word has. Words are rows 0 .. 2 ** BITS, n-grams the next 2 ** BITS."""
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    data = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(data))  # characters from here to the word's end
    own = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
    parts, owners = [own.astype(np.int64)], [np.arange(len(words))]
    h = data * np.uint32(0x85EBCA6B)
    for n in range(2, max(GRAMS) + 1):
        h = (h[: len(data) - n + 1] ^ (h[: len(data) - n + 1] >> np.uint32(15))) * np.uint32(0x01000193) + data[n - 1 :] * np.uint32(0xC2B2AE35)
        if n in GRAMS:
            good = left[: len(h)] >= n
            mixed = (h[good] ^ np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
            parts.append(mixed.astype(np.int64) + (1 << BITS))
            owners.append(owner[: len(h)][good])
    rows, owners = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return rows[order], np.bincount(owners, minlength=len(words))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a text and how often each occurs."""
    counts = Counter(words_of(text))
    if not counts:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    rows, n = rows_of(list(counts))
    return totals(rows, np.repeat(np.fromiter(counts.values(), np.float64, len(counts)), n))


def totals(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, where = np.unique(rows, return_inverse=True)
    return distinct.astype(np.int32), np.bincount(where, weights).astype(np.float32)


def fit(rows: list[tuple], epochs: int = 4, rate: float = 0.5, seed: int = SEED) -> tuple[np.ndarray, np.ndarray] | None:
    """Each vector row's contribution to the two logits, and the biases."""
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((2 << BITS, DIM)) - 0.5) / DIM).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    bags = [(at, n / (PRIOR + n.sum())) for at, n in (bag(r[1]) for r in rows)]
    labels = np.array([int(r[2]) for r in rows])
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, share = bags[i]
            own = vectors[at]
            hidden = share @ own
            p = np.exp(hidden @ out + bias - (hidden @ out + bias).max())
            p /= p.sum()
            p[labels[i]] -= 1
            step = rate * (1 - done / steps)
            back = out @ p
            out -= step * np.outer(hidden, p)
            bias -= 0.1 * step * p
            vectors[at] = own - (step * share * len(at) ** 0.5)[:, None] * back
            done += 1
    return (vectors @ out).astype(np.float32), bias


def scorer(model):
    """A function of texts that gives their scores."""
    if model is None:
        return lambda texts: [1.0] * len(texts)
    logits, bias = model
    difference = (logits[:, 1] - logits[:, 0]).astype(np.float64)
    base = float(bias[1] - bias[0])
    known: dict[str, complex] = {}  # a word's sum and the number of its rows in one number, so that one pass adds both

    def score(texts):
        bags = [words_of(x) for x in texts]
        if len(known) > CACHED:
            known.clear()
        new = list({w for b in bags for w in b}.difference(known))
        for at in range(0, len(new), 1 << 16):
            part = new[at : at + (1 << 16)]
            rows, n = rows_of(part)
            known.update(zip(part, (np.add.reduceat(difference[rows], np.cumsum(n) - n) + 1j * n).tolist()))
        totals_ = [sum(map(known.__getitem__, b), 0j) for b in bags]
        return [1 / (1 + float(np.exp(-np.clip(base + t.real / (PRIOR + t.imag), -35, 35)))) for t in totals_]

    return score


def scores(docs: DataFrame, model, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """key, score (of label 1), predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** (BITS + 1) rows of two numbers, 1 MB

    def make():
        score = scorer(shared.value)

        def apply(cols):
            s = score(cols[text])
            return {key: cols[key], "score": s, "predicted": [int(x >= threshold) for x in s]}

        return apply

    return map_arrow(docs.select(key, text), f"{key} {dict(docs.dtypes)[key]}, score double, predicted int", make)


def keep(docs: DataFrame, model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are predicted to be of label 1, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = scorer(shared.value)
        return lambda texts: [s >= threshold for s in score(texts)]

    return keep_arrow(docs, text, make)


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, text: str = "text", key: str = "doc_id"):
    return fit([(k, t, int(y > 0)) for k, t, y in sample(docs, labels, "quality", per_label, SEED, text, key)])
