"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashes of a text's words, of neighbouring words and of words with one or two others between (lower case, ASCII punctuation as white
space). Per-coordinate rates and the L1 penalty leave a small number of non-zero weights, which are broadcast: at most 2 ** BITS of them, whatever the input.

Learns from a bounded sample (``per_label`` documents of each label) outside the held-out fold. Scores depend on the text alone, so repeated rows and equal
texts get equal ones, null ids included; a null or empty text has no features, so its score is that of the intercept; without training rows all scores are 0.
A score that equals the threshold is predicted 1, and keep() drops it. Texts are read whole; an empty table gives no rows; scores() has the key and its own
columns only, and keep() all columns of its input as they are.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from noticeflow.llm.common import keep_arrow, map_arrow
from noticeflow.llm.training import sample

BITS = 20
PER_LABEL = 4000
SEED = 8
SPACES = bytes(32 if not (chr(b).isalnum() or b >= 128) else b for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)
THRESHOLD = 0.5


def features(text: str | None) -> np.ndarray:
    """Hashes, with repetitions, of the words, pairs and skip-grams of a text."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(SPACES).split()
    one = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) * MIX
    shift = np.uint64(64 - BITS)
    parts = [one >> shift]
    for apart in (1, 2, 3):
        if len(one) > apart:
            parts.append(((one[:-apart] ^ (one[apart:] >> np.uint64(31 + apart))) * MIX + np.uint64(apart)) * MIX >> shift)
    return np.concatenate(parts).astype(np.int64)


@dataclass
class Ftrl:
    """FTRL-proximal for one output: per-coordinate sums z and n, from which weights follow in closed form."""

    size: int
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.1

    def __post_init__(self):
        self.z, self.n = np.zeros(self.size), np.zeros(self.size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: float, weight: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(rows: list[tuple], epochs: int = 6, seed: int = SEED) -> tuple[float, np.ndarray, np.ndarray]:
    """Intercept, and indices and values of the non-zero weights; the last coordinate is the intercept's."""
    size = 1 << BITS
    model, labels = Ftrl(size + 1), np.array([r[2] for r in rows], float)
    if not len(rows):
        return -40.0, np.empty(0, np.int64), np.empty(0, np.float32)
    sets = [np.append(np.unique(features(r[1])), size).astype(np.int32) for r in rows]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            model.learn(sets[i], labels[i], 1.0)
    w = model.weights()
    at = np.flatnonzero(w[:size])
    return float(w[size]), at, w[at].astype(np.float32)


def scorer(model):
    """A function of texts that gives their scores."""
    intercept, at, values = model
    dense = np.zeros(1 << BITS, np.float32)
    dense[at] = values

    def score(text):
        f = features(text)
        f = np.unique(f[dense[f] != 0])
        return 1 / (1 + float(np.exp(-np.clip(intercept + dense[f].sum(dtype=np.float64), -35, 35))))

    return lambda texts: [score(x) for x in texts]


def scores(docs: DataFrame, model, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """key, score, predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** BITS weights, 12 MB

    def make():
        score = scorer(shared.value)

        def apply(cols):
            s = score(cols[text])
            return {key: cols[key], "score": s, "predicted": [int(x >= threshold) for x in s]}

        return apply

    return map_arrow(docs.select(key, text), f"{key} {dict(docs.dtypes)[key]}, score double, predicted int", make)


def keep(docs: DataFrame, model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = scorer(shared.value)
        return lambda texts: [s < threshold for s in score(texts)]

    return keep_arrow(docs, text, make)


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, text: str = "text", key: str = "doc_id"):
    return fit([(k, t, int(y > 0)) for k, t, y in sample(docs, labels, "toxic", per_label, SEED, text, key)])
