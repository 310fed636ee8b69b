"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text's hashed character n-grams (lower case, whole text) are weighted by 1 + log of their count and by their inverse document frequency, and scaled to unit
length. Document frequencies are counted over all documents outside the held-out fold that have a language, in one distributed pass; the weights are learned by
follow-the-regularised-leader with elastic-net penalties from a bounded sample of the same documents (``per_label`` of each language); a temperature, fitted on a
part of the sample that the weights don't see, calibrates the scores.

Predictions depend on the text alone, so repeated rows and equal texts get equal ones, whatever their ids, null ids included. A null text, and one without a
letter, is ``und`` with score 0, as is everything if there is no row to learn from. Ties go to the language that sorts first. Very long texts are counted in
blocks, whole. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import held_out, map_arrow
from noticeflow.llm.training import sample

BITS = 15
GRAMS = (1, 2, 3)
PER_LABEL = 1000
SEED = 1
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
BLOCK = 1 << 20


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of a text and how often each occurs; very long texts are counted in overlapping blocks."""
    text = text.lower()
    total = np.zeros(1 << BITS, np.int64)
    reach = max(GRAMS) - 1
    for at in range(0, max(1, len(text)), BLOCK):
        data = np.frombuffer(text[at : at + BLOCK + reach].encode("utf-32-le", "surrogatepass"), np.uint32)
        own = min(BLOCK, len(text) - at)
        h = data * np.uint32(0x85EBCA6B)
        for n in range(1, reach + 2):
            if n > 1:
                h = (h[: len(data) - n + 1] ^ (h[: len(data) - n + 1] >> np.uint32(15))) * np.uint32(0x01000193) + data[n - 1 :] * np.uint32(0xC2B2AE35)
            if n in GRAMS:
                total += np.bincount((h[:own] ^ np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS), minlength=1 << BITS)
    found = np.flatnonzero(total)
    return found, total[found]


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter; the expression also finds number-like characters, which aren't letters."""
    return bool(text) and any(map(str.isalpha, (m[0] for m in LETTER.finditer(text))))


def document_frequencies(docs: DataFrame, label: str, text: str, key: str) -> tuple[int, np.ndarray]:
    """Number of learnable documents, and in how many each hashed n-gram occurs: a sum for each task, then one for each n-gram."""
    learnable = docs.select(key, text, label).where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(text).isNotNull() & ~held_out(key)).select(text)

    def run(batches):
        total = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for x in batch.column(0).slice(at, 256).to_pylist():
                    total[counts(x)[0]] += 1
                    total[-1] += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["gram", "n"])

    rows = learnable.mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most 2 ** BITS + 1
    total = np.zeros((1 << BITS) + 1, np.int64)
    for gram, n in rows:
        total[gram] = n
    return int(total[-1]), total[:-1]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = counts(text)
    values = (1 + np.log(n)) * idf[at]
    return at, values / max(1e-12, np.sqrt((values * values).sum()))


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple], idf: np.ndarray, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = SEED):
    """Languages, sparse weights (indices, rows of values) and temperature."""
    langs = sorted({r[2] for r in rows})
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    kept = order[: len(rows) // 5] if len(rows) >= 50 else order[:0]
    learn = order[len(kept) :]
    vectors, labels = [vector(r[1], idf) for r in rows], np.array([langs.index(r[2]) for r in rows])
    z, n = np.zeros((1 << BITS, len(langs))), np.zeros((1 << BITS, len(langs)))

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(learn):
            at, values = vectors[i]
            w = weights(at)
            p = softmax(values @ w)
            p[labels[i]] -= 1
            g = values[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    every = weights(slice(None))
    used = np.flatnonzero(every.any(axis=1))
    temperature = 1.0
    if len(kept):
        logits = np.array([vectors[i][1] @ every[vectors[i][0]] for i in kept])
        losses = {t: -np.log(softmax(logits / t)[np.arange(len(kept)), labels[kept]] + 1e-12).sum() for t in np.geomspace(0.05, 20, 121)}
        temperature = float(min(losses, key=losses.get))
    return langs, used, every[used].astype(np.float32), temperature


def train(docs: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id", per_label: int = PER_LABEL):
    """Document frequencies as weights, and the model; None if there is nothing to learn from."""
    rows = [r for r in sample(docs, None, label, per_label, SEED, text, key) if has_letter(r[1])]
    if not rows:
        return None
    total, frequency = document_frequencies(docs, label, text, key)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    return (idf, *fit(rows, idf))


def predict(docs: DataFrame, model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights for each language

    def make():
        if shared.value is None:
            return lambda cols: {key: cols[key], "lang_pred": [UNKNOWN] * len(cols[key]), "score": [0.0] * len(cols[key])}
        idf, langs, used, values, temperature = shared.value
        dense = np.zeros((1 << BITS, len(langs)))
        dense[used] = values

        def apply(cols):
            out = {key: cols[key], "lang_pred": [], "score": []}
            for x in cols[text]:
                name, score = UNKNOWN, 0.0
                if has_letter(x):
                    at, v = vector(x, idf)
                    p = softmax(v @ dense[at] / temperature)
                    best = int(p.argmax())
                    name, score = langs[best], min(1.0, float(p[best]))
                out["lang_pred"].append(name)
                out["score"].append(score)
            return out

        return apply

    return map_arrow(docs.select(key, text), f"{key} {dict(docs.dtypes)[key]}, lang_pred string, score double", make)
