"""Language identification by sparse logistic regression (operator 8).

Features are TF-IDF values of character n-grams (see ``ngrams``); document
frequencies come from all training documents. The weights of a multinomial
logistic regression are trained by follow-the-regularised-leader (proximal)
with elastic-net penalties, so most weights are exactly zero. A temperature
fitted on other training documents calibrates the scores.

Bounds: frequencies and predictions cover every document; the weights are
fitted on at most ``FIT_DOCS`` training documents per language and the
temperature on at most ``CALIBRATION_DOCS`` per language, those with the
smallest hash of their doc_id.

Edge cases: a null text and one without a letter get ``und`` with score 1.0;
a null lang is never learned from; without any training document every text
gets ``und`` with score 0.0; repeated rows are judged alike; a null doc_id is
neither held out nor trained on; an empty table gives an empty result. Only
the text is an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import ngrams
from .common import smallest_hashes, text_batches, text_bytes

FIT_DOCS = 400
CALIBRATION_DOCS = 200
FOLDS = 5
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Ftrl:
    """Multinomial logistic regression, follow the regularised leader."""

    def __init__(self, n_classes: int, n_features: int, alpha: float = 0.5, beta: float = 1.0,
                 l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((n_features, n_classes))
        self.n = np.zeros((n_features, n_classes))

    def weights(self, rows: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, used: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(used)
        p = softmax(values @ w)
        p[label] -= 1.0
        g = values[:, None] * p[None, :]
        sigma = (np.sqrt(self.n[used] + g * g) - np.sqrt(self.n[used])) / self.alpha
        self.z[used] += g - sigma * w
        self.n[used] += g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature of the smallest log loss, by golden-section search on its
    logarithm (the loss has one minimum in 1 / temperature)."""
    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(x)), labels]).mean())

    low, high, ratio = -2.0, 4.0, (5 ** 0.5 - 1) / 2
    while high - low > 1e-3:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def predict(self, text: bytes) -> tuple[str, float]:
        used, values = ngrams.tf_idf(text, self.idf)
        p = softmax(values @ self.weights[used] / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def train(docs: DataFrame, fit_docs: int = FIT_DOCS, calibration_docs: int = CALIBRATION_DOCS,
          epochs: int = 3) -> Model | None:
    """Fit on doc_id, text, lang rows that are not held out."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n_docs, frequencies = ngrams.document_frequencies(known)
    # the sample: ids first, so that no text is sorted
    ids = smallest_hashes(known.select("doc_id", "lang"), ["lang"], fit_docs + calibration_docs)
    rows = known.select("doc_id", "text", "lang").join(F.broadcast(ids.select("doc_id", "lang", "place")), ["doc_id", "lang"])
    sample = sorted(rows.collect(), key=lambda r: (r.place, r.lang, r.text))
    if not sample:
        return None
    languages = sorted({r.lang for r in sample})
    idf = ngrams.idf(n_docs, frequencies)
    data = [(*ngrams.tf_idf(r.text.encode(), idf), languages.index(r.lang), r.place) for r in sample]
    fit = [d for d in data if d[3] % 3] if any(d[3] % 3 for d in data) else data
    calibrate = [d for d in data if d[3] % 3 == 0] or fit
    model = Ftrl(len(languages), ngrams.BUCKETS)
    for _ in range(epochs):
        for used, values, label, _ in fit:
            model.update(used, values, label)
    weights = model.weights(slice(None))
    logits = np.array([values @ weights[used] for used, values, _, _ in calibrate])
    temperature = fit_temperature(logits, np.array([d[2] for d in calibrate]))
    return Model(languages, idf, weights, temperature)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in text_batches(batches):
            found = []
            for text, letters in zip(text_bytes(batch.column("text")).to_pylist(), batch.column("letters").to_pylist()):
                if not letters:
                    found.append((UNKNOWN, 1.0))
                else:
                    found.append(m.predict(text) if m is not None else (UNKNOWN, 0.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"),
                 pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held_out"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
