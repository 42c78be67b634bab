"""Quality scores by hierarchical empirical Bayes (operator 9).

1. Two document classifiers, quality and toxicity, are sparse logistic
   regressions over hashed words and word shapes of the whole text, fitted on
   at most ``FIT_DOCS`` labelled documents per label value (those with the
   smallest hash of their doc_id).
2. Grouped aggregations sum the quality evidence of all documents per path
   (a section of a host), per host and in total. Between-group variances by
   the method of moments give the prior strength of each level.
3. A host's rate is shrunk toward the global rate, a path's toward its host's,
   each as a beta posterior mean; a document's own evidence is taken out of
   its path and host first, so it never counts twice.
4. The document's log-odds are moved by the log-odds of its path's rate
   against the global one, limited to ``MAX_SHIFT``: a site tips a doubtful
   document, never a clear one.

``kept`` is a quality score of at least ``LOWEST`` and a toxicity score below
``TOXIC``: only documents that are clearly bad go.

Edge cases: a null or empty text has no evidence (document score: the labels'
share) and is not kept; null hosts and paths are groups of their own, empty
names; labels without a document and null labels are not used; without labels
all evidence is 0.5; repeated rows count as often as they occur; an empty table
gives an empty result; other input columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import smallest_hashes, text_batches, text_bytes
from .language_id import Ftrl

FIT_DOCS = 1500
BUCKETS = 1 << 16
CACHE_BOUND = 300_000
MAX_LOGIT = 8.0
MAX_SHIFT = 1.5
LOWEST, TOXIC = 0.3, 0.9

# letters, capitals and digits by their kind, other bytes as they are
_SHAPE = bytes(0x61 if 0x61 <= c <= 0x7A or c >= 0x80 else 0x41 if 0x41 <= c <= 0x5A
               else 0x30 if 0x30 <= c <= 0x39 else c for c in range(256))


class Features(dict):
    """Buckets of a word: the lower-cased word without punctuation around it,
    and its shape with runs of one kind made one."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        import xxhash
        if len(self) >= CACHE_BOUND:
            self.clear()
        kinds = word.translate(_SHAPE)
        shape = bytes(c for i, c in enumerate(kinds) if not i or c != kinds[i - 1])
        out = self[word] = (xxhash.xxh3_64_intdigest(word.lower().strip(b".,;:!?\"'()")) % (BUCKETS - 1) + 1,
                            BUCKETS + xxhash.xxh3_64_intdigest(shape) % BUCKETS)
        return out

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, values): words and shapes of length one each, a constant
        feature 0, and the tenth in which the share of repeated neighbours lies."""
        words = text.split()
        pairs = np.array([self[w] for w in words], np.int64).reshape(-1, 2)
        used, counts = np.unique(pairs, return_counts=True)
        values = 1.0 + np.log(counts)
        half = used >= BUCKETS  # words and shapes weigh alike
        for side in (half, ~half):
            norm = np.sqrt((values[side] ** 2).sum())
            values[side] /= norm or 1.0
        again = sum(a == b for a, b in zip(words, words[1:])) * 10 // max(1, len(words))
        return (np.r_[0, used, 2 * BUCKETS + again], np.r_[1.0, values, 1.0]) if words else (used, values)


class Classifier:
    """Weights and the slope and intercept that calibrate their sum."""

    def __init__(self, weights: np.ndarray, share: float, scale: tuple[float, float]):
        self.weights, self.share, self.scale = weights, share, scale

    def logit(self, used: np.ndarray, values: np.ndarray) -> float:
        if not len(used):
            return float(np.log(self.share / (1 - self.share)))
        slope, intercept = self.scale
        return float(np.clip(slope * (values @ self.weights[used]) + intercept, -MAX_LOGIT, MAX_LOGIT))


def fit_scale(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Slope and intercept of y's log-odds in x, by Newton steps with a small
    ridge penalty; the identity if y has one value only."""
    if y.min() == y.max():
        return 1.0, 0.0
    design, w = np.stack([x, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(hessian, design.T @ (p - y) + 1e-2 * w)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def _fit(rows: list, column: str, epochs: int = 6) -> Classifier | None:
    """Weights from two thirds of the rows, calibration from the others."""
    data = [(r.features, int(r[column])) for r in rows if r[column] is not None]
    positive = sum(y for _, y in data)
    if not 0 < positive < len(data):
        return None
    rest = data[2::3] if 0 < sum(y for _, y in data[2::3]) < len(data[2::3]) else data
    fit = [d for i, d in enumerate(data) if i % 3 < 2] if rest is not data else data
    model = Ftrl(2, 2 * BUCKETS + 10, alpha=1.0, l1=0.02, l2=0.02)
    for _ in range(epochs):
        for (used, values), y in fit:
            model.update(used, values, y)
    w = model.weights(slice(None))
    weights = w[:, 1] - w[:, 0]
    x = np.array([values @ weights[used] for (used, values), _ in rest])
    return Classifier(weights, (positive + 1) / (len(data) + 2), fit_scale(x, np.array([y for _, y in rest])))


class _Row(dict):
    __getattr__ = dict.__getitem__


def fit_classifiers(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> dict[str, Classifier | None]:
    """Quality and toxicity classifiers from labelled documents."""
    labelled = labels.select("doc_id", "quality", "toxic").where(F.col("doc_id").isNotNull()).distinct()
    chosen = smallest_hashes(labelled, ["quality", "toxic"], fit_docs)
    # at most fit_docs rows for each of the nine pairs of labels, null included
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").collect()
    features = Features()
    data = [_Row(features=features.of(r.text.encode()), quality=r.quality, toxic=r.toxic)
            for r in sorted(rows, key=lambda r: (r.place, r.doc_id, r.text))]
    return {"quality": _fit(data, "quality"), "toxic": _fit(data, "toxic")}


def document_evidence(docs: DataFrame, classifiers: dict[str, Classifier | None], keep: list[str]) -> DataFrame:
    """``keep`` columns with has_words, doc_score and toxic_score."""
    shared = docs.sparkSession.sparkContext.broadcast(classifiers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, models = Features(), shared.value
        for batch in text_batches(batches):
            words, scores = [], {"quality": [], "toxic": []}
            for text in text_bytes(batch.column("text")).to_pylist():
                used, values = features.of(text)
                words.append(len(used) > 0)
                for name, out in scores.items():
                    m = models[name]
                    out.append(0.5 if m is None else 1 / (1 + np.exp(-m.logit(used, values))))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(words, pa.bool_()), pa.array(scores["quality"], pa.float64()),
                 pa.array(scores["toxic"], pa.float64())], [*keep, "has_words", "doc_score", "toxic_score"])

    types = dict(docs.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(
        run, f"{schema}, has_words boolean, doc_score double, toxic_score double")


def _strength(groups: DataFrame, rate: Column, n: Column) -> float:
    """Prior strength (pseudo-documents) from the variance of group rates
    beyond what their sizes explain; large if there is none."""
    total = groups.agg(F.sum(n).alias("n"), F.sum(rate * n).alias("s"), F.sum(n * n).alias("nn"),
                       F.sum(n * rate * rate).alias("q"), F.count("*").alias("k")).first()
    if not total.n or total.k < 2:
        return 1e6
    m = total.s / total.n
    within = m * (1 - m)
    size = (total.n - total.nn / total.n) / (total.k - 1)  # mean size, unequal groups
    between = (total.q - total.n * m * m) / (total.k - 1)
    variance = (between - within) / size if size > 0 else 0.0
    return float(min(max(within / variance - 1, 1.0), 1e6)) if variance > 0 else 1e6


def _log_odds(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def quality_scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang",
                   keep_evidence=lambda df: df) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, doc_score, site_score,
    toxic_score, kept. ``keep_evidence`` may store the evidence table."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
                       F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"))
    classifiers = fit_classifiers(docs, labels)
    seen = keep_evidence(document_evidence(docs, classifiers, ["doc_id", "host", "path"]))
    judged = seen.where("has_words")
    paths = judged.groupBy("host", "path").agg(F.sum("doc_score").alias("path_sum"), F.count("*").alias("path_n"))
    hosts = paths.groupBy("host").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n"))
    totals = hosts.agg(F.sum("host_sum").alias("s"), F.sum("host_n").alias("n")).first()
    overall = (totals.s or 0.0) / totals.n if totals.n else 0.5
    of_host = _strength(hosts, F.col("host_sum") / F.col("host_n"), F.col("host_n"))
    of_path = _strength(paths, F.col("path_sum") / F.col("path_n"), F.col("path_n"))

    out = seen.join(paths, ["host", "path"], "left").join(hosts, "host", "left").na.fill(
        0, ["path_sum", "path_n", "host_sum", "host_n"])
    own, one = F.when(F.col("has_words"), F.col("doc_score")).otherwise(0.0), F.col("has_words").cast("int")
    host_rate = (F.col("host_sum") - own + of_host * overall) / (F.col("host_n") - one + of_host)
    out = out.withColumn("site_score", (F.col("path_sum") - own + of_path * host_rate) / (F.col("path_n") - one + of_path))
    shift = F.greatest(F.lit(-MAX_SHIFT), F.least(F.lit(MAX_SHIFT), _log_odds(F.col("site_score")) - _log_odds(F.lit(overall))))
    out = out.withColumn("score", 1 / (1 + F.exp(-(_log_odds(F.col("doc_score")) + shift))))
    kept = F.col("has_words") & (F.col("score") >= LOWEST) & (F.col("toxic_score") < TOXIC)
    return out.select("doc_id", "score", "doc_score", "site_score", "toxic_score", kept.alias("kept"))
