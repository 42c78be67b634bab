"""Hashed character n-grams of whole texts as TF-IDF rows.

A text is its UTF-8 bytes with A-Z lower-cased and every run of characters
that are no letters made one space; n-grams are 1 to 4 bytes long and hashed
to ``BUCKETS`` buckets, whatever the text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, mix64, text_batches, text_bytes

BUCKETS = 1 << 15
SIZES = (1, 2, 3, 4)

# A-Z to a-z; other ASCII characters than letters to a space
_TABLE = np.array([c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
                   for c in range(256)], np.uint8)
_SPACE = np.uint8(0x20)


def buckets_of(text: bytes) -> np.ndarray:
    """Bucket of every n-gram of the text."""
    raw = _TABLE[np.frombuffer(b" " + text + b" ", np.uint8)]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != _SPACE) | (raw[:-1] != _SPACE)
    raw = raw[keep].astype(np.uint32)
    out, code = [], np.zeros(len(raw), np.uint32)
    for n in range(1, max(SIZES) + 1):
        if len(raw) < n:
            break
        code = (code[:len(raw) - n + 1] << np.uint32(8)) | raw[n - 1:]
        if n in SIZES:  # multiplicative hash of the n bytes
            h = (code ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            out.append((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(17))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def term_counts(text: bytes) -> np.ndarray:
    """Count of each bucket."""
    return np.bincount(buckets_of(text), minlength=BUCKETS)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, per bucket the documents that hold it) over all rows: each
    task sums its rows, and the sums, a row per bucket, are added by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in text_batches(batches):
            for text in text_bytes(batch.column("text")).to_pylist():
                seen = np.zeros(BUCKETS, bool)
                seen[buckets_of(text)] = True
                total += seen
                n += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, BUCKETS), pa.int32()), pa.array(np.r_[n, total], pa.int64())], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").sum("n").collect()
    out = np.zeros(BUCKETS + 1, np.int64)
    for bucket, n in rows:  # at most BUCKETS + 1 rows, whatever the corpus
        out[bucket + 1] = n
    return int(out[0]), out[1:]


def idf(n_docs: int, frequencies: np.ndarray) -> np.ndarray:
    return np.log((1.0 + n_docs) / (1.0 + frequencies)) + 1.0


def tf_idf(text: bytes, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): sublinear term counts times idf, of length one."""
    counts = term_counts(text)
    used = np.flatnonzero(counts)
    values = (1.0 + np.log(counts[used])) * weights[used]
    norm = np.sqrt((values * values).sum())
    return used, values / norm if norm else values


def hash_order(ids: np.ndarray) -> np.ndarray:
    return mix64(ids.astype(np.int64).view(np.uint64) + U64(77))
