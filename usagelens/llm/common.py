"""Helpers shared by the training-data operators.

``text_batches`` is the one place where Arrow batches are cut to a bounded
number of text bytes, so that a task's memory follows ``max_bytes`` (or the
single longest text), never the size of a partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from usagelens.session import scratch_path

U64 = np.uint64
MAX_BATCH_BYTES = 4 << 20

# ``[^\x20\x09-\x0D]+`` as the Java and RE2 pattern of a separator run.
WORD_GAP = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan above is
    done once, and a lost executor costs a task, not the whole lineage."""
    spark = df.sparkSession
    path = f"{scratch_path(spark, name)}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def smallest_hashes(ids: DataFrame, groups: list[str], n: int, key: str = "doc_id", salts: int = 64) -> DataFrame:
    """The ``n`` rows of each group with the smallest hash of ``key``, and
    their ``place`` from 1. Taken per salt first, so a group of any size meets
    in one task with at most ``salts * n`` rows."""
    order = [F.xxhash64(key), F.col(key)]
    salted = ids.withColumn("__salt", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(salts)))
    near = F.row_number().over(Window.partitionBy(*groups, "__salt").orderBy(*order))
    salted = salted.withColumn("place", near).where(F.col("place") <= n).drop("__salt")
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return salted.withColumn("place", place).where(F.col("place") <= n)


def text_bytes(column: pa.Array) -> pa.Array:
    """A string column as bytes, null as empty."""
    return pc.fill_null(column, "").cast(pa.large_binary())


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text",
                 max_bytes: int = MAX_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``max_bytes`` of ``column``
    (or one row, if a single text is longer)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered for at most ``bound`` words."""

    def __init__(self, bound: int = 400_000):
        import xxhash
        super().__init__()
        self._hash, self._bound = xxhash.xxh3_64_intdigest, bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._bound:
            self.clear()
        h = self[word] = self._hash(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
