"""Token ids of a corpus as one ordered binary stream (operator 4).

File format. The stream is a Parquet table (any store that Spark writes to,
committed per task, so a lost executor leaves no half file). A row is a block
of consecutive documents of one range partition:

    part, block    position of the block: ascending (part, block) is doc_id order
    doc_ids        ids of the block's documents (a null id stays null)
    lengths        number of ids of each document, its end id included
    words          Simple-8b words, little-endian unsigned 64-bit
    offsets        first word of each segment of 128 ids

Blocks end after ``BLOCK_IDS`` ids or with their document, so a reader's
memory is bounded by that or the longest document. A document's position in
the stream is the sum of all earlier lengths: sums per part (a row per
partition) give each part its start.

Texts are split at spaces and newlines before encoding: the vocabulary's
pre-tokeniser never joins text across white space, so pieces are encoded once
and remembered: about ``CACHE_BOUND`` of at most ``REMEMBERED`` letters per
worker, of which those not used lately are forgotten.

The strings of the vocabulary's added tokens (``<|endoftext|>``) get their ids,
as by the library's default; they hold no white space, so no split cuts them.

Edge cases: a null text counts as empty and still has its end id; documents of
one doc_id are ordered by text; a null doc_id comes first; an empty table gives
an empty stream; other input columns are not stored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from string import punctuation

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import simple8b
from .byte_bpe import byte_characters
from .common import text_batches, to_shared

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
BLOCK_IDS = 1 << 18
CACHE_BOUND = 600_000
REMEMBERED = 40
STREAM = ("part int, block int, doc_ids array<bigint>, lengths array<bigint>, "
          "words binary, offsets binary")


class WordEncoder:
    """Ids of texts by the tokenizers library, as unsigned 32-bit integers."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._chars = dict(enumerate(byte_characters()))
        self._marks: dict[str, bytes] = {}
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        pieces = lists.flatten().dictionary_encode()
        ids = self._distinct(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        each = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()),
                                        pa.array(np.frombuffer(b"".join(ids), "<u4")))
        out = each.take(pieces.indices).flatten().to_numpy()
        last = np.append(0, np.cumsum(lengths[pieces.indices.to_numpy()]))
        ends = last[np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
        return np.split(out, ends[:-1])

    def _distinct(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, as little-endian bytes."""
        young, old = self._young, self._old
        out = list(map(young.get, pieces))
        other = []
        for i in [i for i, x in enumerate(out) if x is None]:
            piece = pieces[i]
            x = old.get(piece)
            if x is None:
                # Latin-1 letters are one pre-token and normalise to lower case,
                # so the model alone gives their ids; the punctuation behind them
                # is a pre-token of its own.
                word = piece.rstrip(punctuation)
                if not word.isalpha() or not word.isascii() and max(word) >= "\u0100":
                    other.append(i)
                    continue
                lower = word.lower()
                x = None if lower == piece else young.get(lower) or old.get(lower)
                if x is None:
                    x = self._word(lower)
                    if len(lower) <= REMEMBERED:
                        young[lower] = x
                if len(word) < len(piece):
                    x += self._mark(piece[len(word):])
            out[i] = x
            if len(piece) <= REMEMBERED:
                young[piece] = x
        for k in range(0, len(other), 20_000):
            some = other[k:k + 20_000]
            found = self._tokenizer.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False)
            for i, e in zip(some, found):
                out[i] = np.array(e.ids, "<u4").tobytes()
                if len(pieces[i]) <= REMEMBERED:
                    young[pieces[i]] = out[i]
        if len(young) > CACHE_BOUND // 2:
            self._old, self._young = young, {}
        return out

    def _mark(self, mark: str) -> bytes:
        ids = self._marks.get(mark)
        if ids is None:
            ids = np.array(self._tokenizer.encode(mark, add_special_tokens=False).ids, "<u4").tobytes()
            if len(self._marks) < 10_000 and len(mark) <= REMEMBERED:
                self._marks[mark] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self._chars)
        ids = [t.id for t in self._model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def shared_encoder(path: str) -> WordEncoder:
    """One encoder per worker process."""
    return WordEncoder(path)


def write_stream(df: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Encode ``doc_id, text`` rows and write the stream to the shared folder,
    in ascending doc_id order; returns the written table."""
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(public_tokenizers.path(vocabulary))
        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            words, offsets = simple8b.encode(np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([doc_ids], pa.list_(pa.int64())),
                 pa.array([[len(h) for h in held]], pa.list_(pa.int64())),
                 pa.array([words.astype("<u8").tobytes()], pa.binary()),
                 pa.array([offsets.astype("<i4").tobytes()], pa.binary())],
                ["part", "block", "doc_ids", "lengths", "words", "offsets"])

        for batch in text_batches(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                doc_ids.append(doc_id)
                held.append(np.append(ids, end))
                size += len(ids) + 1
                if size >= BLOCK_IDS:
                    yield block()
                    doc_ids, held, size, number = [], [], 0, number + 1
        if held:
            yield block()

    ordered = df.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return to_shared(ordered.mapInArrow(run, STREAM), "token-stream")


def read_stream(stream: DataFrame, digests: bool = False) -> DataFrame:
    """Decode a stream: per document its part and block, ``before`` (ids in the
    block before it), doc_id, n_tokens and ``ids`` (LE unsigned 32-bit), or
    with ``digests`` ids_crc32 (the crc32 of those bytes) instead of them."""
    last = ("ids_crc32", "long") if digests else ("ids", "binary")
    names = ["part", "block", "before", "doc_id", "n_tokens", last[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # block by block
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                raw = memoryview(simple8b.decode(
                    np.frombuffer(row["words"], "<u8"), np.frombuffer(row["offsets"], "<i4"),
                    int(ends[-1])).astype("<u4").tobytes())
                ids = [raw[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                shown = pa.array(map(zlib.crc32, ids), pa.int64()) if digests else pa.array(map(bytes, ids), pa.binary())
                k = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * k, pa.int32()), pa.array([row["block"]] * k, pa.int32()),
                     pa.array(ends - lengths, pa.int64()), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(lengths, pa.int64()), shown], names)

    return stream.mapInArrow(run, f"part int, block int, before long, doc_id long, n_tokens long, {last[0]} {last[1]}")


def document_digests(stream: DataFrame) -> DataFrame:
    """Per document of the stream: doc_id, start, n_tokens, ids_crc32."""
    # ids before each part and block: a row per part, then a window per part
    sizes = stream.select("part", "block", F.aggregate(
        "lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("block_start", F.coalesce(F.sum("n").over(in_part), F.lit(0))).join(parts, "part") \
        .select("part", "block", (F.col("part_start") + F.col("block_start")).alias("block_start"))
    digests = read_stream(stream, digests=True)
    return digests.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
