"""Benchmark decontamination with a positional inverted index (operator 3).

The index is partitioned by document: a shard covers some consecutive
documents of one task (at most ``SHARD_BYTES`` of text, or one longer text) and
maps each term to the sorted positions at which it occurs. A shard is one row
of a Parquet table in the shared folder. No term has a global posting list, so
a term of a third of all words costs no hot key, and each shard is searched
where it is read, without a shuffle.

A search takes windows of test terms. Per shard, each window starts from the
postings of its rarest term, moved back by the term's offset, and intersects
them with the postings of its other terms, rarest first, moved likewise. What
is left are the exact phrase matches. With ``slop`` s, another term may lie up
to s words from its place (proximity matches).

Only terms of the test set are indexed if a vocabulary is given; postings of
others would never be read. The vocabulary and the windows are broadcast in
blocks of at most ``MAX_BLOCK_BYTES`` of test text; each block has its own
index pass, so any test set is searched whole.

Words: A-Z lower-cased, then runs of ``[0-9a-z]`` and non-ASCII characters.

Edge cases: null and empty texts have no words; a test item without words has
no window, one with fewer words than a window is one window; repeated rows of
either table are searched alike (an item counts once per id); a null doc_id is
kept; a null item_id is left out; empty tables give zero counts or no rows;
input columns other than doc_id / text and item_id / text are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_batches, text_bytes, to_shared

WINDOW = 10
SHARD_BYTES = 4 << 20
MAX_BLOCK_BYTES = 4 << 20

INDEX = ("shard long, row long, doc_ids array<bigint>, n_words array<bigint>, "
         "terms array<binary>, ends array<bigint>, postings binary")

_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80
               else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """UTF-8 text to words; every byte of a non-ASCII character is >= 0x80."""
    return text.translate(_TABLE).split()


def build_index(docs: DataFrame, vocabulary=None, gap: int = WINDOW, name: str = "positional-index") -> DataFrame:
    """Write the positional index of ``doc_id, text`` rows; returns the table.

    Positions number the words of a shard's documents in order; ``gap`` unused
    positions follow each document, so no window spans two of them.
    ``vocabulary`` is a broadcast set of words (bytes), None for all words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value if vocabulary is not None else None
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(text_batches(batches, max_bytes=SHARD_BYTES)):
            counts, terms, ids, at = [], {}, [], []
            first = 0
            for text in text_bytes(batch.column("text")).to_pylist():
                words = words_of(text)
                if known is None:
                    own = np.fromiter((terms.setdefault(w, len(terms)) for w in words), np.int32, len(words))
                    ids.append(own)
                    at.append(np.arange(first, first + len(words), dtype=np.int64))
                else:
                    own = np.fromiter((known.get(w, -1) for w in words), np.int32, len(words))
                    place = np.flatnonzero(own >= 0)
                    ids.append(own[place])
                    at.append(place + first)
                counts.append(len(words))
                first += len(words) + gap
            code, place = np.concatenate(ids), np.concatenate(at)
            order = np.argsort(code, kind="stable")  # positions ascend in each term
            used, size = np.unique(code, return_counts=True)
            names = list(terms) if known is None else None
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | number], pa.int64()), pa.array([batch.num_rows], pa.int64()),
                 pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                 pa.array([counts], pa.list_(pa.int64())),
                 pa.array([[names[c] if names else known.names[c] for c in used.tolist()]], pa.list_(pa.binary())),
                 pa.array([np.cumsum(size)], pa.list_(pa.int64())),
                 pa.array([place[order].astype("<i4").tobytes()], pa.binary())],
                ["shard", "row", "doc_ids", "n_words", "terms", "ends", "postings"])

    return to_shared(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX), name)


class Vocabulary(dict):
    """Word -> number, with the words in order."""

    def __init__(self, words):
        self.names = sorted(words)
        super().__init__((w, i) for i, w in enumerate(self.names))

    def __reduce__(self):
        return Vocabulary, (self.names,)


class Windows:
    """Distinct windows of test items and the items that hold each."""

    def __init__(self, items: list[tuple[int, list[bytes]]], width: int = WINDOW):
        held: dict[tuple[bytes, ...], set[int]] = {}
        for item, words in items:
            for k in range(max(1, len(words) - width + 1) if words else 0):
                held.setdefault(tuple(words[k:k + width]), set()).add(item)
        self.width = width
        self.windows = list(held)
        self.items = [sorted(held[w]) for w in self.windows]
        self.vocabulary = Vocabulary({t for w in self.windows for t in w})

    def numbers(self) -> np.ndarray:
        """Window x offset -> word number, -1 behind a short window's end."""
        out = np.full((len(self.windows), self.width), -1, np.int64)
        for i, w in enumerate(self.windows):
            out[i, :len(w)] = [self.vocabulary[t] for t in w]
        return out


class Shard:
    """Postings of one shard, as one sorted key per (term, position)."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray, postings: np.ndarray, n_codes: int, span: int):
        self.span = span + 2  # positions of a term stay apart from the next term's
        self.size = np.zeros(n_codes + 1, np.int64)  # the last: no such term
        self.start = np.zeros(n_codes + 1, np.int64)
        size = np.diff(ends, prepend=0)
        self.size[codes], self.start[codes] = size, ends - size
        self.postings = postings.astype(np.int64)
        self.keys = np.repeat(codes.astype(np.int64), size) * self.span + self.postings

    def find(self, windows: np.ndarray, slop: int = 0, most: int = 1 << 20):
        """(window, start) of every match; a block of windows at a time, so
        that at most ``most`` candidates (or one window's) are held."""
        length = (windows >= 0).sum(1)
        size = np.where(windows >= 0, self.size[windows], np.iinfo(np.int64).max)
        rarity = np.argsort(size, axis=1, kind="stable")
        least = size[np.arange(len(windows)), rarity[:, 0]] if len(windows) else np.empty(0, np.int64)
        live = np.flatnonzero((least > 0) & (length > 0))
        ends = np.cumsum(least[live])
        at = 0
        while at < len(live):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield self._intersect(windows, rarity, live[at:stop], slop)
            at = stop

    def _intersect(self, windows, rarity, chosen, slop):
        anchor = rarity[chosen, 0]
        term = windows[chosen, anchor]
        n = self.size[term]
        window = np.repeat(chosen, n)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start = self.postings[np.repeat(self.start[term], n) + inside] - np.repeat(anchor, n)
        window, start = window[start >= 0], start[start >= 0]
        for k in range(1, windows.shape[1]):
            if not len(window):
                break
            offset = rarity[window, k]
            code = windows[window, offset]
            low = code * self.span + np.maximum(start + offset - slop, 0)
            i = np.searchsorted(self.keys, low)
            high = code * self.span + np.minimum(start + offset + slop, self.span - 1)
            found = (i < len(self.keys)) & (self.keys[np.minimum(i, len(self.keys) - 1)] <= high)
            keep = found | (code < 0)
            window, start = window[keep], start[keep]
        return window, start


def search(index: DataFrame, windows, slop: int = 0, gap: int = WINDOW) -> DataFrame:
    """Matches per document of the index: doc_id, n_words, n_hit (words inside
    an exact match), items (ids with an exact match), spans (first word and
    length of each exact match), near_items (ids with a match within ``slop``
    but no exact one).

    ``windows`` is a broadcast ``Windows``."""
    schema = ("shard long, at long, doc_id long, n_words long, n_hit long, items array<bigint>, "
              "spans array<struct<start:bigint,length:bigint>>, near_items array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = windows.value
        numbers, vocabulary = test.numbers(), test.vocabulary
        length = (numbers >= 0).sum(1)
        for batch in batches:
            for i in range(batch.num_rows):
                yield shard_matches(batch.slice(i, 1), numbers, length, vocabulary, test)

    def shard_matches(row, numbers, length, vocabulary, test):
        doc_ids = row.column("doc_ids")[0].as_py()
        n_words = np.array(row.column("n_words")[0].as_py(), np.int64)
        terms = row.column("terms")[0].as_py()
        ends = np.array(row.column("ends")[0].as_py(), np.int64)
        postings = np.frombuffer(row.column("postings")[0].as_py(), "<i4")
        codes = np.array([vocabulary.get(t, -1) for t in terms], np.int64)
        if len(codes) and (codes < 0).any():  # an index of more words than the test's
            known = codes >= 0
            size = np.diff(ends, prepend=0)
            postings = postings[np.repeat(known, size)]
            codes, ends = codes[known], np.cumsum(size[known])
        order = np.argsort(codes, kind="stable")
        if len(codes) and (order != np.arange(len(codes))).any():
            size = np.diff(ends, prepend=0)
            parts = np.split(postings, ends[:-1])
            postings = np.concatenate([parts[k] for k in order])
            codes, ends = codes[order], np.cumsum(size[order])
        starts = np.cumsum(n_words + gap) - (n_words + gap)
        span = int((n_words + gap).sum()) + 1
        shard = Shard(codes, ends, postings, len(vocabulary), span)
        cover = np.zeros(span + 1, np.int64)
        spans, items, near = [], [], []
        for limit in ([0] if not slop else [0, slop]):
            for window, start in shard.find(numbers, limit):
                doc = np.searchsorted(starts, start, "right") - 1
                pairs = items if limit == 0 else near
                pairs.append(np.unique(np.stack([doc, window]), axis=1))
                if limit == 0:
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + length[window], -1)
                    spans.append(np.unique(np.stack([doc, start - starts[doc], length[window]]), axis=1))
        n_hit = np.add.reduceat((np.cumsum(cover) > 0).astype(np.int64), starts)
        by_doc = [_items_by_doc(p, test, len(doc_ids)) for p in (items, near)]
        span_lists = [[] for _ in doc_ids]
        for found in spans:
            for d, s, n in found.T.tolist():
                span_lists[d].append({"start": s, "length": n})
        return pa.RecordBatch.from_arrays(
            [pa.array([row.column("shard")[0].as_py()] * len(doc_ids), pa.int64()),
             pa.array(range(len(doc_ids)), pa.int64()),
             pa.array(doc_ids, pa.int64()), pa.array(n_words), pa.array(n_hit),
             pa.array([sorted(x) for x in by_doc[0]], pa.list_(pa.int64())),
             pa.array(span_lists, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
             pa.array([sorted(y - x) for x, y in zip(*by_doc)], pa.list_(pa.int64()))],
            ["shard", "at", "doc_id", "n_words", "n_hit", "items", "spans", "near_items"])

    return index.mapInArrow(run, schema)


def _items_by_doc(pairs, test, n_docs) -> list[set[int]]:
    out: list[set[int]] = [set() for _ in range(n_docs)]
    for found in pairs:
        for d, w in found.T.tolist():
            out[d].update(test.items[w])
    return out


def item_blocks(items: DataFrame, width: int = WINDOW, max_bytes: int = MAX_BLOCK_BYTES) -> Iterator[Windows]:
    """Test items in blocks of at most ``max_bytes`` of text (or one longer
    item), fetched one by one."""
    held, size = [], 0
    for row in items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").toLocalIterator():
        text = row.text.encode()
        if held and size + len(text) > max_bytes:
            yield Windows(held, width)
            held, size = [], 0
        held.append((row.item_id, words_of(text)))
        size += len(text)
    yield Windows(held, width)


def find_contamination(docs: DataFrame, items: DataFrame, slop: int = 0) -> DataFrame:
    """One row per document: shard, at, doc_id, n_words, n_hit, items, spans,
    near_items. Results of several test blocks are merged per document."""
    sc = docs.sparkSession.sparkContext
    out = []
    for block in item_blocks(items):
        test = sc.broadcast(block)
        index = build_index(docs, sc.broadcast(block.vocabulary))
        out.append(search(index, test, slop))
    if len(out) == 1:
        return out[0]
    return _merge(out)


def _merge(parts: list[DataFrame]) -> DataFrame:
    """Every block indexes the same shards in the same order, so (shard, at)
    names a document. n_hit is recounted from the united spans."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    united = rows.groupBy("shard", "at").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"))
    hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
                      lambda a, s: F.struct(
                          F.greatest(a["end"], s["start"] + s["length"]).alias("end"),
                          (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).alias("n")),
                      lambda a: a["n"])
    return united.select("shard", "at", "doc_id", "n_words", hit.alias("n_hit"), "items", "spans",
                         F.array_except("near_items", "items").alias("near_items"))


def items_digest(items: Column) -> Column:
    """sha256 of the ids, sorted as strings and comma-joined."""
    return F.sha2(F.array_join(F.sort_array(F.transform(items, lambda x: x.cast("string"))), ","), 256)
