"""Removal of repeated passages by suffix automata (operator 7).

A window is ``WINDOW`` consecutive words. Words covered by a window whose word
sequence also starts in a document with a smaller doc_id are removed; windows
are judged on the input.

1. Documents of equal words form a class. Its smallest doc_id goes on; the
   others lose every window.
2. Each window picks the smallest hash of its ``GRAM``-word grams (leftmost on
   ties). Equal windows pick equal grams, so only windows whose gram occurs in
   two or more documents can repeat. The consecutive windows of one document
   that share a picked gram are a piece; equal pieces are stored once with
   their smallest doc_id.
3. Pieces are dealt by gram, so equal windows meet in one task. Consecutive
   grams form reference shards of about ``SHARD_WORDS`` words. A shard's suffix
   automaton holds, per state, the smallest doc_id in which its strings end.
   Its pieces stream through it: a matching statistic of ``WINDOW`` or more
   whose state knows a smaller doc_id marks the window ending there.
4. A gram whose pieces have more words than a shard is not dealt: boilerplate
   of few words brings a distinct piece per document. Its windows pick again, by
   the longer grams of ``FINER`` (equal windows still pick equal grams), and
   the smaller pieces are judged like the first ones. The last gram is the
   window itself, which needs only its smallest doc_id: a sum per task first.
   So no task holds more words than a shard, and no piece is dropped.
5. Marked spans of a document are united and cut from its whole text.

The automata are dealt with their pieces and not broadcast: repeated text
grows with the corpus, so a broadcast would have no size bound, and each
automaton would need a pass over all documents.

Edge cases: null and empty texts and texts of fewer words than a window lose
nothing; rows of one doc_id and text are kept alike (no doc_id is smaller);
a null doc_id is kept whole and is no reference; an empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from .common import U64, WordHashes, mix64, text_batches, text_bytes, to_shared
from .near_dedup import only_ids

WINDOW = 50
GRAM = 10
FINER = (20, WINDOW)  # grams of pieces too many for a shard
SHARD_WORDS = 40_000

_WEIGHTS = mix64(np.arange(1, WINDOW + 1, dtype=np.uint64)) | U64(1)


def picked_grams(words: np.ndarray, width: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the gram of ``width`` words that each window picks."""
    n = len(words) - width + 1
    grams = words[:n] * _WEIGHTS[0]
    for k in range(1, width):
        grams = grams + words[k:k + n] * _WEIGHTS[k]
    grams = mix64(grams)
    views = sliding_window_view(grams, WINDOW - width + 1)
    at = np.concatenate([views[k:k + 4096].argmin(1) + np.arange(k, min(k + 4096, len(views)))
                         for k in range(0, len(views), 4096)])
    return at, grams[at]


def words_key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def summaries(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, words_key, digest of all words, distinct picked grams
    (empty for texts shorter than a window)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in text_batches(batches):
            n, keys, digests, grams = [], [], [], []
            for text in text_bytes(batch.column("text")).to_pylist():
                words = text.split()
                joined = b" ".join(words)
                n.append(len(words))
                keys.append(words_key(words))
                digests.append(sha256(joined).hexdigest())
                grams.append(np.unique(picked_grams(hashes.array(words))[1]).view(np.int64)
                             if len(words) >= WINDOW else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(digests, pa.string()), pa.array(grams, pa.list_(pa.int64()))],
                ["doc_id", "n_words", "words_key", "digest", "grams"])

    return docs.mapInArrow(run, "doc_id long, n_words long, words_key binary, digest string, grams array<bigint>")


def cut_pieces(words: np.ndarray, width: int = GRAM,
               wanted: list[int] | None = None) -> list[tuple[int, bytes, list[int], bytes]]:
    """(gram, piece_key, starts, words) of the distinct pieces around the grams
    ``wanted`` (all if None)."""
    at, gram = picked_grams(words, width)
    gram = gram.view(np.int64)
    cut = np.flatnonzero(np.diff(at)) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(at)]
    if wanted is not None:
        take = np.isin(gram[first], wanted)
        first, last = first[take], last[take]
    placed: dict[bytes, tuple[int, bytes, list[int], bytes]] = {}
    for s, e in zip(first.tolist(), last.tolist()):
        held = words[s:e + WINDOW - 1].tobytes()
        key = xxhash.xxh3_128_digest(held)
        if key in placed:
            placed[key][2].append(s)
        else:
            placed[key] = (int(gram[s]), key, [s], held)
    return list(placed.values())


def pieces(docs: DataFrame) -> DataFrame:
    """From doc_id, text, words_key, grams (the shared ones): gram, piece_key,
    doc_id, words_key, starts, words (hashes) of every distinct piece of a
    document: in a run of one word each window is the same piece. A text whose
    words do not have the key belongs to another row of the same doc_id."""
    names = ["gram", "piece_key", "doc_id", "words_key", "starts", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in text_batches(batches):
            rows = []
            for doc_id, text, own, wanted in zip(
                    batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")).to_pylist(),
                    batch.column("words_key").to_pylist(), batch.column("grams").to_pylist()):
                raw = text.split()
                if words_key(raw) != own:
                    continue
                rows += [(gram, key, doc_id, own, starts, held)
                         for gram, key, starts, held in cut_pieces(hashes.array(raw), wanted=wanted)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()))], names)

    return docs.mapInArrow(
        run, "gram long, piece_key binary, doc_id long, words_key binary, starts array<bigint>, words binary")


class SuffixAutomaton:
    """Automaton of several word strings; each state knows the smallest owner
    of the places where its strings end."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [1 << 63]

    def _state(self, edges: dict, link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(1 << 63)
        return len(self.link) - 1

    def _split(self, p: int, c: int) -> int:
        """State for the strings of p followed by c, cut off longer ones."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int], owner: int) -> None:
        last = 0
        for c in words:
            if c in self.next[last]:
                last = self._split(last, c)
            else:
                new = self._state({}, 0, self.length[last] + 1)
                p = last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, c)
                last = new
            if owner < self.owner[last]:
                self.owner[last] = owner

    def close(self) -> None:
        """Pass each state's owner on to its suffixes."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[v]
            if self.owner[v] < self.owner[up]:
                self.owner[up] = self.owner[v]

    def repeated(self, words: list[int], owner: int, window: int = WINDOW) -> list[int]:
        """Ends (exclusive) of the windows that end in a smaller owner."""
        nxt, link, length, out = self.next, self.link, self.length, []
        v = matched = 0
        for i, c in enumerate(words, 1):
            while v and c not in nxt[v]:
                v = link[v]
                matched = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                matched += 1
            if matched >= window:
                while length[link[v]] >= window:
                    v = link[v]
                    matched = length[v]
                if self.owner[v] < owner:
                    out.append(i)
        return out


def united(ends: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal spans of the windows with the ascending ``ends``."""
    spans: list[tuple[int, int]] = []
    for e in ends:
        if spans and e - window <= spans[-1][1]:
            spans[-1] = (spans[-1][0], e)
        else:
            spans.append((e - window, e))
    return spans


def shard_spans(group: list[tuple[int, bytes, int, list[int]]]):
    """(gram, piece_key, spans) for pieces (gram, key, owner, words) of one
    shard, whose owner may still repeat a smaller document."""
    automaton = SuffixAutomaton()
    for _, _, owner, words in group:
        automaton.add(words, owner)
    automaton.close()
    for gram, key, owner, words in group:
        ends = automaton.repeated(words, owner)
        if ends:
            yield gram, key, [{"from": s, "to": e} for s, e in united(ends)]


_SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def dealt_spans(distinct: DataFrame) -> DataFrame:
    """gram, piece_key, spans of the pieces that repeat, in their own smallest
    document, a passage of a still smaller one. No gram has more words than a
    shard."""
    bound = SHARD_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, gram, size = [], [], 0
        rows: list[tuple] = []

        def close_gram():
            nonlocal shard, gram, size, rows
            if len(gram) > 1:  # a gram with one piece repeats nothing smaller
                n = sum(len(x[3]) for x in gram)
                if size + n > bound:
                    rows += shard_spans(shard)
                    shard, size = [], 0
                shard += gram
                size += n
            gram = []

        for batch in batches:
            for g, key, owner, words in zip(*(batch.column(c).to_pylist() for c in ("gram", "piece_key", "owner", "words"))):
                if gram and g != gram[0][0]:
                    close_gram()
                gram.append((g, key, owner, np.frombuffer(words, np.uint64).tolist()))
            if rows:
                yield _span_batch(rows)
                rows = []
        close_gram()
        rows += shard_spans(shard)
        yield _span_batch(rows)

    dealt = distinct.select("gram", "piece_key", "owner", "words").repartition("gram") \
        .sortWithinPartitions("gram", "owner", "piece_key")
    return dealt.mapInArrow(run, "gram long, piece_key binary, spans array<struct<from:bigint,to:bigint>>")


def distinct_pieces(cut: DataFrame, owner: str) -> DataFrame:
    """gram, piece_key, owner (the smallest), words, length of all pieces."""
    return cut.groupBy("gram", "piece_key").agg(F.min(owner).alias("owner"), F.first("words").alias("words")) \
        .withColumn("length", (F.octet_length("words") / 8).cast("long"))


def finer_pieces(distinct: DataFrame, width: int) -> DataFrame:
    """The pieces of each piece by grams of ``width`` words: of (gram,
    piece_key), they are ``in_gram``, ``in_key``. Windows have no words."""
    names = ["in_gram", "in_key", "in_owner", "gram", "piece_key", "starts", "words", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "words"):
            rows = []
            for g, k, owner, words in zip(*(batch.column(c).to_pylist() for c in ("gram", "piece_key", "owner", "words"))):
                rows += [(g, k, owner, gram, key, starts, held if width < WINDOW else b"", len(held) // 8)
                         for gram, key, starts, held in cut_pieces(np.frombuffer(words, np.uint64), width)]
            for at in range(0, len(rows), 10_000):
                some = rows[at:at + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in some], t) for i, t in enumerate(
                        (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()),
                         pa.binary(), pa.int64()))], names)

    return distinct.select("gram", "piece_key", "owner", "words").mapInArrow(
        run, "in_gram long, in_key binary, in_owner long, gram long, piece_key binary, starts array<bigint>, "
             "words binary, length long")


def moved_spans(placed: DataFrame, owner: str) -> DataFrame:
    """``placed`` (starts, length, spans, owner) with ``spans`` where its
    pieces start; all of a piece that a smaller owner holds. Others go."""
    whole = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("length").alias("to")))
    spans = F.when(F.col(owner) > F.col("owner"), whole).otherwise(F.col("spans"))
    moved = F.flatten(F.transform("starts", lambda at: F.transform("spans", lambda s: F.struct(
        (s["from"] + at).alias("from"), (s["to"] + at).alias("to")))))
    return placed.withColumn("spans", spans).where("spans IS NOT NULL").withColumn("spans", moved)


def piece_spans(distinct: DataFrame, finer: tuple[int, ...] = FINER) -> DataFrame:
    """gram, piece_key, spans (maybe overlapping) of the pieces that repeat, in
    their own smallest document, a passage of a still smaller one."""
    common = to_shared(distinct.groupBy("gram").agg(F.sum("length").alias("n"), F.count("*").alias("k"))
                       .where((F.col("n") > SHARD_WORDS) & (F.col("k") > 1)).select("gram"), "common-grams")
    if common.isEmpty():
        return to_shared(dealt_spans(distinct), "piece-spans")
    dealt = to_shared(dealt_spans(only_ids(distinct, common, "left_anti", "gram")), "piece-spans")

    width, *rest = finer
    cut = to_shared(finer_pieces(only_ids(distinct, common, key="gram"), width), "finer-pieces")
    if width == WINDOW:
        owners = cut.groupBy("gram", "piece_key").agg(F.min("in_owner").alias("owner")) \
            .withColumn("spans", F.lit(None).cast("array<struct<from:bigint,to:bigint>>"))
    else:
        smaller = to_shared(distinct_pieces(cut, "in_owner"), "distinct-pieces")
        owners = smaller.select("gram", "piece_key", "owner").join(
            piece_spans(smaller, tuple(rest)), ["gram", "piece_key"], "left")
    placed = moved_spans(cut.drop("words").join(to_shared(owners, "owners"), ["gram", "piece_key"]), "in_owner")
    found = placed.groupBy("in_gram", "in_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return dealt.unionByName(to_shared(found.select(
        F.col("in_gram").alias("gram"), F.col("in_key").alias("piece_key"), "spans"), "finer-spans"))


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
         pa.array([r[2] for r in rows], _SPANS)], ["gram", "piece_key", "spans"])


def repeated_spans(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """doc_id, words_key, spans (word positions, maybe overlapping) of the
    class firsts (doc_id, words_key, grams) that lose a part."""
    grams = firsts.select("doc_id", "words_key", F.explode("grams").alias("gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    wanted = to_shared(grams.join(shared, "gram").groupBy("doc_id", "words_key").agg(
        F.collect_list("gram").alias("grams")), "shared-grams")
    texts = only_ids(docs.select("doc_id", "text"), wanted.select("doc_id").distinct())
    cut = to_shared(pieces(texts.join(wanted, "doc_id")), "pieces")
    distinct = to_shared(distinct_pieces(cut, "doc_id"), "distinct-pieces")
    owners = distinct.select("gram", "piece_key", "owner").join(piece_spans(distinct), ["gram", "piece_key"], "left")
    placed = moved_spans(cut.select(
        "gram", "piece_key", "doc_id", "words_key", "starts",
        (F.octet_length("words") / 8).cast("long").alias("length")).join(owners, ["gram", "piece_key"]), "doc_id")
    return placed.groupBy("doc_id", "words_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def cut_texts(docs: DataFrame) -> DataFrame:
    """From doc_id, text, words_key, spans: doc_id, n_words, n_removed,
    kept_sha256, kept (remaining words joined by one space)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            rows = []
            for doc_id, text, own, spans in zip(
                    batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")).to_pylist(),
                    batch.column("words_key").to_pylist(), batch.column("spans").to_pylist()):
                words = text.split()
                if words_key(words) != own:
                    continue
                gone = np.zeros(len(words), bool)
                for s in spans:
                    gone[s["from"]:s["to"]] = True
                kept = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])
                rows.append((doc_id, len(words), int(gone.sum()), sha256(kept).hexdigest(), kept.decode()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and
    ``kept``, the remaining text of documents that lose a part; null where all
    or nothing is removed (n_removed tells which)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    told = to_shared(summaries(docs), "word-summaries")
    long_enough = told.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    classes = to_shared(long_enough.groupBy("words_key").agg(F.min(F.struct("doc_id", "grams")).alias("first"))
                        .select("words_key", F.col("first.doc_id").alias("first_id"), F.col("first.grams").alias("grams")),
                        "word-classes")
    spans = to_shared(repeated_spans(docs, classes.select(
        F.col("first_id").alias("doc_id"), "words_key", "grams")), "spans")
    texts = only_ids(docs, spans.select("doc_id").distinct())
    partly = to_shared(cut_texts(texts.join(spans, "doc_id")), "cut-texts")

    whole = told.drop("grams").join(spans.select("doc_id", "words_key"), ["doc_id", "words_key"], "left_anti") \
        .join(classes.drop("grams"), "words_key", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return whole.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("digest")).alias("kept_sha256"),
        F.lit(None).cast("string").alias("kept")).unionByName(partly)
