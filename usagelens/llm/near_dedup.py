"""Near-duplicate documents by fast similarity sketching (operator 5).

A document's set holds the 64-bit hashes of its distinct five-word shingles.
Sketches have ``SIZE`` coordinates. In round i every element of a set is
hashed to a bin and a value; a bin keeps the smallest (round, value). The
first ``SIZE`` rounds pick bins at random, the next ``SIZE`` rounds visit one
bin each, so every coordinate fills, and a set is done as soon as all of its
bins are filled. Two sets agree in a coordinate with probability equal to
their similarity J, and the agreement is concentrated as for independent
samples, so ``BANDS`` bands of ``ROWS`` coordinates miss a pair with
probability (1 - J^ROWS)^BANDS: 5e-6 at J = 0.75. One byte of each coordinate
(the print) tells candidates apart: fewer than ``LEAST_AGREEING`` bytes of the
first half or of all agree with probability 5e-7 at J = 0.75, a tenth of what the
bands miss, and mostly at J = 0.62.

Linking:
1. Documents with equal sets form a class; only its smallest doc_id goes on.
2. Members of a band bucket are candidates. Every class is first compared
   with the most central of its buckets' members: the one whose own buckets
   hold most members in all. An original is alike to all of its near copies
   and so more central than a copy, which may be alike to the original only;
   one comparison each joins large groups.
3. Buckets that still hold several components are compared exhaustively, but
   never all at once: every member has a random place in its bucket, and round
   by round the members up to place 64, 8192, ... become centres and meet
   the members behind them that are in other components, until no bucket has a
   pair left that is not compared or in one component. A pair leaves that join
   only in the first band that both share, if the sizes of the sets allow the
   similarity and the prints agree. No bucket, partner or candidate is capped.
4. Every candidate pair is confirmed on the full sets, in integers.

Edge cases: null and empty texts and texts without words have no shingles and
are linked with nothing; a text of fewer than five words is one shingle; rows
that share a doc_id are judged by their own text each, and classes whose
smallest doc_id is the same are one; a null doc_id is never linked (component
null, kept); an empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import U64, WordHashes, mix64, text_batches, text_bytes, to_shared
from .components import connected_components

SHINGLE = 5
SIZE, BANDS, ROWS = 512, 32, 4
LEAST_AGREEING = (155, 335)
MIN_PERCENT = 75
CENTRES, MORE_CENTRES = 64, 128  # of a bucket in the first round, and times as many in each further one
MAX_BROADCAST_IDS = 2_000_000  # 16 MB of ids

_WEIGHTS = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | U64(1)
_ROUNDS = mix64(np.arange(1000, 1000 + 2 * SIZE, dtype=np.uint64))
_ROW_WEIGHTS = mix64(np.arange(2000, 2000 + ROWS, dtype=np.uint64)) | U64(1)
_BAND_SEEDS = mix64(np.arange(3000, 3000 + BANDS, dtype=np.uint64))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes."""
    n = len(words)
    if n == 0:
        return words
    if n < SHINGLE:
        return mix64((words * _WEIGHTS[:n]).sum(dtype=np.uint64, keepdims=True) + U64(n))
    h = words[:n - SHINGLE + 1] * _WEIGHTS[0]
    for k in range(1, SHINGLE):
        h = h + words[k:n - SHINGLE + 1 + k] * _WEIGHTS[k]
    return np.unique(mix64(h))


def shingle_sets(texts: list[bytes], hashes: WordHashes) -> list[np.ndarray]:
    """bytes.lower and bytes.split know A-Z and the six separators only."""
    return [shingle_set(hashes.array(t.lower().split())) for t in texts]


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``SIZE`` coordinates per (non-empty) set."""
    sizes = np.array([len(s) for s in sets])
    out = np.full((len(sets), SIZE), np.iinfo(np.uint64).max, np.uint64)
    flat, empty = out.reshape(-1), np.iinfo(np.uint64).max
    doc = np.repeat(np.arange(len(sets)), sizes)
    items = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    value_bits = U64((1 << 54) - 1)  # the rounds need the 10 bits above
    for i in range(2 * SIZE):
        if not len(items):
            break
        x = mix64(items ^ _ROUNDS[i])
        bins = (x >> U64(55)).astype(np.int64) if i < SIZE else i - SIZE
        np.minimum.at(flat, doc * SIZE + bins, (U64(i) << U64(54)) | (x & value_bits))
        live = (out == empty).any(1)[doc]
        if not live.all():
            doc, items = doc[live], items[live]
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit key per band; equal keys make candidates, never links."""
    rows = mix64(sketches[:, :BANDS * ROWS]).reshape(len(sketches), BANDS, ROWS)
    return mix64((rows * _ROW_WEIGHTS).sum(2, dtype=np.uint64) + _BAND_SEEDS)


def prints(sketches: np.ndarray) -> np.ndarray:
    """A byte of each coordinate, eight to a 64-bit integer."""
    return (mix64(sketches ^ U64(99)) & U64(0xFF)).astype(np.uint8).view(np.int64)


def alike(a: Column, b: Column) -> Column:
    """Whether enough bytes of two prints agree; the second half is looked at
    only if the first agrees."""
    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for shift in (4, 2, 1):  # the bits of each byte, folded into its lowest
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        return F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))

    def agreeing(n: int) -> Column:
        pairs = F.zip_with(F.slice(a, 1, n // 8), F.slice(b, 1, n // 8), differing)
        return n - F.aggregate(pairs, F.lit(0), lambda total, d: total + d)

    return (agreeing(SIZE // 2) >= LEAST_AGREEING[0]) & (agreeing(SIZE) >= LEAST_AGREEING[1])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (null without shingles), bands and prints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in text_batches(batches):
            sets = shingle_sets(text_bytes(batch.column("text")).to_pylist(), hashes)
            full = [s for s in sets if len(s)]
            sketches = sketch(full)
            keys, bytes_ = iter(band_keys(sketches).view(np.int64)), iter(prints(sketches))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                 pa.array([next(bytes_) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "bands", "prints"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_key binary, bands array<bigint>, prints array<bigint>")


def only_ids(df: DataFrame, ids: DataFrame, how: str = "left_semi", key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose ``key`` is (not) in ``ids``; the ids are broadcast
    only if they were counted to be few, else both sides are shuffled."""
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, how)


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, items: sorted shingle hashes of the documents in ``nodes``. If
    rows share a doc_id, their sets are one row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in text_batches(batches):
            sets = shingle_sets(text_bytes(batch.column("text")).to_pylist(), hashes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "items"])

    texts = only_ids(docs.select(F.col("doc_id").cast("long"), "text"), nodes.select(F.col("node").alias("doc_id")))
    return texts.mapInArrow(run, "node long, items binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                both = 0
                if len(p) and 100 * len(p) >= MIN_PERCENT * len(q):
                    both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                keep.append(both > 0 and 100 * both >= MIN_PERCENT * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    signed = to_shared(signatures(docs), "signatures")
    linked = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = to_shared(linked.groupBy("set_key").agg(F.min(F.struct("doc_id", "bands", "prints", "n_shingles")).alias("first"))
                        .select("set_key", F.col("first.doc_id").alias("node"), "first.bands", "first.prints",
                                F.col("first.n_shingles").alias("size")), "classes")
    members = classes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    draw = F.xxhash64("key", "node").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    buckets = members.join(shared, "key").join(classes.select("node", "bands", "prints", "size"), "node")
    buckets = to_shared(buckets.withColumn("place", draw * F.col("n")).withColumnRenamed("n", "met"), "buckets")
    sets = to_shared(full_sets(docs, buckets.select("node").distinct()), "full-sets")

    # every class against the most central member of its buckets
    tested = to_shared(_central_pairs(buckets.select("key", "node", "met")), "pairs")
    links = to_shared(confirmed(tested, sets), "links")
    component = to_shared(connected_components(links), "components")
    buckets, met, centres = buckets.drop("met"), 0, CENTRES
    while True:
        left = to_shared(_open_members(buckets.where(F.col("place") >= met), component), "open-buckets")
        if left.isEmpty():
            break
        pairs = to_shared(_next_pairs(left, centres).join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
        links = to_shared(confirmed(pairs, sets), "links")
        if not links.isEmpty():  # new links join the components found so far
            known = component.select(F.col("node").alias("a"), F.col("component").alias("b"))
            component = to_shared(connected_components(links.unionByName(known)), "components")
        # buckets go on without the centres that have met all of their members
        buckets, met, centres = left.drop("component"), centres, centres * MORE_CENTRES

    return _per_document(signed, classes, component)


def _central_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs a > b: each node and the most central member (of the largest sum
    of ``met``, the members of a bucket; the smaller node of equal ones) of its
    buckets, unless it is that member itself."""
    weight = buckets.groupBy("node").agg(F.sum("met").alias("weight"))
    placed = buckets.join(weight, "node").select("key", "node", F.struct("weight", (-F.col("node")).alias("less")).alias("x"))
    centre = placed.groupBy("key").agg(F.max("x").alias("c"))
    best = placed.join(centre, "key").groupBy("node").agg((-F.max("c")["less"]).alias("c")).where("node <> c")
    return best.select(F.greatest("node", "c").alias("a"), F.least("node", "c").alias("b")).distinct()


def _open_members(buckets: DataFrame, component: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components."""
    placed = buckets.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")) \
        .where("low < high").select("key")
    return placed.join(several, "key")


def _next_pairs(members: DataFrame, centres: int) -> DataFrame:
    """The centres of each bucket (its members up to a place) with its members
    of other components, as distinct pairs a > b: in the first band that both
    share (a pair that meets in a later one is left to the bucket of its first),
    if sizes and prints allow the similarity."""
    centre = members.where(F.col("place") < centres).select(
        "key", *[F.col(c).alias("c_" + c) for c in ("node", "component", "bands", "prints", "size", "place")])
    earlier = F.zip_with(F.slice("bands", F.lit(1), F.col("band")), F.slice("c_bands", F.lit(1), F.col("band")),
                         lambda x, y: x == y)
    fits = 100 * F.least("size", "c_size") >= MIN_PERCENT * F.greatest("size", "c_size")
    return members.join(centre, "key").where("component <> c_component AND struct(place, node) > struct(c_place, c_node)").where(fits) \
        .where(~F.exists(earlier, lambda same: same)).where(alike(F.col("prints"), F.col("c_prints"))) \
        .select(F.greatest("node", "c_node").alias("a"), F.least("node", "c_node").alias("b")).distinct()


def _per_document(signed: DataFrame, classes: DataFrame, component: DataFrame) -> DataFrame:
    names = classes.select("set_key", "node").join(component, "node", "left").select(
        "set_key", F.coalesce("component", "node").alias("component"))
    out = signed.drop("bands", "prints").join(names, "set_key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"),
                      F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
