"""Exact top-k search by inner product with MaxScore (operator 11).

Components are quantised to ``floor(256 * x)``. A query's terms are its
dimensions; the posting list of a dimension holds the rows with a value other
than zero and the largest positive and negative value, so |q| times the
largest value of q's sign bounds what the term can add to any score.

The index is a table of shards of at most ``SHARD_CELLS`` components. A task
keeps the best ``k`` rows of each query over its shards; the k-th is the score
to beat. For a shard, terms are ordered by bound. The non-essential ones are
the longest tail whose bounds add up to less than that score: a row that gets
nothing positive from an essential term cannot be a result. Essential posting
lists are traversed; the rows found are probed in the other terms, largest
bound first, while their score plus the bounds left can still compete. Rows
that tie with the score to beat stay in. The tasks' results are merged by
(score descending, id ascending).

Queries are a stated part of the rows. They are broadcast in blocks of
about ``BLOCK_CELLS`` components, so a broadcast does not grow with the table;
each block is one pass over the index.

Edge cases: vectors that are null or hold null or non-finite components take
no part; missing components of shorter vectors count as zero, so an empty
vector scores zero with all; rows are told apart by their place in the index,
so rows that share an id are different rows (each a query of its own) and only
the query's own row is left out; a null id is no query and comes last among
ties; scores are computed exactly for components of any size, limited to the
range of a long and ranked so; an empty table gives an empty result; only the id and
the vector column are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import to_shared

SCALE = 256
SHARD_CELLS = 1 << 17  # columns of a shard fit a processor's cache, and early shards raise the score to beat
BLOCK_CELLS = 1 << 20
INDEX = "shard long, ids array<bigint>, dims binary, ends binary, rows binary, components binary"
_LONG = (-(1 << 63), (1 << 63) - 1)


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as 64-bit integers, or as Python's if they are larger."""
    if not len(x) or np.abs(x).max() < 2.0 ** 50:
        return np.floor(SCALE * x).astype(np.int64)
    return np.array([SCALE * int(v) if abs(v) >= 2.0 ** 53 else math.floor(SCALE * v) for v in x.tolist()] + [None],
                    object)[:-1]


def build_index(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The stored index, a shard per row: ids by row and, by dimension
    (``dims``), where its posting list ends, rows and raw components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lists, ids = batch.column("vector"), batch.column("id")
            offsets, flat = lists.offsets.to_numpy(), lists.values
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes nan
            sizes = np.diff(offsets)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            whole = np.flatnonzero(~lists.is_null().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]]))
            ends = np.cumsum(sizes[whole] + 1)
            start = 0
            while start < len(whole):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + SHARD_CELLS, "right")))
                yield _shard(number, ids.take(pa.array(whole[start:stop])),
                             [x[offsets[i]:offsets[i + 1]] for i in whole[start:stop].tolist()])
                start, number = stop, number + 1

    return to_shared(vectors.select(F.col(id_column).cast("long").alias("id"),
                                    F.col(vector_column).cast("array<double>").alias("vector")).mapInArrow(run, INDEX),
                     "topk-index")


def _shard(number: int, ids: pa.Array, vectors: list[np.ndarray]) -> pa.RecordBatch:
    sizes = [len(v) for v in vectors]
    rows = np.repeat(np.arange(len(vectors), dtype=np.int32), sizes)
    dims = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
    x = np.concatenate(vectors)
    kept = (x < 0) | (x >= 1 / SCALE)  # others are quantised to zero
    order = np.flatnonzero(kept)[np.argsort(dims[kept], kind="stable")]
    named, counts = np.unique(dims[order], return_counts=True)
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64()))] +
        [pa.array([a.tobytes()], pa.binary()) for a in (named, np.cumsum(counts), rows[order], x[order])],
        ["shard", "ids", "dims", "ends", "rows", "components"])


class Shard:
    """Posting lists of one index row."""

    def __init__(self, number: int, ids: list, dims: bytes, ends: bytes, rows: bytes, components: bytes):
        self.number, self.ids = number, ids
        ends_, rows_ = np.frombuffer(ends, np.int64).tolist(), np.frombuffer(rows, np.int32)
        values = quantised(np.frombuffer(components, np.float64))
        self.lists = {}
        for dim, a, b in zip(np.frombuffer(dims, np.int32).tolist(), [0, *ends_], ends_):
            v, at = values[a:b], rows_[a:b]
            high, low = max(int(v.max()), 0), min(int(v.min()), 0)
            if 2 * len(v) > len(ids):  # a list of most rows: a value for every row, no row numbers
                full = np.zeros(len(ids), values.dtype)
                full[at] = v
                v, at = full, None
            self.lists[dim] = (at, v, high, low)
        self._gains: dict[tuple[int, bool], np.ndarray] = {}

    def gains(self, dim: int, positive: bool) -> np.ndarray:
        """Rows (a mask, or their numbers) that a query value of this sign
        gains from."""
        if (dim, positive) not in self._gains:
            rows, values, _, _ = self.lists[dim]
            mask = values > 0 if positive else values < 0
            self._gains[dim, positive] = mask if rows is None else rows[mask]
        return self._gains[dim, positive]

    def vector(self, row: int) -> dict[int, int]:
        out = {}
        for dim in self.lists:
            value = int(self._probe(dim, np.array([row]))[0])
            if value:
                out[dim] = value
        return out

    def search(self, query: dict[int, int], to_beat: int | None, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may reach ``to_beat`` (all, if None), and their scores."""
        terms, wide = [], 0
        for dim, q in query.items():
            if dim in self.lists:
                _, _, high, low = self.lists[dim]
                gain, loss = (q * high, q * low) if q > 0 else (q * low, q * high)
                terms.append((gain, dim, q))
                wide += max(gain, -loss)
        terms.sort(reverse=True)
        left = [0] * (len(terms) + 1)  # bounds of the terms from i on
        for i in range(len(terms) - 1, -1, -1):
            left[i] = left[i + 1] + terms[i][0]
        kind = np.int64 if wide < 1 << 62 else object
        essential, able = len(terms), to_beat is not None and to_beat > 0
        if able:
            essential = next(i for i, x in enumerate(left) if x < to_beat)
        score = np.zeros(len(self.ids), kind)
        found = np.full(len(self.ids), not able)
        for _, dim, q in terms[:essential]:
            rows, values, _, _ = self.lists[dim]
            part = values.astype(kind, copy=False) * q
            if rows is None:
                score += part
                if able:
                    found |= self.gains(dim, q > 0)
            else:
                score[rows] += part
                found[self.gains(dim, q > 0)] = True
        if own is not None:
            found[own] = False
        if to_beat is not None:
            found &= score + left[essential] >= to_beat
        at = np.flatnonzero(found)
        score = score[at]
        for i, (_, dim, q) in enumerate(terms[essential:], essential + 1):
            if not len(at):
                break
            score = score + self._probe(dim, at).astype(kind, copy=False) * q
            able = score + left[i] >= to_beat
            if not able.all():
                at, score = at[able], score[able]
        return at, score

    def _probe(self, dim: int, at: np.ndarray) -> np.ndarray:
        rows, values, _, _ = self.lists[dim]
        if rows is None:
            return values[at]
        place = np.minimum(np.searchsorted(rows, at), len(rows) - 1)
        return np.where(rows[place] == at, values[place], 0)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Shard(*[batch.column(c)[i].as_py() for c in ("shard", "ids", "dims", "ends", "rows", "components")])


def _rank(score: int, id_: int | None, shard: int, row: int) -> tuple:
    """Larger is better."""
    return min(max(score, _LONG[0]), _LONG[1]), id_ is not None, -(id_ or 0), -shard, -row


def query_rows(index: DataFrame, every: int) -> DataFrame:
    """The rows of the index whose id is divisible by ``every``: shard, row,
    id, dims and values (quantised, as text: they may be of any size)."""
    names = ["shard", "row", "id", "dims", "values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            picked = [(r, i) for r, i in enumerate(shard.ids) if i is not None and i % every == 0]
            for k in range(0, len(picked), 1024):
                some = picked[k:k + 1024]
                vectors = [shard.vector(r) for r, _ in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.number] * len(some), pa.int64()), pa.array([r for r, _ in some], pa.int32()),
                     pa.array([i for _, i in some], pa.int64()), pa.array([list(v) for v in vectors], pa.list_(pa.int32())),
                     pa.array([[str(x) for x in v.values()] for v in vectors], pa.list_(pa.string()))], names)

    return to_shared(index.mapInArrow(run, "shard long, row int, id long, dims array<int>, values array<string>"),
                     "topk-queries")


def search_block(index: DataFrame, queries: list, k: int) -> DataFrame:
    """Best ``k`` rows per query and task, for one block of queries."""
    sent = index.sparkSession.sparkContext.broadcast(
        [(q.shard, q.row, q.id, {d: int(v) for d, v in zip(q.dims, q["values"])}) for q in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        best: list[list[tuple]] = [[] for _ in block]  # heaps, the worst first
        for shard in _shards(batches):
            for heap, (q_shard, q_row, _, query) in zip(best, block):
                rows, scores = shard.search(query, heap[0][0] if len(heap) == k else None,
                                            q_row if q_shard == shard.number else None)
                if len(rows) > 4 * k and scores.dtype != object:  # all that reach the k-th score
                    able = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    rows, scores = rows[able], scores[able]
                for row, score in zip(rows.tolist(), scores.tolist()):
                    x = _rank(score, shard.ids[row], shard.number, row)
                    if len(heap) < k:
                        heapq.heappush(heap, x)
                    elif x > heap[0]:
                        heapq.heapreplace(heap, x)
        for at in range(0, len(block), 1024):
            out = [(s, r, i, -x[2] if x[1] else None, x[0], -x[3], -x[4])
                   for heap, (s, r, i, _) in zip(best[at:at + 1024], block[at:at + 1024]) for x in heap]
            columns = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32()] + [pa.int64()] * 4 + [pa.int32()])],
                ["q_shard", "q_row", "query_id", "vec_id", "score", "shard", "row"])

    found = to_shared(index.mapInArrow(run, "q_shard long, q_row int, query_id long, vec_id long, score long, "
                                            "shard long, row int"), "topk-found")
    sent.unpersist()
    return found


def top_k(vectors: DataFrame, every: int, k: int, id_column: str = "vec_id",
          vector_column: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every`` its ``k`` best other
    rows: query_id, rank, vec_id, score."""
    index = build_index(vectors, id_column, vector_column)
    queries = query_rows(index, every)
    cells = queries.agg(F.sum(F.size("dims") + 1)).first()[0] or 0
    n_blocks = -(-cells // BLOCK_CELLS)
    block: Column = F.pmod(F.xxhash64("shard", "row"), F.lit(max(1, n_blocks)))
    found = index.sparkSession.createDataFrame([], "q_shard long, q_row int, query_id long, vec_id long, score long, "
                                                   "shard long, row int")
    for b in range(n_blocks):
        found = found.unionByName(search_block(index, queries.where(block == b).collect(), k))
    best = Window.partitionBy("q_shard", "q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "shard", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
