"""Phrase collocations by vertical partitioning of word suffixes (operator 13).

Every word occurrence starts a suffix: its words up to the end of its piece,
cut at ``depth`` words. Counts of phrases are totals of leaves in the tree of
all suffixes, which is never built as a whole:

1. Prefixes of one word are counted. A prefix with more than ``budget``
   occurrences is extended by one word and counted again; prefixes of
   ``depth`` words are not extended, as each is a single leaf.
2. Prefixes are grouped by memory budget: they are hashed to cells, and
   neighbouring cells are put together while their occurrences fit
   ``budget``. Only the cells' totals (a few numbers per group) and the
   extended prefixes (at most total / budget of each length) reach the driver.
3. A pass over the texts deals the suffixes to their groups. A task adds up
   equal suffixes first and sends one row per (language, group): the words used
   and the leaves as integers.
4. Each group builds its subtrees on its own: leaves sorted by word, equal
   ones added up, a node's count is the total of the leaves below it. Nodes
   that reach ``least`` leave.

Scores and the test for containment in longer phrases are joins of the
nodes that are left, in exact decimal arithmetic (counts below 10^14).

Edge cases: a null text is empty, a null language is ``und``; pieces without
words give nothing; repeated rows count each; ties are ordered by count, then
by phrase; an empty table gives an empty result; texts of any length are read
whole, one at a time; only text and lang are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import text_batches, text_bytes, to_shared

DEPTH = 3
LEAST = 10
KEPT_PERCENT = 50
TOP = 2000
SCALE = 1_000_000
BUDGET = 2_000_000  # suffixes of a group
HELD_WORDS = 1 << 21  # words that a task holds before it sends them on
NO_LANGUAGE = "und"

# A-Z to lower case, piece ends ``[.,;:!?\x0A-\x0D]`` to a full stop
_FOLD = bytes.maketrans(bytes(range(0x41, 0x5B)) + b",;:!?\n\x0b\x0c\r", bytes(range(0x61, 0x7B)) + b"." * 9)


def tokens(text: bytes) -> list[bytes]:
    """Words in order, with ``.`` (never part of a word) at piece ends."""
    return text.translate(_FOLD).replace(b".", b" . ").split()


class _Vocabulary(dict):
    """Ids of words in the order they come; 0 is ``.``."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(language, vocabulary, ids): a language's words of a bounded number
    of whole texts. Id 0 stands for piece and text ends."""
    vocabularies: dict[str, _Vocabulary] = defaultdict(_Vocabulary)
    ids: dict[str, list[np.ndarray]] = defaultdict(list)
    size = 0

    def out() -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        for lang, parts in ids.items():
            yield lang, list(vocabularies[lang]), np.concatenate([*parts, np.zeros(DEPTH, np.int64)])

    for batch in text_batches(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text"))):
            words = tokens(text.as_py())
            words.append(b".")
            if size + len(words) > HELD_WORDS:
                yield from out()
                vocabularies.clear()
                ids.clear()
                size = 0
            ids[lang].append(np.fromiter(map(vocabularies[lang].__getitem__, words), np.int64, len(words)))
            size += len(words)
    yield from out()


def _suffixes(ids: np.ndarray, depth: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes (a row of ``depth`` ids each, 0 after the piece's
    end), ascending, and their counts."""
    n = len(ids) - DEPTH
    columns = [ids[:n]]
    for k in range(1, depth):
        columns.append(np.where(columns[-1] > 0, ids[k:n + k], 0))
    inside = columns[0] > 0
    if n_words ** depth < 1 << 63:  # as one integer each
        code = columns[0][inside]
        for c in columns[1:]:
            code = code * n_words + c[inside]
        code, counts = np.unique(code, return_counts=True)
        out = np.empty((len(code), depth), np.int64)
        for k in range(depth - 1, -1, -1):
            code, out[:, k] = np.divmod(code, n_words)
        return out, counts
    return _added([c[inside] for c in columns], np.ones(int(inside.sum()), np.int64), n_words)


def _added(columns: list[np.ndarray], counts: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of ids and add up the counts of equal ones."""
    if n_words ** len(columns) < 1 << 63:
        code = columns[0]
        for c in columns[1:]:
            code = code * n_words + c
        order = np.argsort(code)
    else:
        order = np.lexsort(columns[::-1])
    rows, counts = np.stack(columns, 1)[order], counts[order]
    first = _starts(rows)
    return rows[first], np.add.reduceat(counts, first) if len(first) else counts


def _starts(rows: np.ndarray) -> np.ndarray:
    """First row of each run of equal rows."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    return np.flatnonzero(new)


def prefix_hash(lang: str, words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join([lang.encode(), *words]))


def count_prefixes(texts: DataFrame, extended: set | None = None) -> DataFrame:
    """lang, words (binary, spaces between them), f. Without ``extended``:
    all words. With it: the prefixes of one more word of those in it, a set of
    (lang, words) all of one length; suffixes that end earlier are left out."""
    depth = 1 if extended is None else 1 + len(next(iter(extended))[1].split())
    sent = texts.sparkSession.sparkContext.broadcast(extended)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for lang, vocabulary, ids in _held(batches):
            if wanted is not None:
                first = {w.split()[0] for x, w in wanted if x == lang}
                if first.isdisjoint(vocabulary):
                    continue
            rows, counts = _suffixes(ids, depth, len(vocabulary))
            if wanted is not None:
                whole = np.flatnonzero(np.isin(rows[:, 0], [i for i, w in enumerate(vocabulary) if w in first]) &
                                       (rows[:, -1] > 0))
                rows, counts = rows[whole], counts[whole]
            names = [b" ".join([vocabulary[i] for i in r]) for r in rows.tolist()]
            if wanted is not None and depth > 2:
                kept = [i for i, x in enumerate(names) if (lang, x.rpartition(b" ")[0]) in wanted]
                names, counts = [names[i] for i in kept], counts[kept]
            for k in range(0, len(names), 100_000):
                some = names[k:k + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some)), pa.array(some, pa.binary()), pa.array(counts[k:k + 100_000])],
                    ["lang", "words", "f"])

    counted = texts.mapInArrow(run, "lang string, words binary, f long").groupBy("lang", "words").agg(F.sum("f").alias("f"))
    counted = to_shared(counted, "phrase-prefixes")
    sent.unpersist()
    return counted


def oversized(prefixes: DataFrame, budget: int) -> set[tuple[str, bytes]]:
    """Prefixes to extend; at most total / budget of them."""
    return {(r.lang, bytes(r.words)) for r in prefixes.where(F.col("f") > budget).collect()}


def cell_totals(prefixes: DataFrame, n_cells: int) -> dict[int, int]:
    """Occurrences of the prefixes hashed to each cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [prefix_hash(x, [w]) * n_cells >> 64 for x, w in
                     zip(batch.column("lang").to_pylist(), batch.column("words").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), batch.column("f")], ["cell", "f"])

    rows = prefixes.mapInArrow(run, "cell long, f long").groupBy("cell").agg(F.sum("f").alias("f")).collect()
    return {r.cell: r.f for r in rows}


def group_starts(totals: dict[int, int], n_cells: int, budget: int) -> list[int]:
    """First cell of each group of neighbouring cells."""
    starts, size = [0], 0
    for cell in range(n_cells):
        if size and size + totals.get(cell, 0) > budget:
            starts.append(cell)
            size = 0
        size += totals.get(cell, 0)
    return starts


def deal_suffixes(texts: DataFrame, starts: list[int], n_cells: int, extended: list[set]) -> DataFrame:
    """lang, group, words, leaves: suffixes of ``DEPTH`` words with counts, as
    columns of unsigned 32-bit places in ``words`` (0: none) and a count."""
    sent = texts.sparkSession.sparkContext.broadcast(extended)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(words: list[bytes]) -> int:
            return prefix_hash(lang, words) * n_cells >> 64

        longer = sent.value
        for lang, vocabulary, ids in _held(batches):
            rows, counts = _suffixes(ids, DEPTH, len(vocabulary))
            of_word = np.array([-1 if (lang, w) in longer[0] else group([w]) for w in vocabulary], np.int64)
            cells = of_word[rows[:, 0]]
            open_ = np.flatnonzero(cells < 0)  # prefixes of more words
            for depth in range(2, DEPTH + 1):
                some = rows[open_, :depth]
                first = _starts(some)
                names = [[vocabulary[i] for i in r if i] for r in some[first].tolist()]
                found = [-1 if depth < DEPTH and len(x) == depth and (lang, b" ".join(x)) in longer[depth - 1] else group(x)
                         for x in names]
                cells[open_] = np.repeat(np.array(found, np.int64), np.diff(np.append(first, len(some))))
                open_ = open_[cells[open_] < 0]
            groups = np.searchsorted(starts, cells, "right") - 1
            order = np.argsort(groups, kind="stable")
            names_ = pa.array(vocabulary, pa.binary())
            ends = np.flatnonzero(np.diff(groups[order], append=-1)) + 1
            for a, b in zip([0, *ends.tolist()], ends.tolist()):
                leaves = rows[order[a:b]]
                used, places = np.unique(np.append(leaves.reshape(-1), 0), return_inverse=True)
                packed = np.vstack([places[:-1].reshape(leaves.shape).T, counts[order[a:b]]]).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([int(groups[order[a]])], pa.int32()),
                     pa.ListArray.from_arrays(pa.array([0, len(used) - 1], pa.int32()), names_.take(pa.array(used[1:]))),
                     pa.array([packed.tobytes()], pa.binary())], ["lang", "group", "words", "leaves"])

    return texts.mapInArrow(run, "lang string, group int, words array<binary>, leaves binary")


def subtree_counts(dealt: DataFrame, least: int, extended: list[set]) -> DataFrame:
    """lang, words (2 to ``DEPTH``), f of the nodes that reach ``least``, each
    group's subtrees on their own. Nodes above an extended prefix, whose
    leaves lie in several groups, are left out."""
    sent = dealt.sparkSession.sparkContext.broadcast(extended)

    def build(table: pa.Table) -> pa.Table:
        longer, out = sent.value, []
        languages = np.array(table.column("lang").to_pylist(), object)
        for lang in sorted(set(languages)):
            rows = table.filter(pa.array(languages == lang))
            lists = rows.column("words").combine_chunks()
            encoded = lists.flatten().dictionary_encode()
            ids, vocabulary = encoded.indices.to_numpy().astype(np.int64) + 1, encoded.dictionary
            ends = np.cumsum(pc.list_value_length(lists).to_numpy())
            parts = []
            for leaves, start, end in zip(rows.column("leaves"), [0, *ends.tolist()], ends.tolist()):
                packed = np.frombuffer(leaves.as_buffer(), "<u4").reshape(DEPTH + 1, -1)
                local = np.concatenate([[0], ids[start:end]])
                parts.append(np.vstack([local[packed[:DEPTH]], packed[DEPTH:]]))
            parts = np.concatenate(parts, 1)
            leaves, counts = _added(list(parts[:DEPTH]), parts[DEPTH], len(vocabulary) + 1)
            for depth in range(2, DEPTH + 1):
                first = _starts(leaves[:, :depth])
                total = np.add.reduceat(counts, first)
                kept = (total >= least) & (leaves[first, depth - 1] > 0)
                nodes, total = leaves[first[kept], :depth], total[kept]
                words = vocabulary.take(pa.array(nodes.reshape(-1) - 1))
                if depth < DEPTH and longer[depth - 1]:
                    texts = words.to_pylist()
                    whole = np.array([(lang, b" ".join(texts[depth * k:depth * k + depth])) not in longer[depth - 1]
                                      for k in range(len(nodes))], bool)
                    words, total = words.filter(pa.array(np.repeat(whole, depth))), total[whole]
                n = len(total)
                out.append(pa.table([pa.array([lang] * n, pa.string()), pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1) * depth, pa.int32()), words), pa.array(total, pa.int64())], ["lang", "words", "f"]))
        return pa.concat_tables(out)

    found = to_shared(dealt.groupBy("group").applyInArrow(build, "lang string, words array<binary>, f long"),
                      "phrase-nodes")
    sent.unpersist()
    return found


def phrase_counts(docs: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): lang, words (binary, spaces between them), f of all
    words, and lang, words (array), f of the phrases of 2 to ``DEPTH`` words
    that occur ``least`` times."""
    texts = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"))
    singles = count_prefixes(texts)
    total = singles.agg(F.sum("f")).first()[0] or 0
    n_cells = 1 << max(6, (8 * total // budget).bit_length())
    extended, prefixes, whole = [oversized(singles, budget)], singles, []
    totals = cell_totals(singles.where(F.col("f") <= budget), n_cells)
    while extended[-1] and len(extended) < DEPTH - 1:
        prefixes = count_prefixes(texts, extended[-1])
        extended.append(oversized(prefixes, budget))
        whole.append(prefixes.where(F.col("f") > budget))
        for cell, f in cell_totals(prefixes.where(F.col("f") <= budget), n_cells).items():
            totals[cell] = totals.get(cell, 0) + f
    spread = sum(f.agg(F.sum("f")).first()[0] or 0 for f in whole[-1:]) // n_cells
    starts = group_starts({c: totals.get(c, 0) + spread for c in range(n_cells)}, n_cells, budget)
    extended += [set()] * (DEPTH - 1 - len(extended))
    phrases = subtree_counts(deal_suffixes(texts, starts, n_cells, extended), least, extended)
    for prefixes in whole:
        phrases = phrases.unionByName(prefixes.where(F.col("f") >= least).select(
            "lang", F.transform(F.split(F.col("words").cast("string"), " "), lambda w: w.cast("binary")).alias("words"), "f"))
    return singles, phrases


def collocations(docs: DataFrame, least: int = LEAST, kept_percent: int = KEPT_PERCENT, top: int = TOP,
                 budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each
    language by their lowest-scoring cut."""
    singles, phrases = phrase_counts(docs, least, budget)
    word = lambda name: singles.where(F.col("f") >= least).select("lang", F.col("words").alias("_" + name), F.col("f").alias(name))
    pairs = phrases.where(F.size("words") == 2).select(
        "lang", F.col("words")[0].alias("_w1"), F.col("words")[1].alias("_w2"), F.col("f").alias("a"))
    triples = phrases.where(F.size("words") == 3).select(
        "lang", *[F.col("words")[i].alias(f"_w{i + 1}") for i in range(3)], F.col("f").alias("a"))
    pair = lambda x, y, name: pairs.select("lang", F.col("_w1").alias(x), F.col("_w2").alias(y), F.col("a").alias(name))
    score = lambda left, right: F.expr(
        f"(CAST({SCALE} AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(14,0)) * CAST(a AS DECIMAL(14,0))))"
        f" DIV (CAST({left} AS DECIMAL(14,0)) * CAST({right} AS DECIMAL(14,0)))")
    longer = triples.select("lang", F.explode(F.array(
        F.struct(F.col("_w1").alias("x"), F.col("_w2").alias("y")),
        F.struct(F.col("_w2").alias("x"), F.col("_w3").alias("y")))).alias("p"), "a") \
        .groupBy("lang", F.col("p.x").alias("_w1"), F.col("p.y").alias("_w2")).agg(F.max("a").alias("longest"))
    two = pairs.join(longer, ["lang", "_w1", "_w2"], "left") \
        .where(F.col("longest").isNull() | (100 * F.col("longest") < kept_percent * F.col("a"))) \
        .join(word("l").withColumnRenamed("_l", "_w1"), ["lang", "_w1"]) \
        .join(word("r").withColumnRenamed("_r", "_w2"), ["lang", "_w2"]) \
        .select("lang", F.concat_ws(" ", F.col("_w1").cast("string"), F.col("_w2").cast("string")).alias("phrase"),
                "a", "l", "r", score("l", "r").alias("score"))
    cuts = triples.join(word("l1").withColumnRenamed("_l1", "_w1"), ["lang", "_w1"]) \
        .join(pair("_w1", "_w2", "l2"), ["lang", "_w1", "_w2"]) \
        .join(pair("_w2", "_w3", "r1"), ["lang", "_w2", "_w3"]) \
        .join(word("r2").withColumnRenamed("_r2", "_w3"), ["lang", "_w3"])
    least_cut = F.least(*[F.struct(score(f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"),
                                   F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)])
    three = cuts.withColumn("cut", least_cut).select(
        "lang", F.concat_ws(" ", *[F.col(f"_w{i}").cast("string") for i in (1, 2, 3)]).alias("phrase"), "a",
        F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    sizes = singles.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
