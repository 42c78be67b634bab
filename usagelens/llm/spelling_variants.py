"""Spelling variants by a trie frontier in relations (operator 12).

Words that differ by one inserted, deleted or replaced code point are
near. The words form a trie, kept as an edge table. Nodes without a choice are
left out: a node is kept if it is the root, ends a word or has several next
letters, so an edge's label may hold several letters and the number of levels
follows the branching of the trie, not the length of its words.

The frontier is a table of states (word, position, node, edits), at first every
word at the root. A level joins it with the edges of its nodes:
* without an edit, an edge whose label continues the word leads on; along any
  other edge the word may replace a letter or take in a letter of the label;
* with an edit, only the edge that continues the word leads on.
A state with one edit that ends its word where another word ends makes the two
neighbours. A deletion is an insertion seen from the other word, so pairs are
completed by their reverse and deletions need no states; a letter is replaced by
larger ones only.

Near the root every word meets every edge. So edits are made in the second half
of a word only, and the search runs twice, over the words and over the words
spelt backwards: two near words agree before the edit or behind it in at least
half of their letters. States that no edge or word's end continues are left out.

All words pass the root and half of them a few nodes below, so the edges of a
node are repeated once per ``SALT_WORDS`` words beneath it and a state meets
the copy that its word is hashed to. Every level is written to the shared folder.

Edge cases: a null text has no words; a null doc_id counts as empty text in the
hash; repeated rows count each; ties between forms go to the smallest word in
code-point order; nodes are told apart by 64-bit hashes and pairs confirmed on
the words; words and texts may be of any length; an empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import text_batches, to_shared

MIN_LETTERS = 6
MIN_COUNT = 5
TIMES = 5  # a form occurs at least so many times as often as its variant
MUTATED = 199
SALT_WORDS = 5000
HELD_WORDS = 500_000
HELD_BYTES = 32 << 20

_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def altered(run: str, start: int) -> str:
    """The word of a run; ``start`` is the crc32 of what stands before it."""
    h = crc32(run.encode(), start)
    if h % MUTATED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the corpus's words, by the letters and occurrences asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile("[a-zÀ-ÿ]{%d,}" % min_letters).findall  # a shorter run gives no word
        held: Counter = Counter()
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                              ["word", "n"])

        for batch in text_batches(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                before = len(held)
                for r, k in Counter(find(text.encode().translate(_LOWER).decode())).items():
                    held[altered(r, start)] += k
                    size += len(r) if len(held) > before else 0
                if len(held) > HELD_WORDS or size > HELD_BYTES:
                    yield out()
                    held.clear()
                    size = 0
        yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")) \
        .where((F.length("word") >= min_letters) & (F.col("n") >= min_count))


ROOT = xxhash.xxh3_64().intdigest() - (1 << 63)


def trie_steps(words: DataFrame) -> DataFrame:
    """end, position, node, next: a row per prefix of each word with its node,
    the letter that follows it (null at the word's end) and the node of the
    whole word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["end", "position", "node", "next"]
        for batch in text_batches(batches, "word", 1 << 18):
            end, position, node, following = [], [], [], []
            for word in batch.column("word").to_pylist():
                state, path = xxhash.xxh3_64(), [ROOT]
                for letter in word:
                    state.update(letter.encode())
                    path.append(state.intdigest() - (1 << 63))
                end += [path[-1]] * len(path)
                position += range(len(path))
                node += path
                following += [*word, None]
            yield pa.RecordBatch.from_arrays([pa.array(end, pa.int64()), pa.array(position, pa.int32()),
                                              pa.array(node, pa.int64()), pa.array(following, pa.string())], names)

    return words.select("word").mapInArrow(run, "end long, position int, node long, next string")


def trie_edges(words: DataFrame, steps: DataFrame) -> DataFrame:
    """depth (edges from the root to the node), node, salt, first, label, child,
    ends (a word ends at the child), salts (copies of the child's edges, 0 if it
    has none), nexts (the letters that may follow the child)."""
    nodes = steps.groupBy("node", "next").agg(F.count("*").alias("n")).groupBy("node").agg(
        F.sum(F.when(F.col("next").isNotNull(), F.col("n"))).alias("below"), F.count("next").alias("degree"),
        F.bool_or(F.col("next").isNull()).alias("ends"), F.array_join(F.collect_set("next"), "").alias("nexts"))
    nodes = to_shared(nodes.where((F.col("degree") > 1) | F.col("ends") | (F.col("node") == ROOT)).select(
        "node", "ends", "nexts", F.when(F.col("degree") > 0, 1 + F.expr(f"below div {SALT_WORDS}")).otherwise(0).alias("salts")),
        "trie-nodes")
    kept = steps.select("end", "position", "node").join(nodes.select("node"), "node")
    path = kept.groupBy("end").agg(F.sort_array(F.collect_list(F.struct("position", "node"))).alias("path"))
    links = path.select("end", F.explode(F.expr(
        "transform(sequence(1, size(path) - 1), i -> named_struct('node', path[i - 1].node, 'child', path[i].node, "
        "'since', path[i - 1].position, 'until', path[i].position, 'depth', i - 1))")).alias("x"))
    links = links.groupBy("x.child").agg(F.min(F.struct("end", "x.node", "x.since", "x.until", "x.depth")).alias("x"))
    text = words.select("word", F.col("end").alias("e"))
    edges = links.join(text, F.col("x.end") == F.col("e")).select(
        F.col("x.depth").alias("depth"), F.col("x.node").alias("node"), "child", F.expr("substring(word, x.since + 1, x.until - x.since)").alias("label"))
    copies = nodes.where("salts > 0").select("node", F.explode(F.expr("sequence(0, int(salts) - 1)")).alias("salt"))
    return edges.join(nodes.withColumnRenamed("node", "child"), "child").join(copies, "node").select(
        "depth", "node", "salt", F.expr("substring(label, 1, 1)").alias("first"), "label", "child", "ends", "salts", "nexts")


def next_states(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one edge further down: word, position, node, edits, ends, salts."""
    states = frontier.withColumn("salt", F.expr("int(pmod(xxhash64(word), salts))")).drop("salts", "ends")
    rest, m, wide = "substring(word, position + 1)", "length(label)", "edits = 0 AND position >= length(word) div 2"
    state = lambda took, edits="1": f"named_struct('position', position + {took}, 'edits', {edits})"
    replaced = (f"first > substring(word, position + 1, 1) AND substring({rest}, 2, {m} - 1) = substring(label, 2)"
                f" OR first = substring(word, position + 1, 1) AND levenshtein(substring({rest}, 1, {m}), label, 1) = 1")
    taken = (f"length({rest}) >= {m} - 1 AND (first <> substring(word, position + 1, 1) AND "
             f"substring({rest}, 1, {m} - 1) = substring(label, 2) OR first = substring(word, position + 1, 1) AND "
             f"levenshtein(substring({rest}, 1, {m} - 1), label, 1) = 1)")
    steps = (f"CASE WHEN startswith({rest}, label) THEN array({state(m, 'edits')}) WHEN edits = 1 THEN NULL ELSE filter(array("
             f"CASE WHEN length({rest}) >= {m} AND ({replaced}) THEN {state(m)} END, "
             f"CASE WHEN {taken} THEN {state(m + ' - 1')} END), x -> x IS NOT NULL) END")
    first = states.where(wide).join(edges, ["node", "salt"])
    second = states.where(f"NOT ({wide})").withColumn("first", F.expr("substring(word, position + 1, 1)")) \
        .join(edges, ["node", "salt", "first"])
    # a state with an edit goes on only where a word or the trie does
    able = ("to.edits = 0 OR CASE WHEN to.position = length(word) THEN ends "
            "ELSE contains(nexts, substring(word, to.position + 1, 1)) END")
    return first.unionByName(second).withColumn("to", F.explode(F.expr(steps))).where(able).select(
        "word", F.col("to.position").alias("position"), F.col("child").alias("node"), F.col("to.edits").alias("edits"),
        "ends", "salts")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): both directions of every near pair of the distinct
    ``word`` column."""
    ahead = edited_behind_half(words.select("word"))
    back = edited_behind_half(words.select(F.reverse("word").alias("word")))
    pairs = ahead.unionByName(back.select(F.reverse("word").alias("word"), F.reverse("near").alias("near")))
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def edited_behind_half(words: DataFrame) -> DataFrame:
    """(word, near): pairs whose edit lies in the second half of ``word``, each
    at least in one direction; others may be among them."""
    steps = to_shared(trie_steps(words), "trie-steps")
    ends = to_shared(words.mapInArrow(_end_nodes, "word string, end long"), "trie-ends")
    edges = to_shared(trie_edges(ends, steps), "trie-edges")
    root = edges.where(F.col("node") == ROOT).agg(F.max("salt")).first()[0]
    frontier = ends.select("word", F.lit(0).alias("position"), F.lit(ROOT).alias("node"), F.lit(0).alias("edits"),
                           F.lit(False).alias("ends"), F.lit(0 if root is None else root + 1).alias("salts"))
    found = ends.where("false").select("word", F.col("end").alias("node"))
    levels = 0
    while root is not None:
        # a level leads one edge on, so its states are all at nodes of one depth
        level = to_shared(next_states(frontier, edges.where(F.col("depth") == levels)), "trie-level")
        found = found.unionByName(level.where("edits = 1 AND ends AND position = length(word)").select("word", "node"))
        levels += 1
        if levels % 16 == 0:
            found = to_shared(found, "trie-found")
        frontier = level.where("salts > 0 AND (edits = 0 OR position < length(word))")
        if frontier.isEmpty():
            break
    return to_shared(found.join(ends.select(F.col("word").alias("near"), F.col("end").alias("node")), "node")
                     .where("levenshtein(word, near, 1) = 1").select("word", "near"), "trie-pairs")


def _end_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = [xxhash.xxh3_64_intdigest(w.encode()) - (1 << 63) for w in batch.column("word").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ends, pa.int64())], ["word", "end"])


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root for a stored table (word, n)."""
    near = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    is_form = F.col("form_n") >= times * F.col("n")
    known = to_shared(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                   F.when(is_form, F.col("best.near")).alias("form"),
                                   F.when(is_form, F.col("form_n")).alias("form_n")), "word-forms")
    # a form occurs more often than its variant, so chains end; each round doubles what they span
    roots = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = to_shared(roots.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "word-roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
                      times: int = TIMES) -> DataFrame:
    return variants(to_shared(word_counts(docs, min_letters, min_count), "words"), times)
