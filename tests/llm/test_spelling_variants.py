"""Spelling variants against brute force on a small corpus and on word lists."""
import random
import re
import string
from collections import Counter
from zlib import crc32

import pytest

from usagelens.llm import spelling_variants

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_counts(docs, letters=6, least=5):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= letters and k >= least}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n, times=5):
    forms, out = {}, []
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_apart(w, v)] for w in n}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= times * n[w] else None
    for w in n:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n[w], len(near[w]), n[forms[w]] if forms[w] else None))
    return sorted(out)


def edited(rnd, w, letters):
    i = rnd.randrange(len(w) + 1)
    return rnd.choice([w[:i] + rnd.choice(letters) + w[i:], w[:i] + w[i + 1:], w[:i] + rnd.choice(letters) + w[i + 1:]])


@pytest.mark.parametrize("seed, salt_words", [(1, 5000), (2, 3)])
def test_word_lists(spark, monkeypatch, seed, salt_words):
    monkeypatch.setattr(spelling_variants, "SALT_WORDS", salt_words)
    rnd = random.Random(seed)
    words = {"".join(rnd.choices("abé", k=rnd.randrange(1, 9))) for _ in range(250)}
    words |= {"a" * k for k in range(1, 12)} | {"long" * 500, "long" * 499 + "lon", "long" * 250 + "x" + "long" * 250}
    for _ in range(3):
        words |= {edited(rnd, w, "abéz") for w in rnd.sample(sorted(words), 60)}
    n = {w: 5 ** rnd.randrange(1, 7) + rnd.randrange(2) for w in words - {""}}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    assert sorted(map(tuple, spelling_variants.variants(df).collect())) == brute_variants(n)


def test_corpus(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "HELD_WORDS", 20)
    rnd = random.Random(4)
    letters = "abcdeÀÿ×é"
    base = ["".join(rnd.choices(letters, k=rnd.randrange(5, 9))) for _ in range(40)]
    base += [edited(rnd, w, letters) for w in base for _ in range(3)]
    docs = [(None, None), (1, ""), (2, "12 .,"), (None, "abcdefg " * 6), (3, "Q" * 5000 + " " + "q" * 4999 + "x")]
    for i in range(400):
        text = "".join(rnd.choice(base[:10 + i % 150]).translate(str.maketrans("ab", "AB") if rnd.random() < .3 else {}) +
                       rnd.choice([" ", "\n", "1", "_", "中", "Ā"]) for _ in range(30))
        docs.append((rnd.choice([i, i, i, 7, None]), text))
    docs += docs[4:9] * 5
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(4)
    got = spelling_variants.spelling_variants(df).collect()
    assert sorted(map(tuple, got)) == brute_variants(brute_counts(docs)) and len(got) > 50
    assert spelling_variants.spelling_variants(df.where("text IS NULL")).count() == 0


def test_levels_read_edges_of_one_depth(spark, monkeypatch):
    from usagelens.llm import spelling_variants as sv
    depths, plain = [], sv.next_states

    def watched(frontier, edges):
        depths.append([r[0] for r in edges.select("depth").distinct().collect()])
        return plain(frontier, edges)

    monkeypatch.setattr(sv, "next_states", watched)
    words = spark.createDataFrame([("letter",), ("better",), ("letters",), ("lettes",)], "word string")
    got = sorted(map(tuple, sv.near_words(words).collect()))
    assert ("letter", "letters") in got and ("better", "letter") in got and ("lettes", "letters") in got
    assert all(len(d) <= 1 for d in depths) and depths[0] == [0]
