"""Phrase mining against brute force, with every way of splitting prefixes."""
import random
import re
import string
from collections import Counter

import pytest

from usagelens.llm import phrase_mining

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_phrases(docs, least, top):
    f, out = Counter(), []
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang or "und", tuple(w[i:i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    for lang in {x[0] for x in f}:
        n, rows = sum(a for x, a in f.items() if x[0] == lang and len(x[1]) == 1), []
        for (x, w), a in found.items():
            if x != lang or any(y == lang and len(v) > len(w) and w in {v[:2], v[1:]} and 100 * b >= 50 * a
                                for (y, v), b in found.items()):
                continue
            cuts = [(10 ** 6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(5)
    vocabulary = ["the", "The", "of", "a", "x\x00y", "naïve", "日本", "É", "é", "b" * 3000, "q'r", "\x85", " "]
    rows = [("en", None), (None, ""), ("en", " \t. ;"), (None, "alone"), ("xx", "A b c " * 40), ("en", "a.b.a.b")]
    for i in range(300):
        words = rnd.choices(vocabulary, [30, 5, 20, 20, 2, 3, 3, 1, 2, 1, 2, 2, 2], k=rnd.randrange(1, 60))
        text = "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b"]) for w in words)
        rows.append((rnd.choice(["en", "en", "fr", None, "und"]), text))
    rows += [("en", "new york city hall")] * 12 + [("en", "york city")] * 3
    return rows


@pytest.mark.parametrize("budget, held", [(10 ** 6, 1 << 21), (400, 1000), (40, 50), (1, 1 << 21)])
def test_phrases_equal_brute_force(spark, monkeypatch, docs, budget, held):
    monkeypatch.setattr(phrase_mining, "HELD_WORDS", held)
    df = spark.createDataFrame([(x, t, 1, "n") for x, t in docs], "lang string, text string, n int, words string").repartition(3)
    got = phrase_mining.collocations(df, budget=budget, top=60).collect()
    assert sorted(map(tuple, got)) == brute_phrases(docs, 10, 60)


def test_counts_beyond_64_bit_products(spark, monkeypatch):
    big = 3 * 10 ** 12
    singles = [("en", b"a", big + 1), ("en", b"b", big)]
    schema = "lang string, words binary, f long"
    monkeypatch.setattr(phrase_mining, "phrase_counts", lambda *a: (
        spark.createDataFrame(singles, schema),
        spark.createDataFrame([("en", [b"a", b"b"], big - 7)], "lang string, words array<binary>, f long")))
    row = phrase_mining.collocations(None).collect()[0]
    assert (row.score, row.n) == (10 ** 6 * (big - 7) ** 2 // ((big + 1) * big), 2 * big + 1)


def test_rows_of_many_words_are_added_up_alike():
    import numpy as np
    rnd = np.random.default_rng(1)
    columns = [rnd.integers(0, 5, 500) for _ in range(3)]
    counts = rnd.integers(1, 9, 500)
    few, many = (phrase_mining._added(columns, counts, n) for n in (5, 1 << 22))
    assert (few[0] == many[0]).all() and (few[1] == many[1]).all()
