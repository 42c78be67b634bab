"""The ten operators and the pipeline against brute force, round trips and
held-out accuracy, with nulls, empty and long texts, ties, repeated rows, empty
tables and clashing columns."""
import base64
import os
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from usagelens.llm import (byte_bpe, decontaminate, language_id, near_dedup, quality_rules, queries,  # noqa: E402
                           secret_scan, simple8b, substring_dedup, token_output, url_filter)

SF001 = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def key(row):
    return tuple((x is not None, x) for x in row)


def same(got, expected):
    got, expected = sorted(map(tuple, got), key=key), sorted(expected, key=key)
    assert [p for p in zip(got, expected) if p[0] != p[1]][:3] == [] and len(got) == len(expected)


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    passages = [" ".join(rnd.choice(vocabulary) for _ in range(n)) for n in (49, 50, 51, 120)]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    docs += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "a b"), (1004, "A  b"), (1005, "É b c"), (1006, "é b c"),
             (1007, "a " * 3000), (1008, "a " * 3001), (1009, passages[1]), (1009, passages[1]), (None, passages[1]),
             (None, None), (1010, passages[0]), (1011, passages[0] + " x"), (1012, "x\x00y \x1c z" * 40),
             (1013, "日本語 😀 мир, naïve İ ΑΣ’s it's\t" * 30)]
    for k in range(60):
        docs.append((1100 + k, " ".join(rnd.choice(passages) for _ in range(rnd.randrange(1, 4)))))
    for k in range(60):  # around the similarity bound
        w = (passages[3] + " " + passages[2]).split()
        for _ in range(rnd.choice([1, 2, 4, 6, 8])):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        docs.append((1200 + k, " ".join(w)))
    rnd.shuffle(docs)
    return docs


@pytest.fixture(scope="module")
def documents(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(5)


@pytest.fixture
def given(monkeypatch):
    """Let queries read DataFrames instead of files."""
    def use(**tables):
        monkeypatch.setattr(queries, "read_table", lambda spark, sf_dir, name: tables[name])
    return use


def test_quality_rules(spark, texts, documents, given):
    given(documents=documents)
    rows = queries.op1_quality_rules(spark, "").collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows],
         [(d, *brute.quality(t)) for d, t in texts])
    assert not any(r.kept and r.base_failed for r in rows)


def test_quality_rules_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    rows = quality_rules.quality_rules(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    assert all(r.kept for r in rows if r.quality == 1) and not any(r.kept for r in rows if r.quality == 0)


def test_secret_scan(spark, texts, given):
    rnd = random.Random(1)
    many = "".join(secret_scan.ENTROPY[1].alphabet)

    def some(n, of=many):
        return "".join(rnd.choice(of) for _ in range(n))

    own = [(5000 + i, t) for i, t in enumerate([
        "token=secret=abcdefghijklmnop", "token: password: abcdefghijklmn", f'é𝒳 API_KEY="{some(30)}" x',
        "AKIA" + some(20, "ABC019") + " AKIAshort", "x" * 30000 + "deadbeefdeadbeef" + "é" * 50,
        " ".join(f'token = "{some(40, "0123456789abcdef")}"' for _ in range(700)), some(400), "EXAMPLE" + some(40),
        f"example/{some(32)}-Example_{some(25)}", "sha256-" + some(44, many[:62]) + "_" + some(30),
        "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", some(19) + "example" + some(19),
        "1b4e28ba-2fa1-41d2-883f-0016d3cca427", "src/Main/" * 9,
        some(60, "0123456789ABCDEF"), "secret'  :  'ABCDEFGHIJK' passwd=xxxxxxxxxxxxx"])]
    rows = [x for x in texts if len(x[1] or "") < 3000] + own
    given(documents=spark.createDataFrame(rows, "doc_id long, text string"))
    same(queries.op2_secret_scan(spark, "").collect(),
         [(d, *brute.secrets(t, secret_scan.kinds(), secret_scan.ENTROPY, secret_scan.ALLOW)) for d, t in rows])


def test_entropy_of_narrow_classes(spark):
    rnd = random.Random(7)
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    tokens = [(kind, "".join(rnd.choice(of) for _ in range(40))) for kind, of in (
        ("entropy_base36", low + digits), ("entropy_base32", up + digits), ("entropy_letters", low + up)) for _ in range(30)]
    plain = ["Einungtzheitgeungverlich", "keitstlichschenverpf", "z1" * 30, "Z1" * 30, "zB" * 30, "x" * 60,
             "DonaudampfschifffahrtsGesellschaft"]
    rows = [(i, f"é {t}. x") for i, (_, t) in enumerate(tokens)] + [(1000 + i, t) for i, t in enumerate(plain)]
    names = secret_scan.kinds()
    out = secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in out.collect()}
    missed = [t for i, (kind, t) in enumerate(tokens) if kind not in [names[s.kind] for s in got[i].spans]]
    assert missed == [] and not any(got[1000 + i].spans for i in range(len(plain)))
    spans = [(s.start, s.end) for i in range(len(tokens)) for s in got[i].spans]
    assert all(2 <= a and b <= 42 for a, b in spans)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é token=abcdefghijklmnop and deadbeefdeadbeef0"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secret_scan.redact(secret_scan.scan_secrets(df)).collect()}
    assert got == {1: "é [SECRET] and [SECRET]", 2: None, 3: ""}


def test_allow_list_suppresses_windows_only(spark):
    key = "q7Zt2LmXw9Rb4KcV8nHy3PsJ6dGf1TaE"
    texts = [f"x example/{key} y", f"x example_{key} y", f"x {key} y", "x wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY y",
             "x sha256-" + key + " y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in secret_scan.redact(secret_scan.scan_secrets(df)).orderBy("doc_id").collect()]
    assert not any(key[4:-4] in t for t in got[:3]) and "example" in got[0]
    assert got[3:] == texts[3:]


def test_redaction_of_very_many_spans(spark):
    lines = [f"n{i} token=abcdefghijkl{i:06d}" for i in range(100_000)]
    df = spark.createDataFrame([(1, " é ".join(lines))], "doc_id long, text string")
    row = secret_scan.redact(secret_scan.scan_secrets(df)).select("text", "doc_id").collect()[0]
    assert row.text == " é ".join(f"n{i} [SECRET]" for i in range(100_000))


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_decontamination(spark, texts, documents, given, monkeypatch, block):
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (10, block))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").limit(8).collect()]
    items += [(500, None), (501, ""), (502, "É two"), (503, "a " * 12), (504, "a a"), (505, " .. "), (items[0][0], items[1][1])]
    docs = texts + [(2000, "É TWO x é two É two"), (2001, items[0][1] + " x " + items[2][1].upper())]
    given(documents=spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
          benchmark=spark.createDataFrame(items, "item_id long, text string"))
    rows = queries.op3_decontamination(spark, "").collect()
    same([tuple(r)[:6] for r in rows], brute.contamination(docs, items))


def test_proximity_and_unrestricted_index(spark):
    docs = spark.createDataFrame([(1, "one two big three four"), (2, "one two three four"), (3, "four three two one")],
                                 "doc_id long, text string")
    test = decontaminate.Windows([(7, [b"one", b"two", b"three", b"four"])])
    index = decontaminate.build_index(docs)  # all words
    found = {r.doc_id: r for r in decontaminate.search(index, spark.sparkContext.broadcast(test), slop=1).collect()}
    assert found[1].near_items == [7] and found[1].items == []
    assert found[2].items == [7] and found[2].spans == [(0, 4)] and found[3].near_items == []


def test_token_output(spark, texts, documents, given):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_output.VOCABULARY))
    given(documents=documents)
    expected, at = [], 0
    for d, t in sorted(texts, key=lambda x: key((x[0], x[1]))):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        expected.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    same(queries.op4_token_output(spark, "").collect(), expected)


def test_word_encoder_splits_like_the_library():
    from tokenizers import Tokenizer
    path = public_tokenizers.path(token_output.VOCABULARY)
    texts = [a + chr(c) + b for c in range(1, 0x250) for a in ("", "a", "É", "'") for b in ("", ".", "s,")]
    expected = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in token_output.WordEncoder(path).encode(pa.array(texts))] == expected


def test_added_tokens_as_by_the_library(spark, given):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_output.VOCABULARY))
    texts = [x for t in ("<|endoftext|>", "<|startoftext|>") for x in (
        t, f"a {t} b", f"a{t}b", f"É.{t}, x", t + t, f"\n{t}\t's{t}", t.upper(), t[:-1], f"<{t}>", f"e{t}\u0301", f"1 {t}.")]
    given(documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    expected, at = [], 0
    for d, t in enumerate(texts):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        expected.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert tokenizer.encode(texts[1], add_special_tokens=False).ids == [320, 49407, 321]
    same(queries.op4_token_output(spark, "").collect(), expected)


@pytest.mark.parametrize("values", [
    [], [0], [2**64 - 1, 2**60, 2**60 - 1, 1], [0] * 1000, [1] * 129, list(range(70000)),
    [(14 << 60) + 5] * 300 + [3] * 300])
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, offsets = simple8b.encode(v)
    assert (simple8b.decode(words, offsets, len(v)) == v).all()


def test_near_dedup(spark, texts, documents, given):
    given(documents=documents)
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in queries.op5_near_dedup(spark, "").collect()]
    same(rows, brute.near_components(texts))


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    shares = []
    for _ in range(40):
        a = rng.integers(0, 2**63, 1000).astype(np.uint64)
        b = np.concatenate([a[:857], rng.integers(0, 2**63, 143).astype(np.uint64)])
        s = near_dedup.sketch([np.unique(a), np.unique(b)])
        shares.append((s[0] == s[1]).mean())
    assert abs(np.mean(shares) - 857 / 1143) < 0.02
    assert (near_dedup.sketch([np.array([5], np.uint64)]) != np.iinfo(np.uint64).max).all()


def test_byte_bpe(spark, texts, documents, given):
    import tiktoken
    path = public_tokenizers.path(byte_bpe.RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    given(documents=documents)
    same(queries.op6_byte_bpe(spark, "").collect(),
         [(d, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t or "")) for d, t in texts for ids in [encode(t or "")]])


@pytest.mark.parametrize("shard", [40_000, 120])
def test_substring_dedup(spark, texts, documents, given, monkeypatch, shard):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    given(documents=documents)
    same(queries.op7_substring_dedup(spark, "").collect(), brute.without_repeats(texts))


def test_common_phrases_stay_in_shard_size(spark, given, monkeypatch):
    """A phrase of few words in every document, different words around it:
    no task gets more than a shard of its pieces, and none is lost."""
    rnd = random.Random(4)
    hashes = substring_dedup.WordHashes()

    def rank(phrase):  # of its smallest gram
        words = hashes.array([w.encode() for w in phrase])
        return min(int(substring_dedup.mix64(np.array([(words[k:k + 10] * substring_dedup._WEIGHTS[:10]).sum()]))[0])
                   for k in range(len(words) - 9))

    phrases = [min(([f"p{rnd.randrange(10**6)}" for _ in range(n)] for _ in range(k)), key=rank)
               for n, k in ((12, 2000), (35, 500), (75, 200))]
    texts = []
    for i in range(150):
        own = [f"u{i}_{k}" for k in range(240)]
        texts.append((i, " ".join(own[:60] + phrases[0] + own[60:120] + phrases[1] + own[120:180] + phrases[2] + own[180:])))

    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 2000)
    real = substring_dedup.shard_spans

    def shard_spans(group):
        assert sum(len(x[3]) for x in group) <= 2000, "more than a shard in one task"
        return real(group)

    monkeypatch.setattr(substring_dedup, "shard_spans", shard_spans)
    given(documents=spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    expected = brute.without_repeats(texts)
    assert sum(x[2] > 0 for x in expected) == 149
    same(queries.op7_substring_dedup(spark, "").collect(), expected)


def test_language_id(spark, given):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(3000, None, "en"), (3001, "12 34 !", "en"), (3002, "", None)], docs.schema)
    given(documents=docs.unionByName(extra))
    rows = {r.doc_id: r for r in queries.op8_language_id(spark, "").collect()}
    assert all(rows[d].lang_pred == "und" for d in (3000, 3001, 3002))
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(rows[d].held_out == (d in held) for d in truth)
    assert np.mean([rows[d].lang_pred == truth[d] for d in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_temperature_has_the_smallest_loss():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3)) * 2
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    labels = (p.cumsum(1) > rng.random((4000, 1))).argmax(1)
    assert abs(language_id.fit_temperature(logits * 3, labels) - 3) < 0.3


def test_quality_classifier(spark):
    rows = queries.op9_quality_classifier(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().merge(rows, on="doc_id")
    clean = labels[(labels.quality == 1) & (labels.toxic == 0)]
    assert clean.kept.mean() > 0.97 and labels[labels.quality == 0].kept.mean() < 0.3


def test_url_filter(spark, given):
    urls = ["http://a.com", "http://a.com/", "http://WWW.Example.com/en/x?q#f", "http://x.example.com/en/", "http://example.com/en",
            "ftp://example.com/en/../", "http://a.net/es/1", "http://net/fr/", "http://b.net/en", None, "", "no url", "://", "x://y://z.com/a",
            "http://example.com.evil.org/en/", "http://q.com:80/a"] * 2
    given(pages=spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    same(queries.op10_url_filter(spark, "").collect(), [(i, *brute.url(u, queries.URL_RULES)) for i, u in enumerate(urls)])


def test_url_rules_in_blocks(spark):
    rnd = random.Random(2)
    part = lambda: rnd.choice(["a", "b", "ab"])
    rules = list({(r.host, r.path): r for r in (url_filter.Rule(
        rnd.choice(["allow", "block"]), ".".join(part() for _ in range(rnd.randrange(1, 4))),
        "/" + "/".join(part() for _ in range(rnd.randrange(3)))) for _ in range(60))}.values())
    urls = ["http://" + ".".join(part() for _ in range(3)) + "/" + "/".join(part() for _ in range(3)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for size in (1 << 20, 40):
        got = url_filter.judge_urls(df, rules, max_rule_bytes=size).select("page_id", "host", "path", "rule", "verdict")
        same(got.collect(), [(i, *brute.url(u, rules)) for i, u in enumerate(urls)])


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.startswith("op")])
def test_empty_tables(spark, given, name):
    empty = lambda schema: spark.createDataFrame([], schema)
    given(documents=empty(COLUMNS), benchmark=empty("item_id long, text string"),
          labels=empty("doc_id long, quality int, toxic int"), pages=empty("page_id long, url string, html string"),
          embeddings=empty("vec_id long, embedding array<float>, label int"))
    assert queries.QUERIES[name](spark, "").count() == 0


def test_pipeline(spark, texts, tmp_path):
    import tiktoken
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    docs = [(d, t, "en", "s", 7) for d, t in texts] + [
        (9000, " ".join(f"only{i}" for i in range(60)) + " token=abcdefghijklmnop of the and to", "en", None, 7)]
    unique, other = (" ".join(f"{w}{i}" for i in range(60)) + " of the and to" for w in ("single", "lone"))
    docs += [(1009, unique), (None, unique + " more"), (None, other)]
    docs = [(*d, "en", "s", 7) if len(d) == 2 else d for d in docs]
    spark.createDataFrame(docs, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [(r.doc_id, r.text) for r in quality_rules.quality_rules(
        spark.createDataFrame(docs, COLUMNS)).where("kept").collect()]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0))
    judged = brute.near_components([(i, t) for i, (_, t) in enumerate(kept)])  # every row is a document
    kept = [x for x, c in zip(kept, judged) if c[3]]
    kept = [x for x, c in zip(kept, brute.contamination(kept, items)) if not c[5]]
    masked = []
    for d, t in kept:
        spans = brute.secrets(t, secret_scan.kinds(), secret_scan.ENTROPY, secret_scan.ALLOW)[4]
        out, at = "", 0
        for s, e in sorted(tuple(map(int, x.split(":")[1:])) for x in spans.split(",") if x):
            if e > at:
                out, at = (out + t[at:s] + "[SECRET]", e) if s > at or not out else (out, e)
        masked.append((d, out + t[at:]))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(byte_bpe.RANKS), "rb"))}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    same([(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded_sha256) for r in rows],
         [(d, encode(t), brute.sha(t)) for d, t in masked])
    assert 9000 in {r.doc_id for r in rows} and len(rows) > 50
    # a unique text that shares its id with a copy, and one without an id
    assert {t[:5] for d, t in masked if d in (1009, None)} >= {"singl", "lone0"}


def test_stages_pass_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").selectExpr("*", "7 AS n_words", "'x' AS kept", "1 AS spans", "2 AS items")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns
        assert out.where("n_words <> 7 OR kept <> 'x' OR spans <> 1 OR items <> 2").isEmpty()


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_meet_the_most_central_first(spark):
    # 9 shares a bucket with each of 1 to 5, which share none (but 1 and 2)
    from usagelens.llm import near_dedup
    rows = [(k, n, 2) for k, n in enumerate([1, 2, 3, 4, 5])] + [(k, 9, 2) for k in range(5)] + [(7, 1, 2), (7, 2, 2)]
    got = near_dedup._central_pairs(spark.createDataFrame(rows, "key long, node long, met long"))
    assert sorted(map(tuple, got.collect())) == [(9, n) for n in (1, 2, 3, 4, 5)]
