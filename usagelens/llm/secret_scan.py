"""Secret scan in built-in Spark functions only (operator 2).

Base kinds are patterns. The method's kinds look at candidate strings of one
character class and slide a window over each: the window's counts per symbol
and the sum of c * log2(c) are updated by the symbol that enters and the one
that leaves, so each step costs the same however long the candidate is. A
candidate is a finding if a window's Shannon entropy reaches the class's
bound; its span runs from the first such window to the end of the last. An
allow list of patterns suppresses the windows that overlap a match of it, never
base findings: matches cut a candidate and its pieces are judged alone, so a
key beside an allowed word is still found.

All positions are code points, end exclusive. Findings of a text are computed
inside its row: no shuffle, no user function.

Edge cases: a null text counts as empty; an empty text has no spans; repeated
rows are scanned alike; an empty table gives an empty result; input columns
that clash with result names are replaced. Very long texts and texts of very
many spans are read and masked whole: arrays grow in blocks, so the cost of a
text of n spans grows with n * n / 512 small steps at most.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

SPAN = "array<struct<start:int,kind:int,end:int>>"
BLOCK = 512


class Pattern(NamedTuple):
    """``regex`` without capturing groups but, if ``min_group``, its first
    group, which must hold that many characters for a match to count."""
    kind: str
    regex: str
    min_group: int = 0


class EntropyClass(NamedTuple):
    """Candidates of one character class. ``needs`` must occur in each."""
    kind: str
    regex: str
    alphabet: str
    needs: str
    window: int
    bits: float


# Base patterns fixed by the task. Runs of one class shorter than the minimum
# never count, so the minimum is part of the pattern; ``assign`` consumes a
# failing match, so there the length is checked afterwards.
BASE = [
    Pattern("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    Pattern("access", r"AKIA[A-Z0-9]{14,}"),
    Pattern("hex", r"[0-9a-f]{16,}"),
]

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"

ENTROPY = [
    EntropyClass("entropy_hex", r"(?:[0-9A-F]{20,})", _DIGITS + "ABCDEF", r"[A-F]", 20, 3.0),
    EntropyClass("entropy_base64", r"(?:[A-Za-z0-9+/_=-]{20,})", _UPPER + _LOWER + _DIGITS + "+/_=-",
                 r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])", 20, 3.8),
    # 99% of random runs of 24 reach 3.5 (base 36 and 32) and 3.68 (letters).
    # Letters must change to upper case three times, as names rarely do; those
    # of one case only are no class: words reach the entropy of random ones.
    EntropyClass("entropy_base36", r"(?:[a-z0-9]{20,})", _LOWER + _DIGITS, r"(?=.*[0-9])(?=.*[a-z])", 20, 3.4),
    EntropyClass("entropy_base32", r"(?:[A-Z0-9]{20,})", _UPPER + _DIGITS, r"(?=.*[0-9])(?=.*[G-Z])", 20, 3.4),
    EntropyClass("entropy_letters", r"(?:[A-Za-z]{20,})", _UPPER + _LOWER, r"(?:[a-z]+[A-Z]+){3}", 20, 3.7),
]

# Strings of high entropy that are no secrets: documentation samples, content
# digests with a named algorithm, version-4 style identifiers, paths. A match
# covers what it allows, and is never empty.
ALLOW = [
    r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
    r"(?i:example)",
    r"(?i:^sha(?:1|256|384|512)[-_][a-z0-9+/=]+)",
    r"(?i:^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$)",
    r"^/?(?:[A-Za-z_-]+/)+[A-Za-z_-]*$",
]


def _in_blocks(xs: Column) -> Column:
    """The array in pieces of ``BLOCK`` elements; one empty piece if empty."""
    last = F.floor(F.greatest(F.size(xs) - 1, F.lit(0)) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))


def _before(values: Column, combine) -> Column:
    """For each element, all earlier ones combined, from 0 on; in blocks, so
    that growing an array stays cheap for very many matches."""
    def running(xs: Column, base: Column) -> Column:
        return F.aggregate(xs, F.struct(base.alias("at"), F.array().cast("array<int>").alias("out")),
                           lambda a, x: F.struct(combine(a["at"], x).alias("at"),
                                                 F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    def starts(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0), combine))
        return F.flatten(F.zip_with(blocks, running(totals, F.lit(0)), running))

    return _bound(_bound(values, _in_blocks), starts)


def _prefix_sums(lengths: Column) -> Column:
    """Start of each element: the sum of all earlier lengths."""
    return _before(lengths, lambda a, x: a + x)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once: as a lambda's variable it
    is not repeated for each element of an inner lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _matches(df: DataFrame, text: str, regex: str, name: str, groups: int = 0) -> DataFrame:
    """Adds array ``name`` of (start, end, value, group) of all leftmost
    non-overlapping matches. ``\\G`` ties each match to the end of the last,
    so the text between two matches is captured and gives their positions."""
    t = F.col(text)
    located = F.lit(r"\G([\s\S]*?)(" + regex + ")")
    df = df.withColumn(f"__has{name}", t.rlike(regex))
    hit = F.col(f"__has{name}")

    def part(i: int) -> Column:
        return F.when(hit, F.regexp_extract_all(t, located, F.lit(i))) \
            .otherwise(F.array().cast("array<string>"))

    out = df.withColumns({f"__gap{name}": part(1), f"__hit{name}": part(2),
                          f"__group{name}": part(3) if groups else F.array().cast("array<string>")})
    gap, value, group = F.col(f"__gap{name}"), F.col(f"__hit{name}"), F.col(f"__group{name}")
    pieces = F.zip_with(gap, value, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))
    placed = _bound(pieces, lambda ps: F.zip_with(
        ps, _prefix_sums(F.transform(ps, lambda x: x["gap"] + F.length(x["value"]))),
        lambda x, at: F.struct((at + x["gap"]).alias("start"), x["value"].alias("value"))))
    out = out.withColumn(name, F.zip_with(placed, group, lambda x, g: F.struct(
        x["start"].alias("start"), x["value"].alias("value"), g.alias("group"))))
    return out.drop(f"__has{name}", f"__gap{name}", f"__hit{name}", f"__group{name}")


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(kind).alias("kind"),
        (m["start"] + F.length(m["value"])).alias("end")))


def _entropy_span(value: Column, cls: EntropyClass) -> Column:
    """(first, last): starts of the first and last window at or above the
    bound, -1 if none. Entropy of a window = log2(W) - sum(c * log2 c) / W."""
    w = cls.window
    chars = F.split(value, "")
    codes = F.transform(chars, lambda c: F.instr(F.lit(cls.alphabet), c) - 1)
    most = F.lit(w * (math.log2(w) - cls.bits))  # largest sum that still reaches the bound

    def weight(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))

    start = F.struct(F.array_repeat(F.lit(0), len(cls.alphabet)).alias("counts"),
                     F.lit(0.0).alias("sum"), F.lit(0).alias("i"),
                     F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(a: Column, pair: Column) -> Column:
        enter, leave = pair["enter"], pair["leave"]
        ce = F.get(a["counts"], enter)
        cl = F.get(a["counts"], leave)
        # the leaving symbol's count after the entering one was added
        cl2 = cl + F.when(leave == enter, 1).otherwise(0)
        total = a["sum"] + weight(ce + 1) - weight(ce) + \
            F.when(leave >= 0, weight(cl2 - 1) - weight(cl2)).otherwise(F.lit(0.0))
        counts = F.transform(a["counts"], lambda c, s: c + F.when(s == enter, 1).otherwise(0)
                             - F.when(s == leave, 1).otherwise(0))
        at = a["i"] + 1 - w
        high = (at >= 0) & (total <= most + 1e-9)
        return F.struct(counts.alias("counts"), total.alias("sum"), (a["i"] + 1).alias("i"),
                        F.when(high & (a["first"] < 0), at).otherwise(a["first"]).alias("first"),
                        F.when(high, at).otherwise(a["last"]).alias("last"))

    pairs = _bound(codes, lambda cs: F.transform(cs, lambda c, i: F.struct(
        c.alias("enter"), F.when(i >= w, F.get(cs, i - w)).otherwise(F.lit(-1)).alias("leave"))))
    return F.aggregate(pairs, start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def _long_enough(found: Column, min_group: int) -> Column:
    return F.filter(found, lambda m: F.length(m["group"]) >= min_group) if min_group else found


def _not_allowed(m: Column, allow: list[str]) -> Column:
    """Pieces (start, value) of a candidate between matches of the allow list."""
    whole = F.struct(m["start"].alias("start"), m["value"].alias("value"))
    if not allow:
        return F.array(whole)
    listed = "|".join(f"(?:{a})" for a in allow)
    cut = F.lit(r"\G([\s\S]*?)(" + listed + r"|\z)")
    pieces = F.zip_with(F.regexp_extract_all(m["value"], cut, F.lit(1)),
                        F.regexp_extract_all(m["value"], cut, F.lit(2)),
                        lambda g, v: F.struct(g.alias("gap"), F.length(v).alias("allowed")))
    placed = _bound(pieces, lambda ps: F.zip_with(
        ps, _prefix_sums(F.transform(ps, lambda x: F.length(x["gap"]) + x["allowed"])),
        lambda x, at: F.struct((m["start"] + at).alias("start"), x["gap"].alias("value"))))
    return F.when(m["value"].rlike(listed), placed).otherwise(F.array(whole))


def _with_entropy(found: Column, cls: EntropyClass, allow: list[str]) -> Column:
    """Pieces of candidates outside the allow list, with their windows."""
    def holds(m: Column) -> Column:
        return m["value"].rlike(cls.needs)

    pieces = F.flatten(F.transform(F.filter(found, holds), lambda m: _not_allowed(m, allow)))
    long = F.filter(pieces, lambda m: (F.length(m["value"]) >= cls.window) & holds(m))
    return F.transform(long, lambda m: F.struct(
        m["start"].alias("start"), _entropy_span(m["value"], cls).alias("at")))


def _entropy_findings(found: Column, kind: int, window: int) -> Column:
    return F.transform(F.filter(found, lambda m: m["at"]["first"] >= 0), lambda m: F.struct(
        (m["start"] + m["at"]["first"]).alias("start"), F.lit(kind).alias("kind"),
        (m["start"] + m["at"]["last"] + window).alias("end")))


def count_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def scan_secrets(df: DataFrame, text: str = "text", base: list[Pattern] | None = None,
                 entropy: list[EntropyClass] | None = None, allow: list[str] | None = None) -> DataFrame:
    """Adds ``base_spans`` and ``spans``: arrays of (start, kind, end) sorted
    by start, then kind in the order listed; ``kind`` is the index in
    ``kinds(base, entropy)``."""
    base = BASE if base is None else base
    entropy = ENTROPY if entropy is None else entropy
    allow = ALLOW if allow is None else allow
    out = df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    own, more = [], []
    for k, p in enumerate(base):
        out = _matches(out, "__t", p.regex, f"__m{k}", 1 if p.min_group else 0)
        own.append(_spans(_long_enough(F.col(f"__m{k}"), p.min_group), k))
    for k, c in enumerate(entropy, len(base)):
        out = _matches(out, "__t", c.regex, f"__m{k}")
        out = out.withColumn(f"__m{k}", _with_entropy(F.col(f"__m{k}"), c, allow))
        more.append(_entropy_findings(F.col(f"__m{k}"), k, c.window))
    out = out.withColumn("base_spans", F.sort_array(F.concat(*own)).cast(SPAN))
    out = out.withColumn("spans", F.sort_array(F.concat("base_spans", *more)).cast(SPAN))
    # as in quality_rules: a generator keeps later filters above the arrays
    columns = [F.col(f"`{c}`") for c in df.columns if c not in ("base_spans", "spans")]
    return out.select(*columns, F.explode(F.array(F.struct("base_spans", "spans"))).alias("__found")) \
        .select(*columns, "__found.*")


def kinds(base: list[Pattern] | None = None, entropy: list[EntropyClass] | None = None) -> list[str]:
    return [p.kind for p in (BASE if base is None else base)] + \
        [c.kind for c in (ENTROPY if entropy is None else entropy)]


def spans_text(spans: Column, names: list[str]) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    table = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(table, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", spans: str = "spans", mask: str = "[SECRET]") -> DataFrame:
    """Replaces the union of all spans by ``mask``; the rest of the text stays.

    Spans are sorted by start: a span opens a new piece if it starts behind
    every earlier end. Pieces are cut from blocks of the text. A null text stays
    null."""
    s, t = F.col(spans), F.col(text)
    out = df.withColumn("__reach", _before(F.transform(s, lambda x: x["end"]), lambda a, x: F.greatest(a, x)))
    out = out.withColumn("__keep", F.filter(
        F.zip_with(s, "__reach", lambda x, r: F.struct(r.alias("from"), x["start"].alias("to"))),
        lambda k, i: (i == 0) | (k["to"] > k["from"])))

    def masked(block: Column) -> Column:
        first = F.get(block, F.lit(0))["from"]
        cut = F.struct(first.alias("from"), block.alias("keep"), F.substring(
            t, first + 1, F.element_at(block, -1)["to"] - first).alias("text"))
        return _bound(cut, lambda c: F.array_join(F.transform(c["keep"], lambda k: F.concat(
            F.substring(c["text"], k["from"] - c["from"] + 1, k["to"] - k["from"]), F.lit(mask))), ""))

    pieces = F.transform(_bound(F.col("__keep"), _in_blocks), masked)
    tail = F.substring(t, F.array_max(F.transform(s, lambda x: x["end"])) + 1, F.length(t))
    return out.withColumn(text, F.when(F.size(s) > 0, F.concat(F.array_join(pieces, ""), tail))
                          .otherwise(t)).drop("__reach", "__keep")
