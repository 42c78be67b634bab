"""Quality rules as one projection (operator 1).

A rule is a row of a threshold table: (name, metric, comparison, threshold).
``compile_rules`` turns the table into boolean columns over metrics that are
built-in Spark expressions, so a filter is one projection of one scan: no
shuffle, no user function, any text length.

Words are runs of characters other than space and ``\\t \\n \\v \\f \\r``.
Repeated windows of three words are decided by their text; a hash only
preselects positions.

Edge cases: a null or empty text has no words, every count is 0, and it fails
``min_words``; repeated rows are judged alike; an empty table gives an empty
result; input columns that clash with result names are replaced.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD_GAP

GAP_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    name: str
    metric: str
    fails_if: str  # "<" or ">"
    threshold: float


# Base rules fix ``base_failed``; integer arithmetic keeps the bound exact.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Frequent function words; a text in any of these languages holds several.
STOP_WORDS = {
    "en": "the of and to in a is that it for on as with was at by this be are from or an".split(),
    "de": "der die das und in zu den von mit ist im des ein eine nicht auf für sich dem auch".split(),
    "fr": "le la les de des du et en un une que qui dans pour par sur au avec pas est il elle".split(),
    "es": "el la los las de del y en un una que por con para se su no es al lo como más".split(),
}

DEFAULT_RULES = [
    Rule("min_mean_word", "mean_word_chars", "<", 2.0),
    Rule("max_mean_word", "mean_word_chars", ">", 20.0),
    Rule("max_symbols_per_word", "symbols_per_word", ">", 0.30),
    Rule("max_dup_line_share", "dup_line_share", ">", 0.50),
    Rule("min_stop_words", "stop_word_share", "<", 0.02),
]


RESULT_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words",
                  "mean_word_chars", "symbols_per_word", "dup_line_share", "stop_word_share",
                  "base_failed", "failed_rules", "kept")


def _ratio(a: str, b: str) -> Column:
    """a / b, 0 for an empty denominator."""
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def _only(text: Column, keep: str) -> Column:
    """Number of characters of ``text`` in the character class ``keep``."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")


def with_repeated_window_words(df: DataFrame, words: str, name: str) -> DataFrame:
    """Adds the number of words inside three-word windows that occur at least
    twice in the array column ``words``, the first occurrence included.

    Window hashes are sorted with their positions, so repeats are neighbours:
    n log n per text, whatever its length. Hashes only select positions that
    may repeat; those are sorted again by the window's text and compared by it.
    Each step is its own column, so that no array is built twice.
    """
    w, h = F.col(words), F.col("__hashes")
    window = F.struct(F.lit("").alias("w"), F.lit(0).alias("i"))
    out = df.withColumn("__hashes", F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
                        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    out = out.withColumn("__placed", F.when(
        F.size(F.array_distinct(h)) < F.size(h),
        F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("w"), i.alias("i")))))
        .otherwise(F.array(F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).alias("i")))))

    def repeats(name: str) -> Column:
        s = F.col(name)
        return F.filter(s, lambda x, j: (x["w"] == F.get(s, j - 1)["w"]) | (x["w"] == F.get(s, j + 1)["w"]))

    out = out.withColumn("__texts", F.coalesce(F.sort_array(F.transform(
        repeats("__placed"), lambda x: F.struct(
            F.concat_ws(" ", F.get(w, x["i"]), F.get(w, x["i"] + 1), F.get(w, x["i"] + 2)).alias("w"),
            x["i"].alias("i")))), F.filter(F.array(window), lambda x: F.lit(False))))
    out = out.withColumn("__starts", F.sort_array(F.transform(repeats("__texts"), lambda x: x["i"])))
    s = F.col("__starts")
    # a start covers three words, or those up to the next start
    out = out.withColumn(name, F.aggregate(
        F.transform(s, lambda p, j: F.least(F.coalesce(F.get(s, j + 1) - p, F.lit(3)), F.lit(3))),
        F.lit(0).cast("long"), lambda acc, x: acc + x))
    return out.drop("__hashes", "__placed", "__texts", "__starts")


def with_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the metric columns that rules refer to."""
    out = df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({
        "__words": F.filter(F.split("__t", WORD_GAP), lambda w: w != ""),
        "__lines": F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    out = with_repeated_window_words(out, "__words", "n_repeat_words")
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    out = out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": _only(F.col("__t"), SYMBOLS),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_stop_words": F.size(F.filter("__words", lambda w: F.lower(w).isin(stop))).cast("long"),
    })
    out = out.withColumns({
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "dup_line_share": _ratio("n_dup_lines", "n_lines"),
        "stop_word_share": _ratio("n_stop_words", "n_words"),
    })
    return out.drop("__t", "__words", "__lines")


def compile_rules(rules: list[Rule]) -> Column:
    """Array of the names of the failed rules."""
    checks = [F.when(F.col(r.metric) < r.threshold if r.fails_if == "<" else
                     F.col(r.metric) > r.threshold, F.lit(r.name)) for r in rules]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def quality_rules(df: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """Adds metrics, ``base_failed``, ``failed_rules`` and ``kept``."""
    out = with_metrics(df, text)
    out = out.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) |
                       (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        "failed_rules": compile_rules(DEFAULT_RULES if rules is None else rules),
    })
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    added = [c for c in out.columns if c not in df.columns or c in RESULT_COLUMNS]
    # A filter on the results must not be pushed into the projection, where it
    # would repeat the expressions of all arrays; a generator stops it.
    row = F.explode(F.array(F.struct(*added))).alias("__judged")
    given = [F.col(f"`{c}`") for c in df.columns if c not in added]
    return out.select(*given, row).select(*given, "__judged.*")
