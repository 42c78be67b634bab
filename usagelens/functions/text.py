"""Scalar text / number / date functions (F1-F17) as Column builders.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the term scan (must match the study's scanner):
# an identifier is a maximal run of ASCII letters, digits and underscores.
IDENTIFIER = "[A-Za-z0-9_]+"
# line terminators recognised when a file is split into lines
LINE_BREAK = "\r\n|\n|\r"
# prefix of the compiler functions the study mines
TERM_PREFIX = "__builtin_"
# names that the documentation extraction looks for
DOC_NAME = "__builtin[a-zA-Z_0-9]*"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def identifiers(col) -> Column:
    """every identifier bounded by non-identifier characters, in order."""
    return F.regexp_extract_all(_c(col), F.lit(IDENTIFIER), F.lit(0))


def split_lines(col) -> Column:
    """S2 helper: split on CRLF / LF / CR; a final terminator makes no extra line."""
    parts = F.split(_c(col), LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)) \
        .otherwise(parts)


def base_name(col) -> Column:
    """last path component."""
    return F.element_at(F.split(_c(col), "/"), -1)


def strip_all(col, substrings: list[str]) -> Column:
    """remove every occurrence of each substring, in the given order."""
    out = _c(col)
    for s in substrings:
        out = F.replace(out, F.lit(s), F.lit(""))
    return out


# Parts removed from a documentation section header.
HEADER_NOISE = ["through Built-in Functions", "Built-in Functions", "Intrinsics"]


def short_header(col) -> Column:
    """documentation section header without the common noise words."""
    return strip_all(col, HEADER_NOISE)


def first_line(col) -> Column:
    """text up to the first newline."""
    return F.substring_index(_c(col), "\n", 1)


def metric_suffix(col) -> Column:
    """a category turned into a metric-name suffix: digits and '-' removed."""
    return F.regexp_replace(_c(col), "[0-9-]", "")


def label_suffix(col) -> Column:
    """F5 for labels: remove spaces and commas, spell the digit 5."""
    return F.replace(F.regexp_replace(_c(col), "[ ,]", ""), F.lit("5"), F.lit("five"))


def remove_suffix(col, suffix: str) -> Column:
    """remove a literal suffix (not a character set)."""
    return F.regexp_replace(_c(col), re.escape(suffix) + "$", "")


# Fixed value: project URL layout of the hosting site the projects come from.
REPO_URL = r"^https://github\.com/([^/]+)/([^/]+)$"


def url_owner(col) -> Column:
    """owner part of a repository URL, NULL when the URL is malformed."""
    return F.when(_c(col).rlike(REPO_URL), F.regexp_extract(_c(col), REPO_URL, 1))


def url_name(col) -> Column:
    """repository name of a repository URL, NULL when malformed."""
    return F.when(_c(col).rlike(REPO_URL), F.regexp_extract(_c(col), REPO_URL, 2))


def natural_join(arr) -> Column:
    """F8: ['a','b','c'] -> 'a, b, and c' (single element: itself)."""
    a = _c(arr)
    n = F.size(a)
    head = F.array_join(F.slice(a, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n <= 1, F.element_at(a, 1)).otherwise(
        F.concat(head, F.lit(", and "), F.element_at(a, -1)))


def idiv(col, d) -> Column:
    """integer division (truncating) of integers, as `div` in SQL."""
    return F.call_function("div", _c(col).cast("long"), F.lit(d) if isinstance(d, int) else _c(d))


def sign_symbol(col) -> Column:
    """+1 -> '+', -1 -> '-'."""
    return F.when(_c(col) > 0, "+").when(_c(col) < 0, "-")


def format_metric(col, percentage: bool = False) -> Column:
    """thousands separators, no decimals, optional '%' suffix."""
    s = F.format_number(_c(col).cast("double"), 0)
    return F.concat(s, F.lit("%")) if percentage else s


def log_band(col, half_width: float = 0.5):
    """half-decade band around v: 10^(log10(v+1) -/+ w) - 1."""
    lv = F.log10(_c(col) + 1)
    return (F.pow(F.lit(10.0), lv - half_width) - 1, F.pow(F.lit(10.0), lv + half_width) - 1)


def prefix_list(col, prefix: str = TERM_PREFIX) -> Column:
    """'a, b' -> [prefix||'a', prefix||'b'] (spaces removed)."""
    parts = F.split(F.replace(_c(col), F.lit(" "), F.lit("")), ",")
    return F.transform(parts, lambda e: F.concat(F.lit(prefix), e))


def drop_marker(col) -> Column:
    """F16: line of a diff without its leading marker character."""
    return F.substring(_c(col), 2, 1 << 30)


def relative_path(col, root_len: int) -> Column:
    """F16: path relative to a root of the given length (plus separator)."""
    return F.substring(_c(col), root_len + 2, 1 << 30)


def epoch_to_ts(col) -> Column:
    """epoch seconds -> timestamp (session time zone UTC)."""
    return F.timestamp_seconds(_c(col))


def date_to_epoch(col) -> Column:
    """date -> epoch seconds at UTC midnight."""
    return F.unix_timestamp(F.to_timestamp(_c(col)))
