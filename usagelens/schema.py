"""Typed schemas of the tables the engine works on.

The source data of a usage study is a set of flat relational tables; every
column gets a pinned Spark type here so that sources, fixtures and tests agree.
"""

from __future__ import annotations

from pyspark.sql import types as T

L, S, I, B, D = T.LongType(), T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


PROJECTS = _struct(
    ("id", L), ("owner", S), ("name", S), ("url", S), ("stars", I), ("forks", I),
    ("loc_c", L), ("loc_h", L), ("loc_cpp", L), ("loc_asm", L), ("commits", I),
    ("committers", I), ("first_commit", T.DateType()), ("last_commit", T.DateType()),
    ("processed", B), ("history_checked", B),
)

TERMS = _struct(
    ("id", L), ("name", S), ("category", S), ("machine_specific", B), ("doc_url", S),
    ("header", S), ("documented", B),
)

EXCLUDED_TERMS = _struct(("name", S), ("reason", S))
SYNONYMS = _struct(("name", S), ("synonym", S))

# one row per source file: the input of the term scan
SOURCE_FILES = _struct(("project_id", L), ("path", S), ("content", S))

LINES = _struct(("project_id", L), ("path", S), ("line_nr", I), ("line", S))

USAGES = _struct(
    ("project_id", L), ("path", S), ("line_nr", I), ("line", S), ("term_id", L),
    ("excluded", B),
)

EXCLUDED_FRAGMENTS = _struct(("line", S), ("term_id", L), ("category", S))

COMMITS = _struct(
    ("project_id", L), ("hash", S), ("message", S), ("ts_unix", L), ("author", S),
    ("email", S), ("commit_nr", I), ("parents", T.ArrayType(S)),
)

COMMIT_DELTAS = _struct(
    ("hash", S), ("event", S), ("path", S), ("delta", I), ("line", S), ("line_nr", I),
    ("term_id", L), ("project_id", L),
)

# one row per (commit, file, change type) with the unified diff text of the file
FILE_DIFFS = _struct(
    ("project_id", L), ("hash", S), ("change_type", S), ("old_path", S), ("new_path", S),
    ("diff", S),
)

RATINGS = _struct(("project_id", L), ("label", S), ("user", S))
