"""URL allow / block rules in a trie (operator 10).

A rule is (action, host, path prefix). The trie is keyed by the reversed host
labels; every host node holds a second trie over path segments. A rule fits
its host and all subdomains if the url's path starts with the rule's path. Of
all fitting rules the one with the most host labels wins, then the longest
path; on a full tie ``block`` wins over ``allow``.

The rule table is broadcast after its size is checked against
``MAX_RULE_BYTES``. A larger table is split into blocks of at most that size;
every block is matched in one pass and the longest match of all blocks wins,
so no rule is dropped.

Edge cases: a null url or one without ``://`` has empty host and path and
fits no rule with a host; repeated urls are judged alike; extra columns pass
through unless they clash with the result's names (then the result's replace
them); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

MAX_RULE_BYTES = 64 << 20
UNMATCHED = "allow"


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


class _Node:
    __slots__ = ("children", "paths")

    def __init__(self):
        self.children: dict[str, _Node] = {}
        self.paths: _PathNode | None = None


class _PathNode:
    """``tails`` are rule ends inside a segment ('' = at the segment's start)."""

    __slots__ = ("children", "tails")

    def __init__(self):
        self.children: dict[str, _PathNode] = {}
        self.tails: dict[str, Rule] = {}


class RuleTrie:
    """Longest-match lookup of a rule for (host, path)."""

    def __init__(self, rules: Iterable[Rule]):
        self.root = _Node()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.children.setdefault(label, _Node())
            node.paths = node.paths or _PathNode()
            at = node.paths
            *segments, tail = rule.path.split("/")
            for segment in segments:
                at = at.children.setdefault(segment, _PathNode())
            old = at.tails.get(tail)
            if old is None or rule.action == "block":
                at.tails[tail] = rule

    def find(self, host: str, path: str) -> Rule | None:
        """The fitting rule with the most host labels, then longest path."""
        fitting, node = [], self.root
        for label in reversed(host.split(".")):
            node = node.children.get(label)
            if node is None:
                break
            if node.paths is not None:
                fitting.append(node.paths)
        segments = path.split("/")
        for at in reversed(fitting):
            found = None
            for k, segment in enumerate(segments):
                tails = [t for t in at.tails if segment.startswith(t)]
                if tails:
                    found = at.tails[max(tails, key=len)]
                if k == len(segments) - 1:  # no '/' follows the last segment
                    break
                at = at.children.get(segment)
                if at is None:
                    break
            if found is not None:
                return found
        return None


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/ ? #`` or end, A-Z lower-cased."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """Text after the host up to ``? #`` or end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_blocks(rules: Iterable[Rule], max_bytes: int = MAX_RULE_BYTES) -> Iterator[list[Rule]]:
    block, size = [], 0
    for rule in rules:
        n = len(rule.host) + len(rule.path)
        if block and size + n > max_bytes:
            yield block
            block, size = [], 0
        block.append(rule)
        size += n
    if block:
        yield block


_FOUND = T.StructType([
    T.StructField("action", T.StringType()), T.StructField("rule", T.StringType()),
    T.StructField("labels", T.IntegerType()), T.StructField("length", T.IntegerType())])


def _matcher(spark, rules: list[Rule]):
    table = spark.sparkContext.broadcast([tuple(r) for r in rules])
    built: list[RuleTrie] = []  # once per worker

    @F.pandas_udf(_FOUND)
    def match(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        if not built:
            built.append(RuleTrie(Rule(*r) for r in table.value))
        rows = []
        for h, p in zip(host, path):
            r = built[0].find(h, p)
            rows.append((None, None, -1, -1) if r is None else
                        (r.action, r.name, len(r.host.split(".")), len(r.path)))
        return pd.DataFrame(rows, columns=["action", "rule", "labels", "length"])

    return match


def judge_urls(df: DataFrame, rules: Iterable[Rule], url: str = "url",
               unmatched: str = UNMATCHED, max_rule_bytes: int = MAX_RULE_BYTES) -> DataFrame:
    """Adds host, path, rule (null if none fits) and verdict to ``df``."""
    out = df.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    best = []
    for block in rule_blocks(rules, max_rule_bytes):
        m = _matcher(df.sparkSession, block)(F.col("host"), F.col("path"))
        # ordered by the precedence: labels, path length, block before allow
        best.append(F.struct(m["labels"].alias("labels"), m["length"].alias("length"),
                             F.coalesce(m["action"] == "block", F.lit(False)).alias("block"),
                             m["rule"].alias("rule"), m["action"].alias("action")))
    if not best:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(unmatched)})
    out = out.withColumn("__found", F.greatest(*best) if len(best) > 1 else best[0])
    return out.withColumns({
        "rule": F.col("__found.rule"),
        "verdict": F.coalesce(F.col("__found.action"), F.lit(unmatched)),
    }).drop("__found")
