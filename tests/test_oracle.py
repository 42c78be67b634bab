"""Registered queries against their DuckDB oracle at sf0.001."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
CHECK = ["top_terms", "exclusion_shares", "sync_manual", "term_counts", "usage_distribution_unique",
         "top_file_names", "boxplot_summary", "commit_net", "trend_rules", "resolve_ratings",
         "decision_summary", "support_by_frequency", "support_greedy", "coverage_score",
         "first_parent_chain", "diff_deltas"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", CHECK)
def test_query_matches_oracle(spark, duck, name):
    got = E.queries()[name](spark, SF001).toPandas()
    exp = duck.execute(E.oracle_sql()[name]).df()
    assert _rows(got) == _rows(exp)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "term_name" in df.columns
