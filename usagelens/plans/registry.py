"""All registered queries and their oracle statements."""

from . import (oracle, oracle_history, oracle_misc, oracle_support, queries,  # noqa: F401
               queries_history, queries_misc, queries_support)

QUERIES = queries.QUERIES
ORACLE = oracle.ORACLE
