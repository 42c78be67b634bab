"""usagelens: a PySpark-native engine for mining how named terms are used
across large collections of text projects (scan, exclusion, usage tables,
history series, ratings, support curves, sample coverage)."""

__version__ = "0.1.0"
