"""Event sequences in tables, on Spark."""

from .api import explain, match_recognize, parse, sql

__all__ = ["explain", "match_recognize", "parse", "sql"]
