"""``match_recognize``: a statement and a table in, a DataFrame of matches out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import candidates, match, prune
from .plans.ast import ANY, NEXT_MATCH, NEXT_ROW, STRATEGIES, STRICT, Query, QueryError
from .plans.parser import parse


def _assemble(m: DataFrame, q: Query, columns: list[str], ids: bool) -> DataFrame:
    """Measures if there are any, else one struct for each variable."""
    if q.measures:
        out = [F.expr(e.sql(lambda r: f"`{r.var}__{r.column.lower()}`")).alias(name) for name, e in q.measures]
    else:
        out = [F.struct(*[F.col(f"{v}__{c.lower()}").alias(c) for c in columns]).alias(v) for v in q.variables]
    return m.select(*out)


def match_recognize(df: DataFrame, query: str | Query, strategy: str | None = None, prune_mode: str = prune.PREDICATES, preference: str = "first_completed", unit: str = "us", by_window: bool = True, model=None, spread: bool | None = None) -> DataFrame:
    """Matches of ``query`` in ``df``, one row each.  Pruning modes with an order of variables, skips and ranges of time run
    small jobs for counts and bounds when called, and the rest lazily; skips, and ``by_window`` without a partition key, run
    jobs and write intermediate tables when called.

    ``strategy``: any_match (all combinations), next_row (for each head the first completed one; the default),
    next_match (greedy) or strict (adjacent rows, the default for ``PATTERN (A B C)``); without it the statement's
    AFTER MATCH clause decides.  ``prune_mode`` is one of ``prune.MODES``.  ``preference`` is first_completed or
    sql_standard, for next_row.  ``unit`` is that of an integer time column.  ``by_window`` allows the plan without a
    join where the query's variables have no conditions on each other.  ``model`` gates the adaptive mode.  ``spread`` deals
    each partition to ranges of time where a plan works on whole partitions; by default if one of a large table is large.
    """
    q = parse(query) if isinstance(query, str) else query
    skip = q.skip if strategy is None else None
    strategy = strategy or (STRICT if q.contiguous else NEXT_ROW)
    if strategy not in STRATEGIES:
        raise QueryError(f"unknown strategy {strategy!r}")
    if preference not in ("first_completed", "sql_standard"):
        raise QueryError(f"unknown preference {preference!r}")
    if strategy == STRICT and prune_mode == prune.PREDICATES:
        prune_mode = prune.NONE
    prune.allowed(prune_mode, strategy)
    candidates.check(df, q)
    lower = {c.lower(): c for c in df.columns}
    used = [c for v in q.variables for c in q.columns(v)]
    names = list(dict.fromkeys(lower[c.lower()] for c in used)) if q.measures else df.columns
    ties = candidates.n_ties(df, q)
    greedy = strategy == NEXT_MATCH or (strategy == NEXT_ROW and preference == "first_completed")
    if strategy == STRICT:
        out = match.strict(df, q, ties, unit, names, match.has_hot_partition(df, q) if spread is None else spread)
    elif by_window and greedy and not q.dependent and not q.partition_by and len(q.variables) > 1 and prune_mode in (prune.NONE, prune.PREDICATES):
        out = match.next_by_ranges(df, q, ties, unit, names)
    elif by_window and greedy and not q.dependent and q.partition_by and prune_mode in (prune.NONE, prune.PREDICATES):
        out = match.next_by_window(df, q, ties, unit, names, match.has_hot_partition(df, q) if spread is None else spread)
    else:
        cands = candidates.split(df, q, unit, whole=not q.measures)
        counts = candidates.counts(df, q) if prune_mode in (prune.JOIN, prune.SEQUENTIAL, prune.SLICED, prune.DUAL, prune.ADAPTIVE) else None
        cands = prune.reduce_candidates(cands, q, prune_mode, ties, counts, model)
        if strategy == ANY:
            out = match.any_match(cands, q, ties)
        elif strategy == NEXT_MATCH or (not q.dependent and preference == "first_completed"):
            out = match.next_match(cands, q, ties)
        else:
            out = match.next_row(cands, q, ties, preference)
    if skip in ("past_last_row", "to_last"):
        out = match.without_overlap(out, q, ties, skip == "to_last")
    return _assemble(out, q, names, False)


def sql(spark: SparkSession, statement: str, **options) -> DataFrame:
    """Run a statement over a table or view of the session."""
    q = parse(statement)
    return match_recognize(spark.table(q.table), q, **options)


def explain(statement: str) -> str:
    """The chain of states of a statement."""
    return parse(statement).describe()


__all__ = ["ANY", "NEXT_MATCH", "NEXT_ROW", "STRICT", "explain", "match_recognize", "parse", "sql"]
