"""Candidate rows: which rows of a table can be which variables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import micros
from ..plans.ast import Query, QueryError


def filter_conditions(q: Query, var: str) -> Column:
    """All conditions on one variable alone, as they reach the file scan."""
    parts = [p.expr.sql(lambda r: f"`{r.column}`") for p in [*q.constant, *q.independent(var)]]
    return F.expr(" AND ".join(f"({p})" for p in parts)) if parts else F.lit(True)


def own_conditions(q: Query, var: str) -> Column:
    """The same as a flag: null counts as false."""
    return F.coalesce(filter_conditions(q, var), F.lit(False))


def any_variable(q: Query, variables: list[str] | None = None) -> Column:
    return reduce(lambda a, b: a | b, [filter_conditions(q, v) for v in variables or q.variables])


def check(df: DataFrame, q: Query) -> None:
    """Fail early on columns that are not there."""
    have = {c.lower() for c in df.columns}
    used = {q.time, *q.ties, *q.partition_by} | {r.column for p in q.all_predicates for r in p.expr.refs} | {r.column for _, e in q.measures for r in e.refs}
    if missing := sorted(c for c in used if c.lower() not in have):
        raise QueryError(f"no such column: {', '.join(missing)}")


def scan(df: DataFrame, q: Query) -> DataFrame:
    """Rows that can be some variable.  The disjunction reaches the file scan."""
    return df.where(any_variable(q))


def classify(df: DataFrame, q: Query, filtered: bool = True) -> DataFrame:
    """One pass: rows with a flag ``is_x`` for each variable; a row may be several."""
    rows = scan(df, q) if filtered else df
    return rows.withColumns({f"is_{v.lower()}": own_conditions(q, v) for v in q.variables})


def tie_columns(df: DataFrame, q: Query) -> list[Column]:
    """What puts rows of one time in order: the declared columns, else a hash of the whole row."""
    return [F.col(f"`{c}`") for c in q.ties] or [F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])]


def split(df: DataFrame, q: Query, unit: str = "us", whole: bool = True, filtered: bool = True) -> dict[str, DataFrame]:
    """One frame for each variable, its columns named ``X__column``: those that the query uses, or the whole row;
    ``X__t`` (time in microseconds), ``X__o0``, ... (ties) and ``__p0``, ... (partition)."""
    check(df, q)
    t, ties = micros(df, q.time, unit), tie_columns(df, q)
    lower = {c.lower(): c for c in df.columns}
    out = {}
    for v in q.variables:
        names = df.columns if whole else [lower[c.lower()] for c in q.columns(v)]
        rows = df.where(filter_conditions(q, v)) if filtered else df
        rows = rows.where(t.isNotNull())
        out[v] = rows.select(
            *[F.col(f"`{c}`").alias(f"__p{i}") for i, c in enumerate(q.partition_by)],
            t.alias(f"{v}__t"),
            *[c.alias(f"{v}__o{i}") for i, c in enumerate(ties)],
            *[F.col(f"`{c}`").alias(f"{v}__{c.lower()}") for c in dict.fromkeys(names)],
        )
    return out


def n_ties(df: DataFrame, q: Query) -> int:
    return max(1, len(q.ties))


def cardinality(df: DataFrame, q: Query) -> DataFrame:
    """One row: the number of candidates of each variable, in one pass."""
    return classify(df, q).agg(*[F.count_if(F.col(f"is_{v.lower()}")).alias(f"n_{v.lower()}") for v in q.variables])


def counts(df: DataFrame, q: Query) -> dict[str, int]:
    row = cardinality(df, q).first()
    return {v: row[f"n_{v.lower()}"] for v in q.variables}


def rename(names: Mapping[str, str], df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(dict(names))
