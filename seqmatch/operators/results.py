"""What can be done with matches: text, counts, the rows that take part; and small operations on lists of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import record


def as_text(matches: DataFrame, variables: list[str], columns: list[str]) -> DataFrame:
    """One column ``match``: the rows of a match joined by a bar, each its columns joined by commas."""
    return matches.select(F.concat_ws("|", *[record(*[f"{v}.{c}" for c in columns]) for v in variables]).alias("match"))


def projected(matches: DataFrame, variables: list[str], columns: list[str]) -> DataFrame:
    """Distinct rows that are one of these variables in some match."""
    parts = [matches.select(*[F.col(f"{v}.{c}").alias(c) for c in columns]) for v in variables]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def participation(matches: DataFrame, variables: list[str], key: str) -> DataFrame:
    """(variable, n_rows): how many different rows take part as each variable."""
    pairs = matches.select(F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"{v}.{key}").alias("key")) for v in variables])).alias("x")).select("x.*")
    return pairs.distinct().groupBy("variable").agg(F.count("key").alias("n_rows"))


def merge(a: DataFrame, b: DataFrame, distinct: bool = False) -> DataFrame:
    """Rows of both lists; ``distinct`` leaves one of each set of equal rows."""
    both = a.unionByName(b)
    return both.distinct() if distinct else both


def merge_flags(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Candidates of two lists with a row's flags joined by OR."""
    flags = [c for c in a.columns if c.startswith("is_")]
    rest = [c for c in a.columns if c not in flags and c not in key]
    return a.unionByName(b).groupBy(*key).agg(*[F.first(c).alias(c) for c in rest], *[F.bool_or(c).alias(c) for c in flags]).select(*a.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def pages(df: DataFrame):
    """Rows one after the other, a partition at a time, for callers that page through a result."""
    return df.toLocalIterator(prefetchPartitions=True)
