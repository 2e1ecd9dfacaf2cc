"""Scalar helpers: time in microseconds, rendering, value buckets, hashes, and arithmetic as in fixed-width engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PER_UNIT = {"s": 1_000_000, "ms": 1_000, "us": 1}


def micros(df: DataFrame, column: str, unit: str = "us") -> Column:
    """A time column as whole microseconds: timestamps of either kind, dates, or integers of the given unit."""
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.IntegralType):
        return c.cast("long") * F.lit(PER_UNIT[unit])
    raise TypeError(f"{column} is a {kind.simpleString()}, not a time")


def record(*columns: str) -> Column:
    """A row as text: its columns joined by commas; nulls are empty."""
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def value_bucket(column: str | Column, low: float, width: float) -> Column:
    """Number of the bucket of ``width`` from ``low`` that a value falls in."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor((c - F.lit(low)) / F.lit(width)).cast("long")


def hash64(*columns: str, seed: int | None = None) -> Column:
    """64-bit xxHash of columns; a seed makes an independent function."""
    return F.xxhash64(*([F.lit(seed)] if seed is not None else []), *columns)


def hash32(*columns: str) -> Column:
    """32-bit Murmur3 of columns."""
    return F.hash(*columns)


def linear_hash(column: str, a: int = 2_654_435_761, b: int = 12_345, m: int = 4_294_967_296) -> Column:
    """``(a * x + b) mod m`` on whole numbers."""
    return F.pmod(F.pmod(F.col(column), F.lit(m)).cast("decimal(38,0)") * F.lit(a) + F.lit(b), F.lit(m)).cast("long")


def fixed_width(value: Column, op: str, constant: float, kind: T.DataType) -> Column:
    """``value op constant`` computed in double and put back into the column's type: whole numbers are cut toward
    zero, floats rounded to single precision.  Division by zero gives null."""
    d, c = value.cast("double"), F.lit(float(constant))
    out = {"+": d + c, "-": d - c, "*": d * c}.get(op)
    if out is None:
        out = F.when(c != 0, d / c)
    return out.cast(kind)
