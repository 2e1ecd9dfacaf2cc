"""Tables in and out: column definitions, CSV to Parquet, query files."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_KINDS = {"INT": T.IntegerType(), "LONG": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "BIGINT": T.LongType(), "STRING": T.StringType(), "TIMESTAMP": T.TimestampType()}


def parse_ddl(statement: str, time: str | None = "eventTime") -> tuple[str, T.StructType]:
    """``CREATE TABLE name (column type, ...)`` as a name and a schema.  VARCHAR(n) is a string of any length.

    Names keep their case.  A table without the column ``time`` is refused; None allows it."""
    m = re.fullmatch(r"\s*CREATE\s+TABLE\s+(\w+)\s*\((.*)\)\s*;?\s*", statement, re.IGNORECASE | re.DOTALL)
    if not m:
        raise ValueError("not a CREATE TABLE statement")
    fields = []
    for part in re.split(r",(?![^(]*\))", m[2]):
        words = part.split(None, 1)
        if len(words) != 2:
            raise ValueError(f"column {part.strip()!r}")
        name, kind = words[0].strip("`\""), words[1].strip().upper()
        if re.fullmatch(r"VARCHAR\s*\(\s*\d+\s*\)|VARCHAR", kind):
            fields.append(T.StructField(name, T.StringType()))
        elif kind in _KINDS:
            fields.append(T.StructField(name, _KINDS[kind]))
        else:
            raise ValueError(f"type {kind} of {name}")
    if time and time.lower() not in {f.name.lower() for f in fields}:
        raise ValueError(f"no time column {time}")
    return m[1], T.StructType(fields)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Lines with the schema's columns; a line with another number of them is an error."""
    return spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(path)


def csv_to_parquet(spark: SparkSession, path: str, out: str, schema: T.StructType, mode: str = "error", sort_by: str | None = None) -> None:
    """Load CSV into a columnar table; ``sort_by`` keeps times of a file close, so that scans can skip row groups."""
    df = read_csv(spark, path, schema)
    (df.sortWithinPartitions(sort_by) if sort_by else df).write.mode(mode).parquet(out)


def append(df: DataFrame, out: str) -> None:
    df.write.mode("append").parquet(out)


def read_queries(lines: Iterator[str] | str) -> list[str]:
    """Statements of a query file; each ends in the line that has a semicolon."""
    out, now = [], []
    for line in lines.splitlines() if isinstance(lines, str) else lines:
        now.append(line.rstrip("\n"))
        if ";" in line:
            out.append("\n".join(now).strip())
            now = []
    return out
