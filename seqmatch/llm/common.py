"""Shared helpers: tables, the shared folder, and text buffers of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialize, new_path, shared_dir

__all__ = ["bitmap", "blocks", "free_names", "hash128", "materialize", "may_be_in", "new_path", "shared_dir", "small_batches", "table", "text_buffer", "without"]
WORDS = 1 << 18
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on Arrow batches that go to Python hold ``most`` bytes and a row more at most, in all queries of this session.

    Spark's own bounds are 10,000 rows and 64 MB.  Each task holds several copies of a batch of texts beside the JVM's heap,
    in the JVM and in Python.  Results are lazy, so the setting stays; a smaller one of the session's own is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now > most:
        spark.conf.set(key, str(most))


def hash128(*cols: Column | str) -> list[Column]:
    """Two independent 64-bit hashes of the same columns; as a pair they serve as a 128-bit key."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)]


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator adds itself (names compare as Spark compares them)."""
    mine = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in mine])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def bitmap(hashes: DataFrame) -> DataFrame:
    """(word, bits): a bitmap of the 64-bit hashes ``h``, at most WORDS rows however many there are."""
    return materialize(hashes.groupBy(_word("h").alias("word")).agg(F.bit_or(_bit("h")).alias("bits")), "bitmap")


def _word(h: str) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 6), F.lit(WORDS)).cast("int")


def _bit(h: str) -> Column:
    return F.expr(f"shiftleft(1L, cast({h} & 63 as int))")


def may_be_in(rows: DataFrame, h: str, marks: DataFrame, name: str) -> DataFrame:
    """Add the boolean column ``name``: false only where the hash ``h`` is none of the bitmap's.

    The bitmap is broadcast: its bound is WORDS rows of 12 bytes.  Most rows of a corpus are none of those looked for,
    and so stay where they are; where the bitmap is full, all rows go the way of those that may be in it."""
    word, bits = free_names(rows, "__word", "__bits")
    marks = marks.select(F.col("word").alias(word), F.col("bits").alias(bits))
    return rows.join(F.broadcast(marks), _word(f"`{h}`") == F.col(word), "left").withColumn(name, F.coalesce(F.col(bits).bitwiseAND(_bit(f"`{h}`")) != 0, F.lit(False))).drop(word, bits)


def text_buffer(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of an Arrow string or binary array, without copies; nulls are empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        values = values.fill_null("" if not pa.types.is_binary(values.type) else b"")
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at.astype(np.int64)


def blocks(at: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows whose bytes sum to ``most`` or less; a longer row is a block of its own."""
    out, first, n = [], 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        out.append((first, last))
        first = last
    return out
