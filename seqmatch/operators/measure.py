"""What looking up, building and matching a row cost in this session, for the adaptive pruning."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cost import Constant
from . import intervals as iv


def _seconds(df: DataFrame) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def measured(spark: SparkSession, rows: int = 500_000, window_us: int = 1_000_000) -> Constant:
    """A cost model from five timed jobs over ``rows`` generated rows: nanoseconds for each row, cores counted as one.

    The time of reading the rows alone is taken off; each cost is one nanosecond at least."""
    events = spark.range(rows).select((F.col("id") * 1000).alias("t"), (F.xxhash64("id") % 1000).alias("k"))
    few = events.where("t % 10000 = 0")
    _seconds(events)
    base = _seconds(events)
    times = iv.slice_set(iv.replay(few, "t", window_us, "head"), window_us)
    keys = iv.pair_set(few, "t", F.col("k"), window_us)
    build, keyed_build = _seconds(times), _seconds(keys)
    look = _seconds(iv.slice_filter(events, "t", times, window_us)) - build
    keyed_look = _seconds(iv.keyed_filter(events, "t", F.col("k"), keys, window_us)) - keyed_build
    near = events.withColumn("w", F.floor(F.col("t") / F.lit(window_us)))
    other = few.select(F.col("t").alias("u"), F.col("k").alias("l"), F.floor(F.col("t") / F.lit(window_us)).alias("w"))
    match = _seconds(near.join(other.hint("merge"), "w").where("u > t and k = l").select("t"))
    each = lambda seconds, n: max(1.0, (seconds - base) / n * 1e9)
    return Constant(each(look + base, rows), each(keyed_look + base, rows), each(keyed_build, rows // 10), each(build, rows // 10), each(match, rows))
