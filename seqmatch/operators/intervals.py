"""Sets of closed time intervals [start, end] in microseconds, optionally for each key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 20


def offsets(marker: str, window: int) -> tuple[int, int]:
    """Where the rest of a match can lie around a row: after a head, before a tail, on both sides of the others."""
    return {"head": (0, window), "tail": (-window, 0)}.get(marker, (-window, window))


def replay(rows: DataFrame, time: str, window: int, marker: str, keys: list[str] | None = None) -> DataFrame:
    """The interval of each row, not yet merged."""
    low, high = offsets(marker, window)
    return rows.select(*(keys or []), (F.col(time) + F.lit(low)).alias("start"), (F.col(time) + F.lit(high)).alias("end"))


def coalesce(intervals: DataFrame, keys: list[str] | None = None, bucket: int = 3_600_000_000) -> DataFrame:
    """Merge intervals that overlap or share an end.

    Sorting is within buckets of start time.  What reaches a bucket from earlier ones, and how many merged intervals
    came before it, are running values over one row for each bucket, so no task sorts all intervals."""
    keys = keys or []
    rows = intervals.withColumn("__b", F.floor(F.col("start") / F.lit(bucket)))
    per_bucket = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "__b").orderBy("start", "end")
    reach = rows.groupBy(*keys, "__b").agg(F.max("end").alias("__top")).withColumn("__reach", F.max("__top").over(per_bucket)).drop("__top")
    rows = _same(rows, reach, keys)
    before = F.greatest(F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("__reach"))
    rows = rows.withColumn("__new", F.when(F.col("start") <= before, 0).otherwise(1))
    rows = rows.withColumn("__at", F.sum("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    base = rows.groupBy(*keys, "__b").agg(F.sum("__new").alias("__k")).withColumn("__base", F.coalesce(F.sum("__k").over(per_bucket), F.lit(0))).drop("__k")
    rows = _same(rows, base, keys)
    return rows.groupBy(*keys, (F.col("__at") + F.col("__base")).alias("__island")).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def _same(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    names = {c: f"__r_{c}" for c in [*keys, "__b"]}
    side = side.withColumnsRenamed(names)
    on = F.col("__b") == F.col("__r___b")
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(names[c]))
    return rows.join(_unsent(side, keys), on).drop(*names.values())


def union(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return coalesce(a.unionByName(b), keys)


def _buckets(start: str, end: str, width: int) -> Column:
    return F.explode(F.sequence(F.floor(F.col(start) / F.lit(width)), F.floor(F.col(end) / F.lit(width))))


def _unsent(side: DataFrame, keys: list[str]) -> DataFrame:
    """Keep a set of many keys from being broadcast: Spark guesses its size from the table's before each interval is
    repeated in every bucket or slice, or from a shuffle's before windows widen it, and the driver would have to hold
    all of that."""
    return side.hint("merge") if keys else side


def intersect(a: DataFrame, b: DataFrame, keys: list[str] | None = None, width: int = 3_600_000_000) -> DataFrame:
    """Common parts of two merged sets; a pair is made in the bucket where its common part begins."""
    keys = keys or []
    left = a.withColumn("__b", _buckets("start", "end", width))
    right = b.withColumnsRenamed({"start": "__s", "end": "__e", **{k: f"__r_{k}" for k in keys}}).withColumn("__b", _buckets("__s", "__e", width)).withColumnRenamed("__b", "__rb")
    start, end = F.greatest("start", "__s"), F.least("end", "__e")
    on = (F.col("__b") == F.col("__rb")) & (start <= end) & (F.floor(start / F.lit(width)) == F.col("__b"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(_unsent(right, keys), on).select(*keys, start.alias("start"), end.alias("end"))


def contains(rows: DataFrame, time: str, intervals: DataFrame, keys: list[str] | None = None, width: int = 3_600_000_000) -> DataFrame:
    """Rows whose time lies in the set."""
    keys = keys or []
    right = intervals.withColumnsRenamed({k: f"__r_{k}" for k in keys}).withColumn("__b", _buckets("start", "end", width)).select("__b", F.col("start").alias("__s"), F.col("end").alias("__e"), *[f"__r_{k}" for k in keys])
    on = (F.floor(F.col(time) / F.lit(width)) == F.col("__b")) & F.col(time).between(F.col("__s"), F.col("__e"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return rows.join(_unsent(right, keys), on, "left_semi")


def time_length(intervals: DataFrame) -> DataFrame:
    """One row: total length, both ends counted."""
    return intervals.agg(F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).alias("length"))


def key_number(intervals: DataFrame, window: int) -> DataFrame:
    """One row: how many windows of width ``window`` the set touches."""
    return intervals.select(_buckets("start", "end", window).alias("w")).distinct().agg(F.count(F.lit(1)).alias("n_windows"))


def slice_of(time: Column, window: int) -> Column:
    return F.floor(time * F.lit(SLICES) / F.lit(max(1, window)))


def slices(intervals: DataFrame, window: int, keys: list[str] | None = None) -> DataFrame:
    """The twentieths of windows that each interval touches."""
    w = max(1, window)
    return intervals.select(*(keys or []), F.explode(F.sequence(F.floor(F.col("start") * SLICES / F.lit(w)), F.floor(F.col("end") * SLICES / F.lit(w)))).alias("slice"))


def slice_set(intervals: DataFrame, window: int, keys: list[str] | None = None) -> DataFrame:
    """The twentieths of windows that a set touches: a coarser set that is one equality join away from any row."""
    return slices(intervals, window, keys).distinct()


def slice_and(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Slices in both sets."""
    return _semi(a, b, ["slice", *(keys or [])])


def slice_filter(rows: DataFrame, time: str, slices: DataFrame, window: int, keys: list[str] | None = None) -> DataFrame:
    """Rows whose slice is in the set."""
    return _semi(rows.withColumn("slice", slice_of(F.col(time), window)), _unsent(slices, keys or []), ["slice", *(keys or [])]).drop("slice")


def _semi(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    b = b.select(*[F.col(c).alias(f"__s_{c}") for c in names])
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"__s_{c}"))
    return a.join(b, on, "left_semi")


def pair_set(rows: DataFrame, time: str, key: Column, window: int, keys: list[str] | None = None) -> DataFrame:
    """Distinct (window number, value of a key expression)."""
    return rows.select(*(keys or []), F.floor(F.col(time) / F.lit(max(1, window))).alias("wid"), key.alias("key")).where("key is not null").distinct()


def keyed_filter(rows: DataFrame, time: str, key: Column, pairs: DataFrame, window: int, keys: list[str] | None = None) -> DataFrame:
    """Rows whose key value occurs in their window or a neighbouring one."""
    near = pairs.withColumn("wid", F.explode(F.array(F.col("wid") - 1, F.col("wid"), F.col("wid") + 1))).distinct()
    rows = rows.withColumns({"wid": F.floor(F.col(time) / F.lit(max(1, window))), "key": key})
    return _semi(rows.where("key is not null"), near, ["wid", "key", *(keys or [])]).drop("wid", "key")


def expected_keys(rows: DataFrame, time: str, key: Column, window: int, top: int = 15) -> DataFrame:
    """One row: how many different keys a window is expected to hold, if rows of each key came at an even rate.

    The ``top`` most frequent keys count each with its own rate, the others with their mean rate."""
    counted = rows.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    span = rows.agg((F.max(time) - F.min(time) + 1).alias("span"))
    often = counted.orderBy(F.desc("n"), "key").limit(top).select(F.collect_list("n").alias("often"))
    total = counted.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n"))
    parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [span, often, total])
    one = parts.agg(F.max("span").alias("span"), F.max("often").alias("often"), F.max("keys").alias("keys"), F.max("n").alias("n"))
    some = F.expr(f"aggregate(often, 0d, (z, n) -> z + 1 - exp(-n * {window}d / span))")
    rest, left = F.expr("keys - size(often)"), F.expr("n - aggregate(often, 0L, (z, n) -> z + n)")
    return one.select(F.round(some + F.when(rest > 0, rest * (1 - F.exp(-left / rest * F.lit(float(window)) / F.col("span")))).otherwise(0.0), 6).alias("expected"))
