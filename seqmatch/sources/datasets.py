"""Dataset utilities: splitting, sampling, cleaning and generating events and queries."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def split_round_robin(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Add ``part``: rows dealt in turn to n parts, in hash order of ``order``; each part has within one row of the others
    for each of the n groups that number their rows on their own."""
    from pyspark.sql import Window

    group = F.pmod(F.xxhash64(*order), F.lit(n))
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("part", F.pmod(F.row_number().over(w) - 1 + group, F.lit(n)).cast("int"))


def split_by_value(df: DataFrame, n: int, column: str) -> DataFrame:
    """Add ``part``: all rows of a value go to one of n parts, chosen by its hash."""
    return df.withColumn("part", F.pmod(F.xxhash64(column), F.lit(n)).cast("int"))


def split_by_window(df: DataFrame, n: int, time_us: Column, width_us: int) -> DataFrame:
    """Add ``part``: all rows of a stretch of time go to one of n parts."""
    return df.withColumn("part", F.pmod(F.xxhash64(F.floor(time_us / F.lit(width_us))), F.lit(n)).cast("int"))


def reservoir(df: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """A uniform sample of n rows: those with the least hashes of the seed and the key; partitions keep n rows each."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key])), *key).limit(n)


def zipf_edges(n: int, s: float) -> list[float]:
    """Cumulative probabilities of the ranks 0 .. n-2, the probability of a rank being in proportion to 1 / (rank + 1) ** s."""
    total = sum(1 / (i + 1) ** s for i in range(n))
    edges, acc = [], 0.0
    for i in range(n - 1):
        acc += 1 / (i + 1) ** s / total
        edges.append(acc)
    return edges


def zipf(u: Column, n: int, s: float) -> Column:
    """Rank 0 .. n-1 from a uniform number."""
    out = F.lit(n - 1)
    for i, edge in reversed(list(enumerate(zipf_edges(n, s)))):
        out = F.when(u < edge, F.lit(i)).otherwise(out)
    return out


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) hashed from columns, so that retries and partitions do not change it."""
    text = F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in cols]))
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def synthetic(spark: SparkSession, n: int, seed: int = 0, gap_ms: float = 10.0, arrivals: str = "exponential", shuffled: int = 1_000_000) -> DataFrame:
    """n events: type (Zipf, 20 values), a1 (uniform 0..1000), a2 and a3 (Zipf, 50 values), eventTime in ms.

    Event i comes at i gaps plus a random part of the given kind: exponential, uniform, gaussian or rayleigh.  Ids are
    in random order within blocks of ``shuffled`` events."""
    ids = spark.range(n)
    u = [uniform(seed * 100 + k, F.col("id")) for k in range(7)]
    extra = {
        "exponential": -F.log(F.lit(1.0) - u[4]),
        "uniform": u[4] * 2,
        "gaussian": F.greatest(F.lit(0.0), 1 + F.sqrt(-2 * F.log(F.lit(1.0) - u[4])) * F.cos(2 * 3.141592653589793 * u[5]) / 3),
        "rayleigh": F.sqrt(-2 * F.log(F.lit(1.0) - u[4])) * F.lit((2 / 3.141592653589793) ** 0.5),
    }[arrivals]
    return ids.select(
        F.concat(F.lit("T_"), F.lpad(zipf(u[0], 20, 1.2).cast("string"), 2, "0")).alias("type"),
        F.floor(u[1] * 1001).cast("int").alias("a1"),
        F.concat(F.lit("ATTR2_"), F.lpad(zipf(u[2], 50, 0.255).cast("string"), 2, "0")).alias("a2"),
        F.concat(F.lit("ATTR3_"), F.lpad(zipf(u[3], 50, 0.7).cast("string"), 2, "0"), F.lit("_PADDING")).alias("a3"),
        F.floor((F.col("id") + extra) * gap_ms).cast("long").alias("eventTime"),
        (F.floor(F.col("id") / shuffled) * shuffled * 4 + F.floor(u[6] * shuffled * 4)).cast("long").alias("arrival"),
    )


def stock(spark: SparkSession, n: int, seed: int = 10, symbols: int = 20, max_price: int = 100, max_volume: int = 1000) -> DataFrame:
    """n trades, one a second: id, eventTime in seconds, symbol (1 ..), price and volume, all uniform whole numbers."""
    ids = spark.range(n)
    u = [uniform(seed * 100 + k, F.col("id")) for k in range(3)]
    whole = lambda x, most: F.floor(x * most).cast("int")
    return ids.select("id", F.col("id").alias("eventTime"), (whole(u[0], symbols) + 1).alias("symbol"), whole(u[1], max_price).alias("price"), whole(u[2], max_volume).alias("volume"))


def generate_queries(variables: int, n: int, selectivity: float, seed: int = 0, minutes: int = 3) -> list[str]:
    """Random statements over the synthetic table: a type and a bound on a1 for each variable, and an equality with the
    variable before it now and then."""
    r, out = random.Random(seed), []
    for _ in range(n):
        names = [chr(65 + i) for i in range(variables)]
        pattern = " ".join(x if i == 0 else f"N{i}*? {x}" for i, x in enumerate(names))
        defines = []
        for i, x in enumerate(names):
            d = f"{x} AS {x}.type = 'T_{r.randrange(20):02d}' AND {x}.a1 <= {int(1000 * selectivity)}"
            if i and r.random() < 1.5 / (variables - 1):
                c = r.choice(("a2", "a3"))
                d += f" AND {x}.{c} = {names[i - 1]}.{c}"
            defines.append(d)
        out.append(f"SELECT * FROM SYNTHETIC MATCH_RECOGNIZE(\n    ORDER BY eventTime\n    ONE ROW PER MATCH\n    AFTER MATCH SKIP TO NEXT ROW\n    PATTERN({pattern}) WITHIN INTERVAL '{minutes}' MINUTE\n    DEFINE\n        " + ",\n        ".join(defines) + "\n);")
    return out


def clean_crimes(raw: DataFrame, time_format: str = "MM/dd/yyyy hh:mm:ss a") -> DataFrame:
    """Rows without nulls in the used columns, types in one word, time in epoch seconds."""
    kind = F.regexp_replace(F.trim("Primary Type"), r"[ -]+", "_")
    out = raw.select(kind.alias("type"), F.col("ID").cast("int").alias("id"), F.col("Case Number").alias("caseNumber"), F.col("IUCR").alias("IUCR"), F.col("Beat").cast("int").alias("beat"), F.col("District").cast("int").alias("district"), F.col("Latitude").cast("double").alias("latitude"), F.col("Longitude").cast("double").alias("longitude"), F.col("FBI Code").alias("FBICode"), F.unix_timestamp("Date", time_format).alias("eventTime"))
    return out.na.drop().orderBy("eventTime")


def clean_rides(raw: DataFrame) -> DataFrame:
    """Bike rides: type A..T from five bands of duration, kind of bike and membership; time in epoch milliseconds."""
    start, end = F.to_timestamp("started_at"), F.to_timestamp("ended_at")
    minutes = (end.cast("double") - start.cast("double")) / 60
    band = F.when(minutes <= 5, 0).when(minutes <= 10, 1).when(minutes <= 20, 2).when(minutes <= 40, 3).otherwise(4)
    code = band * 4 + F.when(F.col("rideable_type") == "electric_bike", 2).otherwise(0) + F.when(F.col("member_casual") == "member", 1).otherwise(0)
    out = raw.select(F.chr(code + 65).alias("type"), F.xxhash64("ride_id").alias("ride_id"), *[F.regexp_replace(c, r"\.", "").cast("int").alias(c) for c in ("start_station_id", "end_station_id")], *[F.col(c).cast("double").alias(c) for c in ("start_lat", "start_lng", "end_lat", "end_lng")], F.unix_millis(start).alias("eventTime"))
    return out.na.drop().orderBy("eventTime")


def clean_jobs(raw: DataFrame) -> DataFrame:
    """Cluster jobs: rows without nulls, numbers cast, time in microseconds, in order of time."""
    out = raw.select(F.col("type").cast("string").alias("type"), F.col("JOBID").cast("long").alias("JOBID"), F.col("index").cast("int").alias("index"), F.col("scheduling").cast("string").alias("scheduling"), F.col("priority").cast("int").alias("priority"), *[F.col(c).cast("float").alias(c) for c in ("CPU", "RAM", "disk")], F.col("eventTime").cast("long").alias("eventTime"))
    return out.na.drop().orderBy("eventTime")
