"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, materialize, without

ADDED = ("copy", "n_copies", "shuffle_key")
SEED = "mix-1"
ALPHA = 0.5


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = ALPHA, total: float | None = None) -> DataFrame:
    """One row for each source: its rows, target share and mean number of copies.

    ``weights`` gives shares (any scale; sources that it does not name get 0); without it a source of n rows gets a
    share in proportion to n ** ``alpha``.  ``total`` is the expected number of rows out, the rows in if not given.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        weighted = counts.withColumn("weight", F.pow(F.col("n_rows").cast("double"), F.lit(float(alpha))))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [("", 0.0)], "named string, weight double")
        weighted = counts.join(given, F.col("source").eqNullSafe(F.col("named")), "left").drop("named").na.fill({"weight": 0.0})
    all_weight, all_rows = weighted.agg(F.sum("weight"), F.sum("n_rows")).first()
    share = F.col("weight") / F.lit(all_weight) if all_weight else F.lit(0.0)
    rows = float(all_rows or 0) if total is None else float(total)
    return weighted.select("source", "n_rows", share.alias("share"), (share * F.lit(rows) / F.col("n_rows")).alias("rate"))


def distributions(rates: DataFrame) -> DataFrame:
    """(source, least, cdf) for rows (source, rate): the cumulative probabilities P(X <= k) for k = least, least + 1, ...

    ``least`` is 0 up to a rate of some 300; from there on the array covers 12 standard deviations and 30 on both sides
    of the mean, beyond which no number of 52 bits falls, so it has about 24 * sqrt(rate) entries.  Each k is a row:
    ln k! is a running sum of logarithms, from Stirling's series where the array doesn't begin at 0."""
    rows = rates.where("rate > 0").withColumn("reach", F.expr("12 * sqrt(rate) + 30"))
    rows = rows.withColumn("least", F.expr("if(rate - reach < 50, 0L, cast(floor(rate - reach) as bigint))"))
    rows = rows.select("source", "rate", "least", F.explode(F.expr("sequence(least, cast(ceil(rate + reach) as bigint))")).alias("k"))
    before = F.expr("if(least = 0, 0d, (least + 0.5d) * ln(least) - least + 0.5d * ln(2 * pi()) + 1 / (12d * least) - 1 / (360d * pow(least, 3)) + 1 / (1260d * pow(least, 5)))")
    running = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    logs = F.sum(F.when(F.col("k") > F.col("least"), F.ln(F.col("k").cast("double"))).otherwise(0.0)).over(running)
    mass = rows.withColumn("mass", F.exp(F.col("k") * F.ln("rate") - F.col("rate") - before - logs))
    steps = mass.withColumn("p", F.sum("mass").over(running) / F.sum("mass").over(Window.partitionBy("source")))
    return steps.groupBy("source").agg(F.min("least").alias("least"), F.array_sort(F.collect_list(F.struct("k", "p"))).alias("steps")).select("source", "least", F.expr("steps.p").alias("cdf"))


def replicate(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = ALPHA, total: float | None = None, seed: str = SEED) -> DataFrame:
    """Repeat each row as often as a Poisson variable with its source's mean rate says, then shuffle globally.

    The variable is the inverse of the distribution at a number in [0, 1) hashed from the seed and ``doc_id``, so the
    result does not depend on partitions, retries or other rows' order.  The table of distributions has a row for each
    source and is written to the shared folder; its size decides between broadcast and a join whose hot source adaptive
    execution can split.  Rows go to a partition by a hash of their own, never by source, and each partition is put in
    the order of ``shuffle_key``: a random permutation without a range-sampling pass.

    Returns the columns of ``docs``, ``copy`` (from 0), ``n_copies`` and ``shuffle_key``.
    * null source: a source of its own; null doc_id hashes like ''; rows with one doc_id get the same count.
    * a source with target 0 gives no rows; empty input gives an empty result.
    * empty and very long texts are rows like any other; they are moved whole.
    * input columns named copy, n_copies or shuffle_key are replaced; all others, however named, pass through.
    """
    docs = without(docs, *ADDED)
    mixed, cdf, least, u = free_names(docs, "__source", "__cdf", "__least", "__u")
    rates = distributions(source_rates(docs, weights, alpha, total)).select(F.col("source").alias(mixed), F.col("cdf").alias(cdf), F.col("least").alias(least))
    rates = materialize(rates, "mix-rates")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    out = docs.withColumn(u, hashed).join(rates, F.col("source").eqNullSafe(F.col(mixed)))
    out = out.withColumn("n_copies", F.expr(f"{least} + size(filter({cdf}, c -> c <= {u}))")).where("n_copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1))).drop(u, cdf, least, mixed)
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), key, F.col("copy").cast("string"))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key")


def oracle(table: str = "documents", alpha: float = ALPHA, seed: str = SEED) -> str:
    return f"""
WITH c AS (SELECT source, count(*) AS n_rows FROM {table} GROUP BY source),
r AS (SELECT source, pow(n_rows::DOUBLE, {alpha}) / (SELECT sum(pow(n_rows::DOUBLE, {alpha})) FROM c) * (SELECT count(*) FROM {table})::DOUBLE / n_rows AS rate FROM c),
p AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS mass FROM r, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 31)::BIGINT)) AS t(k)),
d AS (SELECT source, k, sum(mass) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
u AS (SELECT *, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM {table}),
n AS (SELECT u.*, (SELECT count(*) FROM d WHERE d.source IS NOT DISTINCT FROM u.source AND d.cdf <= u.u) AS n_copies FROM u)
SELECT doc_id, text, lang, source, n_chars, copy, n_copies, md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR) AS shuffle_key
FROM (SELECT *, unnest(range(0, n_copies)) AS copy FROM n)
"""
