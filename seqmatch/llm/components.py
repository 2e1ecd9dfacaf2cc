"""Connected components of an edge table by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import materialize


def _written(edges: DataFrame, what: str) -> tuple[DataFrame, tuple]:
    """The edges in the shared folder, and their number and a hash of all of them, taken while they are written."""
    seen = Observation()
    out = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("all")), what)
    return out, (seen.get["n"], seen.get["all"])


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """``edges``: columns u and v of one orderable type.  Returns (node, root), root the smallest node it reaches.

    Each round's edges are distinct, are written to the shared folder, and never outnumber the round's nodes by more
    than the edges that came in; the number of rounds grows with the logarithm of the longest path.  The least
    neighbours are aggregated with map-side combination and written, so that they and the edges meet in a plain join
    of two shuffled sides, whose hot nodes (the middle of a large star) adaptive execution splits over tasks.
    While they are written it is seen whether all edges are stars around their smallest nodes, which ends the rounds:
    each node has larger neighbours only, or a single one that is smaller.
    Self-loops are dropped; an empty table gives an empty result.
    """

    def least(rows: DataFrame) -> tuple[DataFrame, int]:
        """Each node's least neighbour, and how many nodes are neither middle nor end of a star."""
        seen = Observation()
        low = rows.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("__x"), F.count(F.lit(1)).alias("__n"))
        low = low.observe(seen, F.count_if(~(F.expr("m > u") | F.expr("__x < u and __n = 1"))).alias("n"))
        low = materialize(low.select("u", "m"), what)
        return low.hint("merge"), seen.get["n"]  # it grows with the input: never broadcast

    now, seen = _written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), what)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, loose = least(both)
        if not loose:
            break
        near = both.join(low, "u").withColumn("m", F.least("u", "m"))
        large = materialize(near.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), what)
        near = large.join(least(large)[0], "u")
        pairs = F.array_compact(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.when(F.col("v") != F.col("m"), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        before = seen
        now, seen = _written(near.select(F.explode(pairs).alias("e")).select("e.u", "e.v").distinct(), what)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
