"""Time the headline queries: ``python bench.py`` prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores.  Each query runs once to warm up and
then three times over all its rows into a sink without output; the least time counts.  The statements over trades have
1,000,000 generated events, written as a file before."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from seqmatch import registry
from seqmatch.functions.storage import materialize
from seqmatch.sources import datasets

HEADLINE = [
    "scan_candidates", "any_match_part", "any_match_nopart", "next_row", "next_row_by_window", "next_match", "next_match_by_window", "strict", "strict_nopart",
    "two_var", "four_var", "five_var", "intervals_coalesce", "intervals_intersect", "slices_filter", "keyed_filter", "prune_dual", "prune_adaptive", "participation_stats", *registry.STOCK,
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    trades = materialize(datasets.stock(spark, 1_000_000), "trades")
    took = {}
    for name in HEADLINE:
        run = (lambda: registry.stock_query(name, trades)) if name in registry.STOCK else (lambda: registry.QUERIES[name](spark, sf_dir))  # noqa: B023
        best = float("inf")
        for i in range(4):
            began = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began) if i else best
        took[name] = round(best, 4)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "sequence matching, sum of the least times", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
