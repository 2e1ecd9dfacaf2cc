"""Several clients' queries at once in one session."""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

R = TypeVar("R")


class Gate:
    """Lets clients in while the sum of their sizes stays within ``most``; one that is larger goes alone."""

    def __init__(self, most: int | None):
        self.most, self.inside, self.sum = most, 0, 0
        self.change = threading.Condition()

    def enter(self, size: int) -> None:
        with self.change:
            self.change.wait_for(lambda: self.most is None or not self.inside or self.sum + size <= self.most)
            self.inside, self.sum = self.inside + 1, self.sum + size

    def leave(self, size: int) -> None:
        with self.change:
            self.inside, self.sum = self.inside - 1, self.sum - size
            self.change.notify_all()


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes that a plan's file scans give, which are what its shuffles may hold."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    return sum(min(int(str(leaves.apply(i).stats().sizeInBytes())), 1 << 62) for i in range(leaves.length()))


def run_many(spark: SparkSession, queries: Mapping[str, Callable[[], DataFrame]], action: Callable[[DataFrame], R] = DataFrame.count, at_once: int = 4, most_bytes: int | None = None, retries: int = 1) -> dict[str, R]:
    """Run an action on each query's result, ``at_once`` at a time, each client in a scheduler pool of its own.

    With ``spark.scheduler.mode=FAIR`` the pools share the executors evenly.  ``most_bytes`` is a gate on memory: a client
    waits while the estimated bytes of those that run and its own exceed it.  A query that fails, for lack of memory or
    executors for instance, is made and run again up to ``retries`` times, the last time with the gate to itself; it
    raises only after the others have ended, and leaves nothing behind for the next."""
    gate = Gate(most_bytes)

    def one(client: str) -> R:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", client)
        try:
            for attempt in range(retries + 1):
                df, last = queries[client](), attempt == retries
                size = 0 if most_bytes is None else most_bytes if last and attempt else estimated_bytes(df)
                gate.enter(size)
                try:
                    return action(df)
                except Exception:
                    if last:
                        raise
                finally:
                    gate.leave(size)
            raise AssertionError
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        running = {c: pool.submit(inheritable_thread_target(spark)(one), c) for c in queries}
    return {c: f.result() for c, f in running.items()}
