"""Matching on streams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import candidates
from ..operators.match import condition
from ..plans.ast import ANY, NEXT_ROW, STRICT, Query, QueryError
from ..plans.parser import parse
from .matcher import Matcher, known


def _kept(condition_: Column, time: str) -> Column:
    """A filter that mentions the time column: the optimizer then leaves it above the watermark, which must see the times
    of rows that are no candidates too."""
    return F.when(F.col(time).isNotNull(), condition_)


def any_match_stream(stream: DataFrame, query: str | Query, watermark: str = "1 second") -> DataFrame:
    """All combinations by stream-stream joins.  State is bounded by the watermark and the window.

    The query needs a partition key or an equality between neighbours.  The time column must be a timestamp."""
    q = parse(query) if isinstance(query, str) else query
    candidates.check(stream, q)
    if not q.partition_by:
        raise QueryError("a stream needs PARTITION BY")
    stream = stream.withColumn(q.time, F.col(q.time).cast("timestamp"))
    seconds = q.window_us / 1_000_000
    out, head = None, q.variables[0]
    for last, v in zip([None, *q.variables], q.variables, strict=False):
        rows = stream.withWatermark(q.time, watermark).where(_kept(candidates.filter_conditions(q, v), q.time))
        ties = candidates.tie_columns(stream, q)
        rows = rows.select(*[F.col(c).alias(f"{v}__p{i}") for i, c in enumerate(q.partition_by)], *[c.alias(f"{v}__o{i}") for i, c in enumerate(ties)], *[F.col(c).alias(f"{v}__{c.lower()}") for c in stream.columns])
        if out is None:
            out = rows
            continue
        t, before = F.col(f"{v}__{q.time.lower()}"), F.col(f"{last}__{q.time.lower()}")
        later = F.lit(False)
        for i in reversed(range(len(ties))):
            x, y = F.col(f"{last}__o{i}"), F.col(f"{v}__o{i}")
            later = (y > x) | ((y == x) & later)
        on = [F.col(f"{head}__p{i}") == F.col(f"{v}__p{i}") for i in range(len(q.partition_by))]
        # the window around the row before bounds the state; that around the head decides
        on += [t >= before, t <= before + F.expr(f"make_dt_interval(0, 0, 0, {seconds:.6f})"), (t > before) | later]
        on += [F.unix_micros(t) <= F.unix_micros(f"{head}__{q.time.lower()}") + F.lit(q.window_us)]
        on += [condition(p) for p in q.completed_by(v)]
        out = out.join(rows, reduce(lambda a, b: a & b, on))
        # a stream has one event time: that of its last row
        out = out.withColumn(f"{last}__{q.time.lower()}", F.timestamp_micros(F.unix_micros(f"{last}__{q.time.lower()}")))
    if q.measures:
        return out.select(*[F.expr(e.sql(lambda r: f"`{r.var}__{r.column.lower()}`")).alias(n) for n, e in q.measures])
    return out.select(*[F.struct(*[F.col(f"{v}__{c.lower()}").alias(c) for c in stream.columns]).alias(v) for v in q.variables])


def match_stream(stream: DataFrame, query: str | Query, strategy: str = NEXT_ROW, watermark: str = "1 second") -> DataFrame:
    """Any strategy on a keyed stream.

    Rows wait in their key's state until the watermark has passed them, are then matched in the order of time and ties,
    and partial matches are forgotten once their window is over.  Rows behind the watermark are dropped."""
    q = parse(query) if isinstance(query, str) else query
    candidates.check(stream, q)
    if not q.partition_by:
        raise QueryError("a stream needs PARTITION BY")
    names = stream.columns
    time = next(c for c in names if c.lower() == q.time.lower())
    stream = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark)
    flags = [f"__is_{v}" for v in q.variables]
    rows = stream.withColumns({f: candidates.own_conditions(q, v) for f, v in zip(flags, q.variables, strict=True)})
    if strategy != STRICT:
        rows = rows.where(_kept(candidates.any_variable(q), time))
    ties = [f"__o{i}" for i in range(max(1, len(q.ties)))]
    rows = rows.withColumns({"__t": F.unix_micros(time), **dict(zip(ties, candidates.tie_columns(stream, q), strict=True))})
    fields = [T.StructField(f"{v}__{f.name.lower()}", f.dataType) for v in q.variables for f in stream.schema]
    schema = T.StructType(fields)
    order, columns, own = ["__t", *ties], [f.name for f in fields], [c.lower() for c in names]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, matcher = pickle.loads(state.get[0]) if state.exists else ([], Matcher(q, strategy))
        for pdf in batches:
            held += pdf.to_dict("records")
        now = state.getCurrentWatermarkMs() * 1000
        ready = sorted((r for r in held if r["__t"] <= now), key=lambda r: tuple(r[c] for c in order))
        held = [r for r in held if r["__t"] > now]
        found = []
        for r in ready:
            row = {k.lower() if not k.startswith("__") else k: known(v) for k, v in r.items() if not k.startswith("__is_")}
            for m in matcher.push(row, [r[f] for f in flags]):
                found.append([x[c] for x in m for c in own])
        matcher.expire(now)
        if not held and not any(matcher.waiting):
            if state.exists:
                state.remove()
        else:
            state.update((pickle.dumps((held, matcher)),))
            after = min([r["__t"] for r in held] + [m[1][0]["__t"] + q.window_us for level in matcher.waiting for m in level])
            state.setTimeoutTimestamp(max(int(after // 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=columns)

    out = rows.groupBy(*q.partition_by).applyInPandasWithState(step, schema, "state binary", "append", GroupStateTimeout.EventTimeTimeout)
    if q.measures:
        return out.select(*[F.expr(e.sql(lambda r: f"`{r.var}__{r.column.lower()}`")).alias(n) for n, e in q.measures])
    return out.select(*[F.struct(*[F.col(f"{v}__{c.lower()}").alias(c) for c in names]).alias(v) for v in q.variables])


__all__ = ["ANY", "any_match_stream", "match_stream"]
