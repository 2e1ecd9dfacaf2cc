"""Reductions of the candidates before matching.  They change cost, never the result."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialize
from ..plans import cost
from ..plans.ast import NEXT_MATCH, STRICT, Query, QueryError
from . import intervals as iv
from .match import after, condition, partition

NONE, PREDICATES, JOIN, TWO_TRIPS, SEQUENTIAL, SLICED, DUAL, ADAPTIVE = "none", "predicates", "join", "intervals_keys", "sequential_exact", "slices", "dual", "adaptive"
MODES = (NONE, PREDICATES, JOIN, TWO_TRIPS, SEQUENTIAL, SLICED, DUAL, ADAPTIVE)
HOUR = 3_600_000_000
Candidates = dict[str, DataFrame]
Keep = Callable[[DataFrame, str], DataFrame]


def planned(df: DataFrame, what: str) -> DataFrame:
    """Intermediate rows stay part of the plans that use them."""
    return df


def written_once() -> Keep:
    """Intermediate rows are written to the shared folder, those of one plan once, and later plans read them."""
    made: list[tuple[DataFrame, DataFrame]] = []

    def keep(df: DataFrame, what: str) -> DataFrame:
        table = next((t for x, t in made if x.sameSemantics(df)), None)
        if table is None:
            made.append((df, table := materialize(df, what)))
        return table

    return keep


def allowed(mode: str, strategy: str) -> None:
    """Removing rows that are in no full match changes nothing for the strategies that try all combinations.  The greedy
    one may only lose rows that fail their own conditions, and adjacency needs every row."""
    if mode not in MODES:
        raise QueryError(f"unknown pruning {mode!r}")
    if strategy == NEXT_MATCH and mode not in (NONE, PREDICATES):
        raise QueryError(f"pruning {mode!r} would change greedy matches")
    if strategy == STRICT and mode != NONE:
        raise QueryError(f"pruning {mode!r} would change which rows are adjacent")


def _key(q: Query, p, var: str) -> Column:
    return F.expr(p.side(var).sql(lambda r: f"`{r.var}__{r.column.lower()}`"))


def _keyed(cands: Candidates, q: Query, var: str, others: list[str]) -> DataFrame:
    """Rows of ``var`` that find each equality partner in time; keys are the whole expressions of both sides."""
    rows, keys = cands[var], partition(cands[var])
    for other in others:
        for p in q.between(var, other):
            if p.is_equality:
                pairs = iv.pair_set(cands[other], f"{other}__t", _key(q, p, other), q.window_us, keys)
                rows = iv.keyed_filter(rows, f"{var}__t", _key(q, p, var), pairs, q.window_us, keys)
    return rows


def _width(q: Query, keys: list[str]) -> int:
    """Width of the buckets of time in which sets are compared: a key's intervals are as long as the window at least, so
    narrower ones would repeat each many times.  Without keys few intervals are left, and hours spread the rows."""
    return max(HOUR, q.window_us) if keys else HOUR


def _intervals(cands: Candidates, q: Query, var: str) -> DataFrame:
    keys = partition(cands[var])
    return iv.coalesce(iv.replay(cands[var], f"{var}__t", q.window_us, q.marker(var), keys), keys, _width(q, keys))


def _common(a: DataFrame, b: DataFrame, q: Query, keys: list[str]) -> DataFrame:
    return iv.intersect(a, b, keys, _width(q, keys))


def _within(cands: Candidates, q: Query, var: str, times: DataFrame) -> DataFrame:
    keys = partition(cands[var])
    return iv.contains(cands[var], f"{var}__t", times, keys, _width(q, keys))


def two_trips(cands: Candidates, q: Query, keep: Keep = planned) -> Candidates:
    """All intervals and key sets at once, intersected, then one fetch."""
    keys = partition(next(iter(cands.values())))
    common = materialize(reduce(lambda a, b: _common(a, b, q, keys), [keep(_intervals(cands, q, v), "intervals") for v in q.variables]), "times")
    inside = {v: _within(cands, q, v, common) for v in q.variables}
    return {v: _keyed(inside | {o: cands[o] for o in q.variables if o != v}, q, v, [o for o in q.variables if o != v]) for v in q.variables}


def one_by_one(cands: Candidates, q: Query, order: list[str], keep: Keep = planned) -> Candidates:
    """Variable after variable: each is cut down to the time and keys that the ones before it left, and then cuts the
    time set itself; at the end all variables are cut to the final set.  The time set is looked at by every later step,
    so each is written to the shared folder once."""
    keys = partition(next(iter(cands.values())))
    now = dict(cands)
    first = _intervals(now, q, order[0])
    allowed_time = materialize(first, "times") if keep is planned else keep(first, "intervals")
    done = [order[0]]
    for v in order[1:]:
        now[v] = keep(_keyed(now | {v: _within(now, q, v, allowed_time)}, q, v, done), "candidates")
        allowed_time = materialize(_common(allowed_time, keep(_intervals(now, q, v), "intervals"), q, keys), "times")
        done.append(v)
    return {v: _within(now, q, v, allowed_time) for v in q.variables}


def by_slices(cands: Candidates, q: Query, variables: list[str], keyed: bool, keep: Keep = planned) -> Candidates:
    """All variables at once: one aggregation finds the slices of time that windows of each of ``variables`` touch, and
    every variable keeps its rows in those; ``keyed`` also asks for the partners of equalities.  Nothing is written unless
    by ``keep``; the plan's equal exchanges are made once."""
    keys = partition(next(iter(cands.values())))
    parts = [iv.slices(iv.replay(cands[v], f"{v}__t", q.window_us, q.marker(v), keys), q.window_us, keys).withColumn("who", F.lit(1 << i)) for i, v in enumerate(variables)]
    touched = reduce(lambda a, b: a.unionByName(b), parts).groupBy("slice", *keys).agg(F.bit_or("who").alias("who"))
    common = keep(touched.where(F.col("who") == (1 << len(variables)) - 1).drop("who"), "slices")
    inside = {v: iv.slice_filter(cands[v], f"{v}__t", common, q.window_us, keys) for v in q.variables}
    if not keyed:
        return inside
    return {v: _keyed(cands | {v: inside[v]}, q, v, [o for o in q.variables if o != v]) for v in q.variables}


def by_join(cands: Candidates, q: Query, order: list[str], ties: int, keep: Keep = planned) -> Candidates:
    """Semi-joins with all conditions: each variable keeps rows that have a partner among the one reduced before."""
    now, done = dict(cands), [order[0]]
    width = max(1, q.window_us)
    for v in order[1:]:
        for other in done:
            first, second = (v, other) if q.precedes(v, other) else (other, v)
            keys = partition(now[v])
            left = now[v].withColumn("__w", F.floor(F.col(f"{v}__t") / F.lit(width)))
            right = now[other].withColumnsRenamed({k: f"{k}r" for k in keys})
            near = [F.floor(F.col(f"{other}__t") / F.lit(width)) + d for d in ((0, 1) if first == other else (-1, 0))]
            right = right.withColumn("__w2", F.explode(F.array(*near)))
            on = [F.col("__w") == F.col("__w2"), *[F.col(k).eqNullSafe(F.col(f"{k}r")) for k in keys], after(first, second, ties)]
            on += [F.col(f"{second}__t") <= F.col(f"{first}__t") + F.lit(q.window_us), *[condition(p) for p in q.between(v, other)]]
            now[v] = left.join(iv._unsent(right, keys), reduce(lambda a, b: a & b, on), "left_semi").drop("__w")
        now[v] = keep(now[v], "candidates")
        done.append(v)
    return now


def span_us(cands: Candidates) -> int:
    """Length of the time that candidates cover, in one job."""
    times = reduce(lambda a, b: a.unionByName(b), [df.agg(F.min(f"{v}__t").alias("a"), F.max(f"{v}__t").alias("b")) for v, df in cands.items()])
    r = times.agg(F.min("a").alias("a"), F.max("b").alias("b")).first()
    return max(1, r["b"] - r["a"]) if r["a"] is not None else 1


def reduce_candidates(cands: Candidates, q: Query, mode: str, ties: int, counts: dict[str, int] | None = None, model: cost.CostModel | None = None, keep: Keep = planned) -> Candidates:
    """Apply a mode.  Those with an order of variables need ``counts``, which cost one aggregation over the table.
    ``keep`` gets the rows that several of the frames build on."""
    if mode in (NONE, PREDICATES) or len(q.variables) < 2:
        return cands
    if mode == TWO_TRIPS:
        return two_trips(cands, q, keep)
    counts = counts or {v: df.count() for v, df in cands.items()}
    if mode == JOIN:
        return by_join(cands, q, cost.join_plan(q, counts), ties, keep)
    order = cost.filter_plan(q, counts)
    if mode == SEQUENTIAL:
        return one_by_one(cands, q, order, keep)
    chosen = list(order)
    if mode == ADAPTIVE:
        span, model = span_us(cands), model or cost.Adaptive()
        chosen = order[:1]
        for v in order[1:]:
            before = order[: order.index(v)]
            rarest = min(before, key=lambda d: counts[d])
            equal = any(p.is_equality for d in before for p in q.between(v, d))
            if model.worthwhile(cost.Reduction(counts[v], span, q.window_us, counts[rarest] / span, equal, both_sides=q.marker(rarest) == "middle")):
                chosen.append(v)
        if len(chosen) < 2:
            return cands
    return by_slices(cands, q, chosen, mode != SLICED, keep)


def report(df_cands: Candidates, q: Query, ties: int, modes: tuple[str, ...] = MODES) -> DataFrame:
    """Rows of each variable that each mode lets through to the match: (mode, variable, rows).

    Frame after frame is counted, those of one plan once, over candidates and sets that are written first: in plans of
    whole modes the driver would hold tens of stages, their code and their broadcast tasks at once.  What comes back to
    it is a number for each frame."""
    keep = written_once()
    needed = {v: {*partition(df), f"{v}__t", *[f"{v}__o{i}" for i in range(ties)], *[f"{v}__{c.lower()}" for c in q.columns(v)]} for v, df in df_cands.items()}
    cands = {v: materialize(df.select(*[F.col(f"`{c}`") for c in df.columns if c in needed[v]]), "candidates") for v, df in df_cands.items()}
    counted: list[tuple[DataFrame, int]] = []

    def number(df: DataFrame) -> int:
        n = next((n for x, n in counted if x.sameSemantics(df)), None)
        if n is None:
            counted.append((df, n := df.count()))
        return n

    counts = {v: number(df) for v, df in cands.items()}
    found = {(m, v): number(df) for m in modes for v, df in reduce_candidates(cands, q, m, ties, counts, cost.AlwaysOn(), keep).items()}
    rows = [F.struct(F.lit(m).alias("mode"), F.lit(v).alias("variable"), F.lit(found[m, v]).cast("long").alias("rows")) for m in modes for v in q.variables]
    return next(iter(df_cands.values())).sparkSession.range(1).select(F.explode(F.array(*rows)).alias("row")).select("row.*")
