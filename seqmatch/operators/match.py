"""The four selection strategies as joins and windows.

A frame of partial matches has, for each variable X so far, ``X__t``, ``X__o*`` and the columns it uses, and the
partition columns ``__p*``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import micros
from ..functions.storage import materialize
from ..plans.ast import ANY, NEXT_MATCH, NEXT_ROW, STRICT, Predicate, Query
from .candidates import any_variable, check, own_conditions, tie_columns
from .sessions import estimated_bytes


def _name(r) -> str:
    return f"`{r.var}__{r.column.lower()}`"


def condition(p: Predicate) -> Column:
    return F.expr(p.expr.sql(_name))


def place(var: str, ties: int) -> list[Column]:
    """What orders rows: time, then ties."""
    return [F.col(f"{var}__t"), *[F.col(f"{var}__o{i}") for i in range(ties)]]


def after(a: str, b: str, ties: int) -> Column:
    """Row b comes after row a."""
    out = F.lit(False)
    for x, y in reversed(list(zip(place(a, ties), place(b, ties), strict=True))):
        out = (y > x) | ((y == x) & out)
    return out


def partition(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("__p")]


def extend(partial: DataFrame, rows: DataFrame, q: Query, head: str, last: str, var: str, ties: int) -> DataFrame:
    """Join partial matches with the rows of the next variable.

    The join has equality keys always: the partition, the keys of equality conditions, and the time bucket.  Buckets
    have the width of the window, so a row within the window of a head is in the head's bucket or the next; heads are
    doubled, the new rows are not, and no pair comes twice.  A hot partition is thereby spread over time.
    """
    width = max(1, q.window_us)
    left = partial.withColumn("__w", F.explode(F.array(F.floor(F.col(f"{head}__t") / F.lit(width)), F.floor(F.col(f"{head}__t") / F.lit(width)) + 1)))
    right = rows.withColumn("__w2", F.floor(F.col(f"{var}__t") / F.lit(width))).withColumnsRenamed({p: f"{p}r" for p in partition(rows)})
    on = [F.col("__w") == F.col("__w2"), *[F.col(p).eqNullSafe(F.col(f"{p}r")) for p in partition(partial)]]
    on += [condition(p) for p in q.completed_by(var)]
    on += [F.col(f"{var}__t") <= F.col(f"{head}__t") + F.lit(q.window_us), after(last, var, ties)]
    return left.join(right, reduce(lambda a, b: a & b, on)).drop("__w", "__w2", *[f"{p}r" for p in partition(partial)])


def any_match(cands: dict[str, DataFrame], q: Query, ties: int) -> DataFrame:
    """All combinations."""
    head = q.variables[0]
    out = cands[head]
    for last, var in zip(q.variables, q.variables[1:], strict=False):
        out = extend(out, cands[var], q, head, last, var, ties)
    return out


def first_per_head(matches: DataFrame, head: str, by: list[Column], ties: int) -> DataFrame:
    """The first match of each head; Spark limits each group before the shuffle and again after."""
    w = Window.partitionBy(*[F.col(p) for p in partition(matches)], *place(head, ties)).orderBy(*by)
    return matches.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def next_row(cands: dict[str, DataFrame], q: Query, ties: int, preference: str = "first_completed") -> DataFrame:
    """For each head the first completed match: least last row, then the one before, down to the second."""
    order = list(q.variables[1:])
    if preference == "first_completed":
        order.reverse()
    return first_per_head(any_match(cands, q, ties), q.variables[0], [c for v in order for c in place(v, ties)] or place(q.variables[0], ties), ties)


def next_match(cands: dict[str, DataFrame], q: Query, ties: int) -> DataFrame:
    """Greedy: each variable is the first row after the one before that meets its conditions; no going back."""
    head = q.variables[0]
    out = cands[head]
    for last, var in zip(q.variables, q.variables[1:], strict=False):
        out = first_per_head(extend(out, cands[var], q, head, last, var, ties), head, place(var, ties), ties)
    return out


HOT_BYTES, HOT_ROWS = 1 << 28, 5_000_000


def has_hot_partition(df: DataFrame, q: Query) -> bool:
    """Whether some partition has over HOT_ROWS rows; tables of under HOT_BYTES are not asked."""
    if not q.partition_by or estimated_bytes(df) < HOT_BYTES:
        return False
    most = df.groupBy(*[F.col(f"`{c}`") for c in q.partition_by]).count().agg(F.max("count")).first()[0]
    return (most or 0) > HOT_ROWS


def next_by_window(df: DataFrame, q: Query, ties: int, unit: str, names: list[str], spread: bool = False) -> DataFrame:
    """Greedy matches of a query without conditions between variables, in one sort of each partition and no join.

    Going back in time, every row learns the next row of the last variable, then every row of the variable before it
    carries its own continuation along, and so on to the heads.  ``spread`` deals partitions to stretches of time as long
    as the window, each of which also sees the rows of the next one, so that no partition is one task.
    """
    check(df, q)
    flags = {v: own_conditions(q, v) for v in q.variables}
    t = micros(df, q.time, unit)
    keys = [F.col(f"`{c}`").alias(f"__p{i}") for i, c in enumerate(q.partition_by)]
    rows = df.where(any_variable(q) & t.isNotNull())
    rows = rows.select(*keys, t.alias("__t"), *[c.alias(f"__o{i}") for i, c in enumerate(tie_columns(df, q))], *[F.col(f"`{c}`").alias(f"c__{c.lower()}") for c in names], *[f.alias(f"__is_{v}") for v, f in flags.items()])
    groups = [f"__p{i}" for i in range(len(keys))]
    if spread:
        stretch = F.floor(F.col("__t") / F.lit(max(1, q.window_us)))
        rows = rows.withColumn("__range", F.explode(F.array(stretch, stretch - 1)))
        rows = rows.withColumn(f"__is_{q.variables[0]}", F.col(f"__is_{q.variables[0]}") & (F.col("__range") == stretch))
        groups = [*groups, "__range"]
    w = Window.partitionBy(*groups).orderBy(F.desc("__t"), *[F.desc(f"__o{i}") for i in range(ties)]).rowsBetween(Window.unboundedPreceding, -1)
    own = [F.col("__t").alias("t"), *[F.col(f"__o{i}").alias(f"o{i}") for i in range(ties)], *[F.col(f"c__{c.lower()}").alias(c.lower()) for c in names]]
    following = None
    for v in reversed(q.variables):
        body = F.struct(F.struct(*own).alias("me"), *([F.col("__next").alias("then")] if following else []))
        usable = F.col(f"__is_{v}") if following is None else F.col(f"__is_{v}") & F.col("__next").isNotNull()
        rows = rows.withColumn("__this", F.when(usable, body))
        if v != q.variables[0]:
            rows = rows.withColumn("__next", F.last("__this", ignorenulls=True).over(w))
        following = v
    out, at = rows.where("__this is not null"), "__this"
    select = [F.col(f"__p{i}") for i in range(len(keys))]
    for v in q.variables:
        select += [F.col(f"{at}.me.t").alias(f"{v}__t"), *[F.col(f"{at}.me.o{i}").alias(f"{v}__o{i}") for i in range(ties)], *[F.col(f"{at}.me.{c.lower()}").alias(f"{v}__{c.lower()}") for c in names]]
        at += ".then"
    out = out.select(*select)
    return out.where(F.col(f"{q.variables[-1]}__t") <= F.col(f"{q.variables[0]}__t") + F.lit(q.window_us))


def next_by_ranges(df: DataFrame, q: Query, ties: int, unit: str, names: list[str]) -> DataFrame:
    """The same for two variables or more without a partition key, in one sort and no join of rows with rows.

    Rows are dealt to ranges of time between quantiles.  Going back in time in its range, every row learns the next row of
    each variable, be it the range's or none; what a range leaves open is continued with the first rows of later ranges.
    Heads and one row for each range are written to the shared folder, and the rows of ranges are broadcast to the heads."""
    check(df, q)
    t, o = micros(df, q.time, unit), [f"__o{i}" for i in range(ties)]
    rows = df.where(any_variable(q) & t.isNotNull())
    rows = rows.select(t.alias("__t"), *[c.alias(x) for x, c in zip(o, tie_columns(df, q), strict=True)], *[F.col(f"`{c}`").alias(f"c__{c.lower()}") for c in names], *[own_conditions(q, v).alias(f"__is_{v}") for v in q.variables])
    rows = rows.withColumn("__range", _range_of(_cuts(rows, "__t"), "__t"))
    back = Window.partitionBy("__range").orderBy(*[F.desc(x) for x in ["__t", *o]])
    before, so_far = back.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, 0)
    # rows of one time and equal ties, or of which a null hides the order, do not come after each other: they see what the first of them sees
    places = [F.struct("__t", *o[:k]) for k in range(ties + 1)]
    rows = rows.withColumns({f"__begins{k}": ~F.lag(x).over(back).eqNullSafe(x) for k, x in enumerate(places)})
    own = F.struct(F.col("__t").alias("t"), *[F.col(x).alias(x[2:]) for x in o], *[F.col(f"c__{c.lower()}").alias(c.lower()) for c in names])
    head, rest = q.variables[0], q.variables[1:]
    then = []
    for v in reversed(rest):
        rows = rows.withColumn(f"__this_{v}", F.when(F.col(f"__is_{v}"), F.struct(own.alias("me"), *then)))
        rows = rows.withColumn("__seen", F.struct(F.last(f"__this_{v}", ignorenulls=True).over(before).alias("row")))
        seen = [F.last(F.when(F.col(f"__begins{k}"), F.col("__seen")), ignorenulls=True).over(so_far)["row"] for k in range(ties + 1)]
        rows = rows.withColumn("__then", reduce(lambda a, k: F.when(F.col(o[k]).isNull(), seen[k]).otherwise(a), reversed(range(ties)), seen[ties]))
        then = [F.col("__then").alias("then")]
    new = ~F.last(F.when(F.col(f"__is_{head}"), places[ties]), ignorenulls=True).over(before).eqNullSafe(places[ties])
    firsts = F.struct(*[F.last(f"__this_{v}", ignorenulls=True).over(so_far).alias(v) for v in rest])
    rows = rows.withColumn("__new", new).withColumn("__firsts", F.when(F.lead(F.lit(1)).over(back).isNull(), firsts))
    rows = rows.select("__range", F.when(F.col(f"__is_{head}") & F.col("__new"), F.struct(own.alias("me"), *then)).alias("__chain"), "__firsts")
    rows = materialize(rows.where("__chain is not null or __firsts is not null"), "heads")
    out = rows.where("__chain is not null").select("__range", "__chain").join(F.broadcast(_later(rows.where("__firsts is not null"), rest)), "__range")
    select, at = [], _whole_chain(F.col("__chain"), rest)
    out = out.select(at.alias("__chain"))
    at = F.col("__chain")
    for v in q.variables:
        select += [at["me"]["t"].alias(f"{v}__t"), *[at["me"][x[2:]].alias(f"{v}{x}") for x in o], *[at["me"][c.lower()].alias(f"{v}__{c.lower()}") for c in names]]
        at = at["then"]
    return out.select(*select).where(F.col(f"{q.variables[-1]}__t") <= F.col(f"{head}__t") + F.lit(q.window_us))


def _whole_chain(chain: Column, rest: tuple[str, ...]) -> Column:
    """A row and those after it, where the range's own rows end continued with the first ones of later ranges."""
    if not rest:
        return chain
    then = chain["then"]
    return F.when(chain.isNotNull(), F.struct(chain["me"].alias("me"), F.when(then.isNull(), F.col(f"__later_{rest[0]}")).otherwise(_whole_chain(then, rest[1:])).alias("then")))


def _later(firsts: DataFrame, rest: tuple[str, ...]) -> DataFrame:
    """For each range of time the first row of each variable in later ranges, with the rows that continue it."""
    back = Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    for i in reversed(range(len(rest))):
        firsts = firsts.withColumn(f"__later_{rest[i]}", F.last(_whole_chain(F.col(f"__firsts.{rest[i]}"), rest[i + 1 :]), ignorenulls=True).over(back))
    return firsts.select("__range", *[f"__later_{v}" for v in rest])


def strict(df: DataFrame, q: Query, ties: int, unit: str, names: list[str], spread: bool = False) -> DataFrame:
    """Adjacent rows of a partition, all rows counting.  Without a partition key, or to ``spread`` large partitions, rows
    are dealt to ranges of time; each range also gets the first rows after it, so that no task sees a whole partition."""
    check(df, q)
    t = micros(df, q.time, unit)
    rows = df.where(t.isNotNull()).select(*[F.col(f"`{c}`").alias(f"__p{i}") for i, c in enumerate(q.partition_by)], t.alias("__t"), *[c.alias(f"__o{i}") for i, c in enumerate(tie_columns(df, q))], *[F.col(f"`{c}`").alias(f"c__{c.lower()}") for c in names], *[own_conditions(q, v).alias(f"__is_{v}") for v in q.variables])
    order = [F.col("__t"), *[F.col(f"__o{i}") for i in range(ties)]]
    keys = [f"__p{i}" for i in range(len(q.partition_by))]
    extra = F.lit(0)
    if spread or not keys:
        rows, keys = _ranges(rows, keys, order, len(q.variables) - 1), [*keys, "__range"]
        extra = F.col("__extra")
    w = Window.partitionBy(*keys).orderBy(*order)
    fields = ["__t", *[f"__o{i}" for i in range(ties)], *[f"c__{c.lower()}" for c in names]]
    first = q.variables[0]
    for k, v in enumerate(q.variables[1:], 1):
        rows = rows.withColumn(f"__s{k}", F.lead(F.struct(*fields, F.col(f"__is_{v}").alias("__is")), k).over(w))
    rows = rows.where((extra == 0) & F.col(f"__is_{first}") & reduce(lambda a, b: a & b, [F.col(f"__s{k}.__is") for k in range(1, len(q.variables))], F.lit(True)))
    select = [F.col(k) for k in keys if k != "__range"]
    for k, v in enumerate(q.variables):
        at = "" if k == 0 else f"__s{k}."
        select += [F.col(f"{at}__t").alias(f"{v}__t"), *[F.col(f"{at}__o{i}").alias(f"{v}__o{i}") for i in range(ties)], *[F.col(f"{at}c__{c.lower()}").alias(f"{v}__{c.lower()}") for c in names]]
    out = rows.select(*select)
    keep = [condition(p) for p in q.dependent] + [F.col(f"{q.variables[-1]}__t") <= F.col(f"{first}__t") + F.lit(q.window_us)]
    return out.where(reduce(lambda a, b: a & b, keep))


def _ranges(rows: DataFrame, keys: list[str], order: list[Column], more: int) -> DataFrame:
    """Deal rows to ranges of time between quantiles, and repeat in each range of a partition the ``more`` rows of the
    partition after its end (__extra = 1).

    What follows a range is among the first ``more`` rows of the later ones: Spark limits those before they are shuffled,
    so only the bounds go through the driver, and a partition's first rows are as many as ranges times ``more``."""
    rows = rows.withColumn("__range", _range_of(_cuts(rows, "__t"), "__t"))
    own = rows.withColumn("__extra", F.lit(0))
    if not more:
        return own
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*order))).where(F.col("__n") <= more)
    along = Window.partitionBy(*keys).orderBy("__range", "__n")
    first = first.withColumn("__list", F.collect_list(F.struct(*rows.columns)).over(along.rowsBetween(0, more - 1))).where("__n = 1")
    lent = first.withColumn("__after", F.lead("__list").over(Window.partitionBy(*keys).orderBy("__range")))
    lent = lent.select(F.col("__range").alias("__to"), F.explode("__after").alias("__row")).select(*[F.col("__to").alias(c) if c == "__range" else F.col(f"__row.{c}").alias(c) for c in rows.columns], F.lit(1).alias("__extra"))
    return own.unionByName(lent)


def _cuts(rows: DataFrame, time: str) -> list[int]:
    """Bounds between as many ranges of time as there are shuffle partitions, with about equal numbers of rows."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sorted({int(x) for x in rows.approxQuantile(time, [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []


def _range_of(cuts: list[int], time: str) -> Column:
    """Number of the range between ``cuts`` that a time falls in, by bisection."""
    steps = [1 << i for i in reversed(range(max(1, len(cuts).bit_length())))]
    bounds = "array(" + ", ".join([f"{c}L" for c in cuts] + ["cast(null as bigint)"] * (2 * steps[0] - len(cuts))) + ")"
    return F.expr(f"aggregate(array({', '.join(map(str, steps))}), 0, (p, s) -> if(coalesce({bounds}[p + s - 1] <= {time}, false), p + s, p))")


def _same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on columns that both have, null being equal to null; the right ones are dropped."""
    right = right.withColumnsRenamed({c: f"__r_{c}" for c in names})
    out = left.join(right, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in names]), how)
    return out.drop(*[f"__r_{c}" for c in names])


def _followers(nodes: DataFrame, keys: list[str], to_last: bool) -> DataFrame:
    """(keys, s, n) for matches (keys, s, e) that begin at s and end at e: the first of the others that begins after e, or,
    ``to_last``, at e.

    Beginnings and ends are dealt to ranges of time between quantiles, so that neither one large partition nor a table
    without a partition key is one task; where a range has no later beginning, the least one of a later range is it."""
    cuts = _cuts(nodes.select(F.col("s.t").alias("t")), "t")
    begins = nodes.select(*keys, F.col("s").alias("at"), F.col("s").alias("begin"), F.lit(None).cast(nodes.schema["s"].dataType).alias("s"))
    ends = nodes.select(*keys, F.col("e").alias("at"), F.lit(None).cast(nodes.schema["s"].dataType).alias("begin"), "s")
    rows = begins.unionByName(ends).withColumn("t", F.col("at.t")).withColumn("range", _range_of(cuts, "t"))
    # going back in time; of equal places the beginning comes first only if it counts
    first = F.col("begin").isNull() if not to_last else F.col("begin").isNotNull()
    back = Window.partitionBy(*keys, "range").orderBy(F.desc("at"), F.desc(first)).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("n", F.last("begin", ignorenulls=True).over(back)).where("s is not null")
    later = Window.partitionBy(*keys).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    lows = rows.groupBy(*keys, "range").agg(F.min("begin").alias("low")).withColumn("low", F.last("low", ignorenulls=True).over(later))
    out = _same(near.select(*keys, "range", "s", "n"), lows, [*keys, "range"])
    return out.withColumn("n", F.coalesce("n", "low")).where("n is not null").select(*keys, "s", "n")


def without_overlap(matches: DataFrame, q: Query, ties: int, to_last: bool) -> DataFrame:
    """Matches in the order of their heads, leaving out those that begin before the row after the last one taken
    (past_last_row), or before its last row (to_last).

    Every match knows the first one that may follow it.  The chain from each partition's first match is walked in rounds
    that double its length: pointers are joined with themselves, and the matches reached so far with the pointers.  Each
    round is a plain join and is written to the shared folder; there are as many as the logarithm of the longest chain."""
    keys, head, tail = partition(matches), q.variables[0], q.variables[-1]
    at = lambda v: F.struct(F.col(f"{v}__t").alias("t"), *[F.col(f"{v}__o{i}").alias(f"o{i}") for i in range(ties)])
    nodes = materialize(matches.select(*keys, at(head).alias("s"), at(tail).alias("e")).groupBy(*keys, "s").agg(F.min("e").alias("e")), "matches")
    jump = materialize(_followers(nodes, keys, to_last), "jumps")
    taken = nodes.groupBy(*keys).agg(F.min("s").alias("s"))
    taken = materialize(taken.where("s is not null"), "taken")
    n = taken.count()
    while True:
        more = _same(taken, jump, [*keys, "s"]).select(*keys, F.col("n").alias("s"))
        taken = materialize(taken.unionByName(more).distinct(), "taken")
        before, n = n, taken.count()
        if n == before:
            break
        jump = materialize(_same(jump.select(*keys, F.col("s").alias("from"), F.col("n").alias("s")), jump, [*keys, "s"]).select(*keys, F.col("from").alias("s"), "n"), "jumps")
    return _same(matches.withColumn("s", at(head)), taken, [*keys, "s"], "left_semi").drop("s")


STRATEGY = {ANY: any_match, NEXT_ROW: next_row, NEXT_MATCH: next_match, STRICT: strict}
