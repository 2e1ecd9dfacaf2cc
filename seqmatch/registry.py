"""Queries over the synthetic tables, one or more for each operator, with equivalent SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import match_recognize
from .functions import columns as fc
from .functions.storage import new_path
from .operators import candidates, intervals, match, prune, results
from .operators.sessions import run_many
from .plans.parser import parse
from .sources import datasets, io
from .streaming.streams import any_match_stream, match_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HOUR, DAY, TEN_MINUTES = 3_600_000_000, 86_400_000_000, 600_000_000


def _table(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return keep


# ------------------------------------------------------------------ statements


def statement(defines: dict[str, str], within: str = "'1' DAY", partition: str | None = "user_id", measures: str | None = None, contiguous: bool = False, table: str = "events", order: str = "ts, event_id", key: str = "event_id", skip: str = "SKIP TO NEXT ROW") -> str:
    names = list(defines)
    pattern = " ".join(names) if contiguous else " ".join(x if i == 0 else f"N{i}*? {x}" for i, x in enumerate(names))
    measures = measures or ", ".join(f"{x}.{key} AS {x.lower()}_id" for x in names)
    head = f"PARTITION BY {partition} " if partition else ""
    return f"SELECT * FROM {table} MATCH_RECOGNIZE({head}ORDER BY {order} MEASURES {measures} ONE ROW PER MATCH AFTER MATCH {skip} PATTERN ({pattern}) WITHIN INTERVAL {within} DEFINE {', '.join(f'{x} AS {d}' for x, d in defines.items())})"


def _lt(a: str, b: str, t: str = "ts", key: str = "event_id") -> str:
    return f"({b}.{t} > {a}.{t} OR ({b}.{t} = {a}.{t} AND {b}.{key} > {a}.{key}))"


def combos(defines: dict[str, str], interval: str = "INTERVAL 1 DAY", partition: str | None = "user_id", table: str = "events", t: str = "ts", key: str = "event_id", extra: str = "") -> str:
    """SQL for all combinations, with times and ids of every variable."""
    names = [x.lower() for x in defines]
    joins = f"{table} {names[0]}"
    for x, y in zip(names, names[1:], strict=False):
        on = [_lt(x, y, t, key), f"{y}.{t} <= {names[0]}.{t} + {interval}"] + ([f"{y}.{partition} = {names[0]}.{partition}"] if partition else [])
        joins += f" JOIN {table} {y} ON {' AND '.join(on)}"
    cols = ", ".join(f"{x}.{key} AS {x}_id, {x}.{t} AS {x}_ts" for x in names)
    return f"SELECT {cols}{extra} FROM {joins} WHERE {' AND '.join(f'({d})' for d in defines.values())}"


def _ids(defines: dict[str, str]) -> str:
    return ", ".join(f"{x.lower()}_id" for x in defines)


def all_of(defines: dict[str, str], **k) -> str:
    return f"SELECT {_ids(defines)} FROM ({combos(defines, **k)})"


def first_of(defines: dict[str, str], sql_standard: bool = False, **k) -> str:
    rest = [x.lower() for x in defines][1:]
    rest = rest if sql_standard else rest[::-1]
    order = ", ".join(f"{x}_ts, {x}_id" for x in rest)
    return f"SELECT {_ids(defines)} FROM (SELECT *, row_number() OVER (PARTITION BY {next(iter(defines)).lower()}_id ORDER BY {order}) AS rn FROM ({combos(defines, **k)})) WHERE rn = 1"


def greedy_of(defines: dict[str, str], interval: str = "INTERVAL 1 DAY", partition: str | None = "user_id") -> str:
    names = [x.lower() for x in defines]
    conds = [d for d in defines.values()]
    a = names[0]
    out = f"WITH s1 AS (SELECT {a}.event_id AS {a}_id FROM events {a} WHERE {conds[0]})"
    for i, y in enumerate(names[1:], 1):
        done = names[:i]
        joins = " ".join(f"JOIN events {x} ON {x}.event_id = s.{x}_id" for x in done)
        on = [_lt(done[-1], y), f"{y}.ts <= {a}.ts + {interval}"] + ([f"{y}.{partition} = {a}.{partition}"] if partition else [])
        have = ", ".join(f"s.{x}_id" for x in done)
        out += f", s{i + 1} AS (SELECT {', '.join(f'{x}_id' for x in [*done, y])} FROM (SELECT {have}, {y}.event_id AS {y}_id, row_number() OVER (PARTITION BY s.{a}_id ORDER BY {y}.ts, {y}.event_id) AS rn FROM s{i} s {joins} JOIN events {y} ON {' AND '.join(on)} WHERE {conds[i]}) WHERE rn = 1)"
    return out + f" SELECT {', '.join(f'{x}_id' for x in names)} FROM s{len(names)}"


def strict_of(types: list[str], dependent: str = "true", interval: str = "INTERVAL 1 DAY", partition: str | None = "user_id") -> str:
    part = f"PARTITION BY {partition} " if partition else ""
    names = [chr(97 + i) for i in range(len(types))]
    lead = "".join(f", lead(event_id, {i}) OVER w AS {x}_id, lead(ts, {i}) OVER w AS {x}_ts, lead(event_type, {i}) OVER w AS {x}_type, lead(value, {i}) OVER w AS {x}_value" for i, x in enumerate(names))
    own = " AND ".join(f"{x}_type = '{t}'" for x, t in zip(names, types, strict=True))
    return f"SELECT {', '.join(f'{x}_id' for x in names)} FROM (SELECT 1 AS one{lead} FROM events WINDOW w AS ({part}ORDER BY ts, event_id)) WHERE {own} AND {names[-1]}_ts <= a_ts + {interval} AND ({dependent})"


BASIC = {"A": "a.event_type = 'view'", "B": "b.event_type = 'click' AND b.value < a.value", "C": "c.event_type = 'purchase'"}
TIED = BASIC | {"C": "c.event_type = 'purchase' AND c.value > b.value + 10"}
FREE = {"A": "a.event_type = 'view' AND a.value > 20", "B": "b.event_type = 'click'", "C": "c.event_type = 'purchase'"}
EQUAL = {"A": "a.event_type = 'view'", "B": "b.event_type = 'click' AND b.user_id = a.user_id", "C": "c.event_type = 'purchase' AND c.user_id = b.user_id AND c.value > a.value"}
NEAR = {"A": "a.event_type = 'view' AND a.value < 30", "B": "b.event_type = 'click' AND b.value < a.value", "C": "c.event_type = 'purchase' AND c.value > 80"}


def _match(name: str, defines: dict[str, str], oracle: str | None, strategy: str | None = None, **k) -> None:
    options = {x: k.pop(x) for x in ("prune_mode", "preference", "by_window", "spread") if x in k}
    text = statement(defines, **k)

    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return match_recognize(_table(spark, sf_dir, k.get("table", "events")), text, strategy, **options)


# ------------------------------------------------------------------ strategies

_match("any_match_part", BASIC, all_of(BASIC), "any_match")
_match("any_match_nopart", NEAR, all_of(NEAR, partition=None, interval="INTERVAL 10 MINUTE"), "any_match", within="'10' MINUTE", partition=None)
_match("next_row", TIED, first_of(TIED))
_match("next_row_sqlpref", TIED, first_of(TIED, sql_standard=True), preference="sql_standard")
_match("next_row_nopart", NEAR, first_of(NEAR, partition=None, interval="INTERVAL 10 MINUTE"), within="'10' MINUTE", partition=None)
_match("next_row_by_window", FREE, first_of(FREE))
_match("next_row_by_join", FREE, first_of(FREE), by_window=False)
_match("next_match", BASIC, greedy_of(BASIC), "next_match")
_match("next_match_tied", TIED, greedy_of(TIED), "next_match")
_match("next_match_by_window", FREE, greedy_of(FREE), "next_match")
_match("next_match_nopart", NEAR, greedy_of(NEAR, partition=None, interval="INTERVAL 10 MINUTE"), "next_match", within="'10' MINUTE", partition=None)
_STRICT = {"A": "A.event_type = 'view'", "B": "B.event_type = 'click' AND B.value < A.value", "C": "C.event_type = 'purchase'"}
_match("strict", _STRICT, strict_of(["view", "click", "purchase"], "b_value < a_value"), "strict")
_match("strict_pattern", _STRICT, strict_of(["view", "click", "purchase"], "b_value < a_value"), contiguous=True)
_match("strict_spread", _STRICT, strict_of(["view", "click", "purchase"], "b_value < a_value"), "strict", spread=True)
_match("next_match_spread", FREE, greedy_of(FREE), "next_match", spread=True)
_match("strict_nopart", _STRICT, strict_of(["view", "click", "purchase"], "b_value < a_value", partition=None), "strict", partition=None)

# ------------------------------------------------------------------ predicates and shapes

_SHAPES = {
    "dp_eq_arith": ({"A": "a.event_type = 'view'", "B": "b.event_type = 'click' AND floor(b.value / 10) = floor(a.value / 10) + 1"}, "'1' DAY", "INTERVAL 1 DAY"),
    "dp_ineq_arith": ({"A": "a.event_type = 'view'", "B": "b.event_type = 'click' AND b.value <= a.value * 2 + 1", "C": "c.event_type = 'purchase' AND c.value >= b.value - 5"}, "'12' HOUR", "INTERVAL 12 HOUR"),
    "dp_first_last": ({"A": "a.event_type = 'view'", "B": "b.event_type = 'click'", "C": "c.event_type = 'purchase' AND c.value < a.value"}, "'12' HOUR", "INTERVAL 12 HOUR"),
    "dp_or": ({"A": "a.event_type = 'view'", "B": "b.event_type = 'click' AND (b.value < a.value / 4 OR b.value > a.value * 4)"}, "'12' HOUR", "INTERVAL 12 HOUR"),
    "pred_neq_string": ({"A": "a.event_type <> 'view' AND a.event_type <> 'error'", "B": "b.event_type = 'error' AND b.event_type <> a.event_type"}, "'6' HOUR", "INTERVAL 6 HOUR"),
    "pred_between": ({"A": "a.event_type = 'view' AND a.value BETWEEN 10 AND 40", "B": "b.event_type = 'click' AND b.value BETWEEN a.value AND a.value + 20"}, "'1' DAY", "INTERVAL 1 DAY"),
    "two_var": ({"A": "a.event_type = 'signup'", "B": "b.event_type = 'purchase' AND b.value > a.value"}, "'1' DAY", "INTERVAL 1 DAY"),
    "four_var": ({"A": "a.event_type = 'signup'", "B": "b.event_type = 'view'", "C": "c.event_type = 'click' AND c.value < b.value", "D": "d.event_type = 'purchase' AND d.value > a.value"}, "'2' DAY", "INTERVAL 2 DAY"),
    "five_var": ({"A": "a.event_type = 'signup' AND a.value < 100", "B": "b.event_type = 'view' AND b.value < a.value", "C": "c.event_type = 'click' AND c.value > 40", "D": "d.event_type = 'purchase' AND d.value < 100", "E": "e.event_type = 'error' AND e.value < 100"}, "'4' DAY", "INTERVAL 4 DAY"),
    "window_ms": ({"A": "a.event_type = 'view'", "B": "b.event_type = 'click'"}, "'1500000' MILLISECOND", "INTERVAL 1500000 MILLISECOND"),
}
for _name, (_d, _w, _i) in _SHAPES.items():
    _match(_name, _d, all_of(_d, interval=_i), "any_match", within=_w)

_match(
    "measures",
    TIED,
    "SELECT a_value - b_value AS fall, c_value AS last_value, a_id FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY c_ts, c_id, b_ts, b_id) AS rn FROM (" + combos(TIED, extra=", a.value AS a_value, b.value AS b_value, c.value AS c_value") + ")) WHERE rn = 1",
    measures="A.value - AVG(B.value) AS fall, LAST(C.value) AS last_value, FIRST(A.event_id) AS a_id",
)
_ORDERS = {"A": "a.o_orderstatus = 'O'", "B": "b.o_orderstatus = 'F' AND b.o_totalprice < a.o_totalprice"}
_match("orders_sequence", _ORDERS, all_of(_ORDERS, interval="INTERVAL 90 DAY", partition="o_custkey", table="orders", t="o_orderdate", key="o_orderkey"), "any_match", within="'90' DAY", partition="o_custkey", table="orders", order="o_orderdate, o_orderkey", key="o_orderkey")


def skipping(defines: dict[str, str], to_last: bool, partition: str | None = "user_id") -> str:
    """The first matches of all heads, and of those a chain from each partition's first one, by recursion."""
    last = list(defines)[-1].lower()
    same = f"n.{partition} = m.{partition}" if partition else "true"
    part = f"PARTITION BY {partition} " if partition else ""
    begin = f"(n.a_ts > m.{last}_ts OR (n.a_ts = m.{last}_ts AND n.a_id {'>=' if to_last else '>'} m.{last}_id))"
    key = f", a.{partition} AS {partition}" if partition else ""
    first = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY {', '.join(f'{x.lower()}_ts, {x.lower()}_id' for x in list(defines)[:0:-1])}) AS rn FROM ({combos(defines, partition=partition, extra=key)})) WHERE rn = 1"
    return f"""WITH RECURSIVE m AS (SELECT * EXCLUDE (rn) FROM ({first})),
jump AS (SELECT a_id, next_id FROM (SELECT m.a_id, n.a_id AS next_id, row_number() OVER (PARTITION BY m.a_id ORDER BY n.a_ts, n.a_id) AS rn FROM m JOIN m n ON {same} AND {begin}) WHERE rn = 1),
chain AS (SELECT a_id FROM (SELECT a_id, row_number() OVER ({part}ORDER BY a_ts, a_id) AS rn FROM m) WHERE rn = 1 UNION SELECT next_id FROM chain JOIN jump USING (a_id))
SELECT {_ids(defines)} FROM m JOIN chain USING (a_id)"""


OVER = {"A": "a.value > 100", "B": "b.event_type = 'click'", "C": "c.value > 150"}
_match("skip_past_last_row", FREE, skipping(FREE, False), skip="SKIP PAST LAST ROW")
_match("skip_past_last_row_overlapping", OVER, skipping(OVER, False), skip="SKIP PAST LAST ROW")
_match("skip_to_last", OVER, skipping(OVER, True), skip="SKIP TO LAST C")
_match("skip_past_last_row_nopart", OVER, skipping(OVER, False, None), skip="SKIP PAST LAST ROW", partition=None)


@query("compat_arith", "SELECT a.o_orderkey, trunc(CAST(a.o_orderkey AS DOUBLE) / 3)::BIGINT AS third, trunc(CAST(a.o_orderkey AS DOUBLE) * 1.5)::BIGINT AS more FROM orders a")
def _compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import types as T

    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(k, fc.fixed_width(k, "/", 3, T.LongType()).alias("third"), fc.fixed_width(k, "*", 1.5, T.LongType()).alias("more"))


# ------------------------------------------------------------------ scans and candidates

_FLAGS = "event_type = 'view' AND value > 20", "event_type = 'click'", "event_type = 'purchase'"
_FREE_Q = parse(statement(FREE))


@query("filter_scan", f"SELECT event_id, event_type, value FROM events WHERE ({_FLAGS[0]}) OR {_FLAGS[1]} OR {_FLAGS[2]}")
def _filter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.scan(_table(spark, sf_dir), _FREE_Q).select("event_id", "event_type", "value")


@query("full_scan", "SELECT event_id, user_id, event_type, value FROM events")
def _full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir).select("event_id", "user_id", "event_type", "value")


@query("scan_candidates", f"SELECT event_id, ({_FLAGS[0]}) AS is_a, ({_FLAGS[1]}) AS is_b, ({_FLAGS[2]}) AS is_c FROM events WHERE ({_FLAGS[0]}) OR {_FLAGS[1]} OR {_FLAGS[2]}")
def _scan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.classify(_table(spark, sf_dir), _FREE_Q).select("event_id", "is_a", "is_b", "is_c")


@query("var_cardinality", f"SELECT count(*) FILTER (WHERE {_FLAGS[0]}) AS n_a, count(*) FILTER (WHERE {_FLAGS[1]}) AS n_b, count(*) FILTER (WHERE {_FLAGS[2]}) AS n_c FROM events")
def _var_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.cardinality(_table(spark, sf_dir), _FREE_Q)


@query("value_bucket", "SELECT event_id, CAST(floor((value - 5) / 10) AS BIGINT) AS bucket FROM events")
def _value_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir).select("event_id", fc.value_bucket("value", 5, 10).alias("bucket"))


@query("record_text", "SELECT event_id, concat_ws(',', event_id, user_id, event_type) AS record FROM events")
def _record_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir).select("event_id", fc.record("event_id", "user_id", "event_type").alias("record"))


@query("hashes")
def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir).select("event_id", fc.hash64("event_type", "user_id").alias("h64"), fc.hash64("event_type", seed=7).alias("h64_seeded"), fc.hash32("event_type").alias("h32"), fc.linear_hash("event_id").alias("linear"))


@query("linear_hash", "SELECT event_id, CAST((CAST(event_id % 4294967296 AS HUGEINT) * 2654435761 + 12345) % 4294967296 AS BIGINT) AS linear FROM events")
def _linear_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir).select("event_id", fc.linear_hash("event_id").alias("linear"))


@query("sort_by_time", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events")
def _sort_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return _table(spark, sf_dir).select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("n"))


# ------------------------------------------------------------------ intervals, slices, keys

_POINTS = {"view": "head", "purchase": "tail", "click": "middle"}
_SPAN = {"head": (0, TEN_MINUTES), "tail": (-TEN_MINUTES, 0), "middle": (-TEN_MINUTES, TEN_MINUTES)}


def _points(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    df = _table(spark, sf_dir)
    return df.where(F.col("event_type") == kind).select("event_id", "user_id", "value", fc.micros(df, "ts").alias("t"))


def _merged(spark: SparkSession, sf_dir: str, kind: str, keys: list[str] | None = None) -> DataFrame:
    return intervals.coalesce(intervals.replay(_points(spark, sf_dir, kind), "t", TEN_MINUTES, _POINTS[kind], keys), keys)


def _raw_sql(kind: str, keys: str = "") -> str:
    low, high = _SPAN[_POINTS[kind]]
    return f"SELECT {keys}epoch_us(ts) + ({low}) AS s, epoch_us(ts) + {high} AS e FROM events WHERE event_type = '{kind}'"


def _islands(raw: str, keys: str = "") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    k = f"{keys}, " if keys else ""
    return f"SELECT {k}min(s) AS \"start\", max(e) AS \"end\" FROM (SELECT *, sum(n) OVER ({part}ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN s <= max(e) OVER ({part}ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM ({raw}))) GROUP BY {k}g"


_V, _P, _C = (_islands(_raw_sql(k)) for k in ("view", "purchase", "click"))
_BOTH = f"SELECT greatest(a.\"start\", b.\"start\") AS \"start\", least(a.\"end\", b.\"end\") AS \"end\" FROM ({_V}) a JOIN ({_P}) b ON a.\"start\" <= b.\"end\" AND b.\"start\" <= a.\"end\""
_SLICED = "SELECT DISTINCT unnest(range(CAST(floor(s * 20 / {w}) AS BIGINT), CAST(floor(e * 20 / {w}) AS BIGINT) + 1)) AS slice FROM ({raw})".replace("s * 20 / {w}", "s * 20 // {w}").replace("e * 20 / {w}", "e * 20 // {w}")


@query("intervals_replay", f"SELECT s AS \"start\", e AS \"end\" FROM ({_raw_sql('click')})")
def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.replay(_points(spark, sf_dir, "click"), "t", TEN_MINUTES, "middle")


@query("intervals_coalesce", _V)
def _coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "view")


@query("intervals_coalesce_keyed", _islands(_raw_sql("view", "user_id, "), "user_id"))
def _coalesce_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "view", ["user_id"])


@query("intervals_union", _islands(f"{_raw_sql('view')} UNION ALL {_raw_sql('purchase')}"))
def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union(_merged(spark, sf_dir, "view"), _merged(spark, sf_dir, "purchase"))


@query("intervals_intersect", _BOTH)
def _intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.intersect(_merged(spark, sf_dir, "view"), _merged(spark, sf_dir, "purchase"))


@query("intervals_contains", f"SELECT event_id FROM events x WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM ({_BOTH}) i WHERE epoch_us(x.ts) BETWEEN i.\"start\" AND i.\"end\")")
def _contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = intervals.intersect(_merged(spark, sf_dir, "view"), _merged(spark, sf_dir, "purchase"))
    return intervals.contains(_points(spark, sf_dir, "click"), "t", both).select("event_id")


@query("intervals_length", f"SELECT CAST(sum(\"end\" - \"start\" + 1) AS BIGINT) AS length FROM ({_V})")
def _length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.time_length(_merged(spark, sf_dir, "view"))


@query("intervals_keycount", f"SELECT count(DISTINCT w) AS n_windows FROM (SELECT unnest(range(\"start\" // {TEN_MINUTES}, \"end\" // {TEN_MINUTES} + 1)) AS w FROM ({_V}))")
def _keycount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.key_number(_merged(spark, sf_dir, "view"), TEN_MINUTES)


@query("slices_set", _SLICED.format(w=TEN_MINUTES, raw=_raw_sql("view")))
def _slices_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.slice_set(intervals.replay(_points(spark, sf_dir, "view"), "t", TEN_MINUTES, "head"), TEN_MINUTES)


@query("slices_filter", f"SELECT event_id FROM events WHERE event_type = 'click' AND epoch_us(ts) * 20 // {TEN_MINUTES} IN ({_SLICED.format(w=TEN_MINUTES, raw=_raw_sql('view'))})")
def _slices_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = intervals.slice_set(intervals.replay(_points(spark, sf_dir, "view"), "t", TEN_MINUTES, "head"), TEN_MINUTES)
    return intervals.slice_filter(_points(spark, sf_dir, "click"), "t", s, TEN_MINUTES).select("event_id")


@query("slices_shrink", f"SELECT slice FROM ({_SLICED.format(w=TEN_MINUTES, raw=_raw_sql('view'))}) INTERSECT SELECT slice FROM ({_SLICED.format(w=TEN_MINUTES, raw=_raw_sql('purchase'))})")
def _slices_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (intervals.slice_set(intervals.replay(_points(spark, sf_dir, k), "t", TEN_MINUTES, _POINTS[k]), TEN_MINUTES) for k in ("view", "purchase"))
    return intervals.slice_and(a, b)


@query("pair_set", f"SELECT DISTINCT epoch_us(ts) // {HOUR} AS wid, user_id AS \"key\" FROM events WHERE event_type = 'view'")
def _pair_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.pair_set(_points(spark, sf_dir, "view"), "t", F.col("user_id"), HOUR)


@query("keyed_filter", f"SELECT event_id FROM events x WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM events y WHERE y.event_type = 'view' AND y.user_id + 1 = x.user_id AND abs(epoch_us(y.ts) // {HOUR} - epoch_us(x.ts) // {HOUR}) <= 1)")
def _keyed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = intervals.pair_set(_points(spark, sf_dir, "view"), "t", F.col("user_id") + 1, HOUR)
    return intervals.keyed_filter(_points(spark, sf_dir, "click"), "t", F.col("user_id"), pairs, HOUR).select("event_id")


@query("expected_keys", f"""WITH r AS (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS k FROM events GROUP BY 1), s AS (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) + 1 AS span FROM events)
SELECT round((SELECT sum(1 - exp(-n * {HOUR}::DOUBLE / span)) FROM r, s WHERE k <= 15) + (SELECT CASE WHEN count(*) > 0 THEN count(*) * (1 - exp(-sum(n) / count(*)::DOUBLE * {HOUR}::DOUBLE / max(span))) ELSE 0 END FROM r, s WHERE k > 15), 6) AS expected""")
def _expected_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir)
    return intervals.expected_keys(df.select(fc.micros(df, "ts").alias("t"), "user_id"), "t", F.col("user_id"), HOUR)


@query("window_filter", f"SELECT event_id, epoch_us(ts) - {TEN_MINUTES} AS \"start\", epoch_us(ts) + {TEN_MINUTES} AS \"end\" FROM events x WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM ({_V}) i WHERE epoch_us(x.ts) BETWEEN i.\"start\" AND i.\"end\")")
def _window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals.contains(_points(spark, sf_dir, "click"), "t", _merged(spark, sf_dir, "view"))
    return intervals.replay(rows, "t", TEN_MINUTES, "middle", ["event_id"])


# ------------------------------------------------------------------ pruning modes and their report

for _mode in prune.MODES:
    _match(f"prune_{_mode}", TIED, first_of(TIED), prune_mode=_mode)
    _match(f"prune_nopart_{_mode}", EQUAL, first_of(EQUAL, partition=None, interval="INTERVAL 8 HOUR"), prune_mode=_mode, partition=None, within="'8' HOUR")


@query("prune_report")
def _prune_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, q = _table(spark, sf_dir), parse(statement(TIED))
    return prune.report(candidates.split(df, q, whole=False), q, 1)


@query("prune_report_bounds", " UNION ALL ".join(f"SELECT '{m}' AS mode, '{v}' AS variable, true AS keeps_matches, true AS adds_nothing" for m in prune.MODES for v in "ABC"))
def _prune_report_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mode lets at least the rows of matches through, and no more than all."""
    rows = _prune_report(spark, sf_dir)
    needed = _participation(spark, sf_dir).withColumnRenamed("n_rows", "needed")
    every = rows.where(F.col("mode") == prune.NONE).select("variable", F.col("rows").alias("all_rows"))
    out = rows.join(needed, "variable").join(every, "variable")
    return out.select("mode", "variable", (F.col("rows") >= F.col("needed")).alias("keeps_matches"), (F.col("rows") <= F.col("all_rows")).alias("adds_nothing"))


# ------------------------------------------------------------------ results

_WHOLE = statement(TIED).replace("MEASURES A.event_id AS a_id, B.event_id AS b_id, C.event_id AS c_id ", "")


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_recognize(_table(spark, sf_dir), _WHOLE, "any_match")


@query("match_text", "SELECT concat_ws('|', concat_ws(',', a.event_id, a.event_type), concat_ws(',', b.event_id, b.event_type), concat_ws(',', c.event_id, c.event_type)) AS match FROM (" + all_of(TIED) + ") m JOIN events a ON a.event_id = a_id JOIN events b ON b.event_id = b_id JOIN events c ON c.event_id = c_id")
def _match_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.as_text(_whole(spark, sf_dir), ["A", "B", "C"], ["event_id", "event_type"])


@query("match_count", f"SELECT count(*) AS n FROM ({all_of(TIED)})")
def _match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_recognize(_table(spark, sf_dir), statement(TIED), "any_match").agg(F.count(F.lit(1)).alias("n"))


@query("projected_events_b", f"SELECT DISTINCT e.event_id, e.value FROM ({all_of(TIED)}) m JOIN events e ON e.event_id = m.b_id")
def _projected_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.projected(_whole(spark, sf_dir), ["B"], ["event_id", "value"])


@query("projected_events_ac", f"SELECT DISTINCT e.event_id FROM ({all_of(TIED)}) m JOIN events e ON e.event_id = m.a_id OR e.event_id = m.c_id")
def _projected_ac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.projected(_whole(spark, sf_dir), ["A", "C"], ["event_id"])


@query("participation_stats", " UNION ALL ".join(f"SELECT '{v}' AS variable, count(DISTINCT {v.lower()}_id) AS n_rows FROM ({all_of(TIED)})" for v in "ABC"))
def _participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.participation(_whole(spark, sf_dir), ["A", "B", "C"], "event_id")


@query("match_count_by_user", f"SELECT e.user_id, count(*) AS n FROM ({all_of(TIED)}) m JOIN events e ON e.event_id = m.a_id GROUP BY 1")
def _by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir).groupBy(F.col("A.user_id").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))


@query("match_rollup", f"SELECT CAST(CAST(e.ts AS DATE) AS VARCHAR) AS day, e.user_id, count(*) AS n FROM ({all_of(TIED)}) m JOIN events e ON e.event_id = m.a_id GROUP BY ROLLUP (CAST(e.ts AS DATE), e.user_id)")
def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _whole(spark, sf_dir).select(F.to_date("A.ts").cast("string").alias("day"), F.col("A.user_id").alias("user_id"))
    return m.rollup("day", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("projected_query", all_of({k: TIED[k] for k in ("A", "B")}))
def _projected_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, q = _table(spark, sf_dir), parse(statement(TIED)).projected(["A", "B"])
    m = match.any_match(candidates.split(df, q), q, 1)
    return m.select(F.col("A__event_id").alias("a_id"), F.col("B__event_id").alias("b_id"))


@query("union_all_lists", "SELECT event_id, event_type FROM events WHERE value < 20 UNION ALL SELECT event_id, event_type FROM events WHERE event_type = 'view'")
def _union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir).select("event_id", "event_type", "value")
    return results.merge(df.where("value < 20"), df.where("event_type = 'view'")).drop("value")


@query("union_lists", "SELECT event_id, event_type FROM events WHERE value < 20 UNION SELECT event_id, event_type FROM events WHERE event_type = 'view'")
def _union_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir).select("event_id", "event_type", "value")
    return results.merge(df.where("value < 20"), df.where("event_type = 'view'"), True).drop("value")


@query("union_flags", "SELECT event_id, value < 20 AS is_a, event_type = 'view' AS is_b FROM events WHERE value < 20 OR event_type = 'view'")
def _union_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir).select("event_id", (F.col("value") < 20).alias("is_a"), (F.col("event_type") == "view").alias("is_b"))
    return results.merge_flags(df.where("is_a"), df.where("is_b"), ["event_id"])


@query("first_per_head", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def _first_per_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.first_per_key(_table(spark, sf_dir), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


# ------------------------------------------------------------------ trades

_TRADES = {"A": "a.symbol = 1 AND a.price < 30", "B": "b.symbol = 7 AND b.price < a.price", "C": "c.symbol = 4 AND c.price > 80"}
_FIVE = _TRADES | {"D": "d.symbol = 3 AND d.price < 20", "E": "e.symbol = 2 AND e.price < 10"}
STOCK = {"stock_q1": (_TRADES, 100), "stock_q2": (_TRADES, 1000), "stock_q3": (_FIVE, 1000)}


def stock_query(name: str, trades: DataFrame) -> DataFrame:
    """All combinations of a statement over trades, without a partition key."""
    defines, seconds = STOCK[name]
    return match_recognize(trades, statement(defines, within=f"'{seconds}' SECOND", partition=None, table="trades", order="eventTime, id", key="id"), "any_match", unit="s")


def _stock_sql(name: str, n: int, seed: int) -> str:
    u = lambda k, most: f"floor(('0x' || substr(md5('{seed * 100 + k}:' || id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 * {most})::INTEGER"
    defines, seconds = STOCK[name]
    return f"WITH trades AS (SELECT id, id AS eventTime, {u(0, 20)} + 1 AS symbol, {u(1, 100)} AS price FROM range({n}) t(id)) " + all_of(defines, interval=str(seconds), partition=None, table="trades", t="eventTime", key="id")


for _name in STOCK:

    @query(_name, _stock_sql(_name, 5_000, 10))
    def _stock(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        return stock_query(name, datasets.stock(spark, 5_000, 10))


# ------------------------------------------------------------------ datasets


@query("reservoir_sample", "SELECT * FROM events ORDER BY md5('7:' || event_id), event_id LIMIT 500")
def _reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.reservoir(_table(spark, sf_dir), 500, ["event_id"], 7)


def _synthetic_sql(n: int, seed: int) -> str:
    u = lambda k: f"(('0x' || substr(md5('{seed * 100 + k}:' || id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"
    rank = lambda k, size, s: f"lpad(len(list_filter([{', '.join(map(repr, datasets.zipf_edges(size, s)))}]::DOUBLE[], lambda e: e <= {u(k)}))::VARCHAR, 2, '0')"
    return f"""SELECT 'T_' || {rank(0, 20, 1.2)} AS type, floor({u(1)} * 1001)::INTEGER AS a1, 'ATTR2_' || {rank(2, 50, 0.255)} AS a2, 'ATTR3_' || {rank(3, 50, 0.7)} || '_PADDING' AS a3,
floor((id - ln(1.0::DOUBLE - {u(4)})) * 10.0::DOUBLE)::BIGINT AS "eventTime", (floor(id / 1000000) * 1000000 * 4 + floor({u(6)} * 1000000 * 4))::BIGINT AS arrival FROM range({n}) t(id)"""


@query("synthetic_events", _synthetic_sql(5_000, 3))
def _synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.synthetic(spark, 5_000, 3)


@query("csv_load", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _csv_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table to CSV, and by its definition back into a columnar table, half of it appended."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = new_path(spark, "csv")
    half = F.col("o_custkey") % 2
    rows.where(half == 0).write.option("header", True).csv(f"{path}/first")
    rows.where(half == 1).write.option("header", True).csv(f"{path}/second")
    _, schema = io.parse_ddl("CREATE TABLE orders(o_orderkey LONG, o_custkey LONG, o_orderstatus VARCHAR(1), o_totalprice DOUBLE, o_orderpriority VARCHAR(15))", None)
    io.csv_to_parquet(spark, f"{path}/first", f"{path}/table", schema, sort_by="o_orderkey")
    io.append(io.read_csv(spark, f"{path}/second", schema), f"{path}/table")
    return spark.read.parquet(f"{path}/table")


@query("query_file", f"SELECT 0 AS statement, count(*) AS n FROM ({first_of(TIED)}) UNION ALL SELECT 1, count(*) FROM ({first_of(FREE)})")
def _query_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of a file, run as several clients."""
    df = _table(spark, sf_dir)
    found = io.read_queries(f"{statement(TIED)};\n{statement(FREE)}\n;\n")
    counts = run_many(spark, {str(i): (lambda text=text: match_recognize(df, text.strip().rstrip(";"))) for i, text in enumerate(found)})
    return spark.createDataFrame([(int(k), n) for k, n in counts.items()], "statement int, n long")


def _streamed(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The events as a stream of one file and one of rows that move the watermark past them; the sink's table."""
    path, rows = new_path(spark, "stream"), _table(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    rows.coalesce(1).write.parquet(f"{path}/in")
    late = rows.groupBy("user_id").agg(F.max("event_id").alias("event_id")).crossJoin(F.broadcast(rows.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts"))))
    late = late.select("event_id", "ts", "user_id", F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    late.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    running = make(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("stream_next_row", first_of(TIED))
def _stream_next_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda rows: match_stream(rows, statement(TIED)))


@query("stream_any_match", all_of(BASIC))
def _stream_any_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda rows: any_match_stream(rows, statement(BASIC), "1 second"))


@query("split_by_type", "SELECT event_type, count(*) AS n, 1 AS n_parts FROM events GROUP BY 1")
def _split_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = datasets.split_by_value(_table(spark, sf_dir), 4, "event_type")
    return parts.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part").cast("int").alias("n_parts"))


@query("split_by_window", f"SELECT epoch_us(ts) // {DAY} AS day, count(*) AS n, 1 AS n_parts FROM events GROUP BY 1")
def _split_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir)
    t = fc.micros(df, "ts")
    return datasets.split_by_window(df, 4, t, DAY).groupBy(F.floor(t / DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part").cast("int").alias("n_parts"))


@query("split_round_robin", "SELECT count(*) AS n, 4 AS n_parts, true AS even FROM events")
def _split_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parts whose sizes differ by no more than one row for each of the four groups that number their rows."""
    sizes = datasets.split_round_robin(_table(spark, sf_dir), 4, ["event_id"]).groupBy("part").count()
    return sizes.agg(F.sum("count").alias("n"), F.count(F.lit(1)).cast("int").alias("n_parts"), (F.max("count") - F.min("count") <= 4).alias("even"))


def names() -> list[str]:
    return list(QUERIES)


__all__ = ["ORACLE_SQL", "QUERIES", "names"]
