"""Strategies against a brute-force matcher that follows their definitions."""

import itertools
import random

import pytest

from seqmatch import match_recognize, registry
from seqmatch.operators import candidates, intervals, match, prune
from seqmatch.plans import cost
from seqmatch.plans.ast import ANY, NEXT_MATCH, NEXT_ROW, STRICT, QueryError
from seqmatch.plans.parser import parse
from seqmatch.streaming.matcher import Matcher, compiled

SCHEMA = "event_id long, ts long, p string, type string, v double"


def sql(names="ABC", within="'10' SECOND", conditions=None, partition=True, measures=True):
    conditions = conditions or {}
    defines = ", ".join(f"{x} AS {x}.type = '{x}'" + (f" AND {conditions[x]}" if x in conditions else "") for x in names)
    pattern = " ".join(x if i == 0 else f"N{i}*? {x}" for i, x in enumerate(names))
    m = "MEASURES " + ", ".join(f"{x}.event_id AS {x.lower()}" for x in names) + " " if measures else ""
    return f"SELECT * FROM t MATCH_RECOGNIZE({'PARTITION BY p ' if partition else ''}ORDER BY ts, event_id {m}PATTERN ({pattern}) WITHIN INTERVAL {within} DEFINE {defines})"


def brute(rows, q, strategy, preference="first_completed"):
    """All choices of rows, straight from the definitions."""
    own = {v: [r for r in rows if r["type"] == v] for v in q.variables}
    place = lambda r: (r["ts"], r["event_id"])
    dps = [compiled(p) for p in q.dependent]
    part = (lambda r: r["p"]) if q.partition_by else (lambda r: 0)
    us = q.window_us // 1_000_000

    def ok(rs):
        known = dict(zip(q.variables, rs, strict=False))
        return all(t(known) for t, p in zip(dps, q.dependent, strict=True) if p.vars <= set(known))

    def fits(rs):
        return all(place(a) < place(b) for a, b in zip(rs, rs[1:], strict=False)) and rs[-1]["ts"] - rs[0]["ts"] <= us and len({part(r) for r in rs}) == 1 and ok(rs)

    everything = [rs for rs in itertools.product(*own.values()) if fits(rs)]
    if strategy == ANY:
        out = everything
    elif strategy == NEXT_ROW:
        best = {}
        for rs in everything:
            rest = rs[1:][::-1] if preference == "first_completed" else rs[1:]
            k = [place(r) for r in rest]
            h = rs[0]["event_id"]
            if h not in best or k < best[h][0]:
                best[h] = (k, rs)
        out = [x[1] for x in best.values()]
    elif strategy == NEXT_MATCH:
        out = []
        for head in own[q.variables[0]]:
            rs = [head]
            for v in q.variables[1:]:
                nxt = min((r for r in own[v] if fits([*rs, r])), key=place, default=None)
                if nxt is None:
                    break
                rs.append(nxt)
            else:
                out.append(tuple(rs))
    else:
        out = []
        for key in {part(r) for r in rows}:
            line = sorted((r for r in rows if part(r) == key), key=place)
            for i in range(len(line) - len(q.variables) + 1):
                rs = line[i : i + len(q.variables)]
                if all(r["type"] == v for r, v in zip(rs, q.variables, strict=True)) and fits(rs):
                    out.append(tuple(rs))
    return sorted(tuple(r["event_id"] for r in rs) for rs in out)


def run(spark, rows, text, strategy, **k):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in match_recognize(df, text, strategy, unit="s", **k).collect())


def rows_of(*items):
    return [dict(zip(("event_id", "ts", "p", "type", "v"), x, strict=True)) for x in items]


FIXTURES = {
    "basic": (rows_of((1, 1, "x", "A", 0.0), (2, 2, "x", "B", 0.0), (3, 3, "x", "C", 0.0)), sql(), (1, 1, 1, 1)),
    "skip": (rows_of((1, 1, "x", "A", 0.0), (2, 2, "x", "B", 0.0), (4, 2, "x", "Z", 0.0), (5, 3, "x", "C", 0.0)), sql(), (1, 1, 1, 0)),
    "edge_in": (rows_of((1, 0, "x", "A", 0.0), (2, 5, "x", "B", 0.0), (3, 10, "x", "C", 0.0)), sql(), (1, 1, 1, 1)),
    "edge_out": (rows_of((1, 0, "x", "A", 0.0), (2, 5, "x", "B", 0.0), (3, 10, "x", "C", 0.0)), sql(within="'9' SECOND"), (0, 0, 0, 0)),
    "greedy": (rows_of((1, 1, "x", "A", 0.0), (2, 2, "x", "B", 9.0), (3, 3, "x", "B", 1.0), (4, 4, "x", "C", 2.0)), sql(conditions={"C": "C.v > B.v"}), (1, 1, 0, 0)),
    "tie": (rows_of((1, 1, "x", "A", 0.0), (2, 1, "x", "B", 0.0)), sql("AB"), (1, 1, 1, 1)),
    "tie_reversed": (rows_of((2, 1, "x", "A", 0.0), (1, 1, "x", "B", 0.0)), sql("AB"), (0, 0, 0, 0)),
    "partitions": (rows_of((1, 1, "x", "A", 0.0), (2, 2, "y", "B", 0.0)), sql("AB"), (0, 0, 0, 0)),
    "heads": (rows_of((1, 1, "x", "A", 0.0), (2, 2, "x", "A", 0.0), (3, 3, "x", "B", 0.0)), sql("AB"), (2, 2, 2, 1)),
    "arith": (rows_of((1, 1, "x", "A", 1.0), (2, 2, "x", "B", 2.0)), sql("AB", conditions={"B": "B.v = A.v + 1"}), (1, 1, 1, 1)),
    "empty": (rows_of((1, 1, "x", "A", 0.0), (2, 2, "x", "B", 0.0)), sql(), (0, 0, 0, 0)),
}


@pytest.mark.parametrize("name", FIXTURES)
def test_fixtures(spark, name):
    rows, text, want = FIXTURES[name]
    for strategy, n in zip((ANY, NEXT_ROW, NEXT_MATCH, STRICT), want, strict=True):
        assert len(run(spark, rows, text, strategy)) == n, strategy


def test_preference(spark):
    rows = rows_of((1, 1, "x", "A", 0.0), (2, 2, "x", "B", 1.0), (3, 3, "x", "B", 2.0), (4, 4, "x", "C", 2.0), (5, 5, "x", "C", 1.0))
    text = sql(conditions={"C": "C.v = B.v"})
    assert run(spark, rows, text, NEXT_ROW) == [(1, 3, 4)]
    assert run(spark, rows, text, NEXT_ROW, preference="sql_standard") == [(1, 2, 5)]
    assert run(spark, rows, text, NEXT_MATCH) == [(1, 2, 5)]


def test_stock_sample(spark):
    prices = {12345: [(4, 1000, 28), (5, 1200, 25), (6, 1300, 85)], 123456: [(7, 2000, 28), (8, 2050, 25), (9, 2100, 20), (10, 2150, 83)], 1234: [(11, 3100, 28), (12, 3200, 25), (13, 3250, 85)], 123: [(14, 4000, 34), (15, 4050, 25), (16, 4100, 16), (17, 4150, 83)]}
    df = spark.createDataFrame([(i, t, s, p) for s, x in prices.items() for i, t, p in x], "id int, eventTime long, symbol int, price int")
    text = "SELECT * FROM stock MATCH_RECOGNIZE(PARTITION BY symbol ORDER BY eventTime, id MEASURES A.id AS a PATTERN (A N1*? B N2*? C) WITHIN INTERVAL '200' SECOND DEFINE A AS A.price < 30, B AS B.price < A.price, C AS C.price > 80)"
    assert sorted(r.a for r in match_recognize(df, text, STRICT, unit="s").collect()) == [8, 11, 15]


CONDITIONS = [{}, {"B": "B.v < A.v"}, {"C": "C.v > B.v"}, {"B": "B.v = A.v"}, {"B": "B.v >= A.v", "C": "C.v = B.v + 1"}, {"C": "C.v <= A.v"}, {"C": "(C.v < A.v OR C.v > B.v)"}]


@pytest.mark.parametrize("seed", range(2))
def test_random_streams(spark, seed):
    r = random.Random(seed)
    rows = [dict(event_id=i, ts=r.randrange(40), p=r.choice("xy"), type=r.choice("AABBCCZ"), v=float(r.randrange(4))) for i in range(45)]
    for conditions in r.sample(CONDITIONS, 3):
        for partition in (True, False):
            text = sql(conditions=conditions, within=f"'{r.choice([0, 3, 8])}' SECOND", partition=partition)
            q = parse(text)
            for strategy in (ANY, NEXT_ROW, NEXT_MATCH, STRICT):
                want = brute(rows, q, strategy)
                assert run(spark, rows, text, strategy) == want, (strategy, conditions, partition)
                m = Matcher(q, strategy)
                got = []
                for key in "xy" if partition else "*":
                    m = Matcher(q, strategy)
                    for row in sorted((x for x in rows if key in ("*", x["p"])), key=lambda x: (x["ts"], x["event_id"])):
                        if strategy != STRICT and row["type"] == "Z":
                            continue
                        got += m.push(row | {"__t": row["ts"] * 1_000_000}, [row["type"] == v for v in q.variables])
                assert sorted(tuple(x["event_id"] for x in y) for y in got) == want, ("matcher", strategy)


@pytest.mark.parametrize("mode", prune.MODES)
def test_pruning_changes_nothing(spark, mode):
    r = random.Random(99)
    rows = [dict(event_id=i, ts=r.randrange(60), p=r.choice("xy"), type=r.choice("ABCZ"), v=float(r.randrange(5))) for i in range(60)]
    text = sql(conditions={"B": "B.v = A.v + 1", "C": "C.v <= A.v"}, within="'7' SECOND")
    assert run(spark, rows, text, NEXT_ROW, prune_mode=mode) == brute(rows, parse(text), NEXT_ROW)


def test_pruning_is_refused_where_it_would_matter(spark):
    df = spark.createDataFrame([], SCHEMA)
    for strategy, mode in ((NEXT_MATCH, "slices"), (STRICT, "join"), (NEXT_ROW, "no such")):
        with pytest.raises(QueryError):
            match_recognize(df, sql(), strategy, prune_mode=mode, unit="s")
    with pytest.raises(QueryError):
        match_recognize(df.drop("v"), sql(conditions={"B": "B.v > A.v"}), unit="s")


def test_nulls_and_whole_rows(spark):
    rows = [(1, 1, "x", "A", None), (2, 2, "x", "B", 1.0), (3, None, "x", "B", 1.0), (4, 3, None, "A", 0.0), (5, 4, None, "B", 2.0), (6, 5, "x", None, 2.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = match_recognize(df, sql("AB", conditions={"B": "B.v > A.v"}, measures=False), ANY, unit="s").collect()
    assert [(r.A.event_id, r.B.event_id) for r in out] == [(4, 5)]


def test_plan_has_no_nested_loop_and_pushes_filters(spark, tmp_path):
    rows = [dict(event_id=i, ts=i, p="x", type="ABC"[i % 3], v=float(i)) for i in range(30)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    for partition in (True, False):
        plan = match_recognize(spark.read.parquet(path), sql(conditions={"B": "B.v > A.v"}, partition=partition), ANY, unit="s")._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "EqualTo(type,A)" in plan


def test_classify_and_cardinality(spark):
    rows = rows_of((1, 1, "x", "A", 0.0), (2, 1, "x", "B", 0.0), (3, 2, "x", "Z", 0.0))
    q, df = parse(sql("AB")), spark.createDataFrame(rows, SCHEMA)
    assert [(r.event_id, r.is_a, r.is_b) for r in candidates.classify(df, q).orderBy("event_id").collect()] == [(1, True, False), (2, False, True)]
    assert candidates.counts(df, q) == {"A": 1, "B": 1}


def test_many_clients(spark):
    from seqmatch.operators.sessions import run_many

    rows, _, _ = FIXTURES["heads"]
    df = spark.createDataFrame(rows, SCHEMA)
    jobs = {f"client{i}": (lambda s=s: match_recognize(df, sql("AB"), s, unit="s")) for i, s in enumerate((ANY, NEXT_ROW, NEXT_MATCH, STRICT))}
    assert list(run_many(spark, jobs).values()) == [2, 2, 2, 1]
    with pytest.raises(QueryError):
        run_many(spark, {**jobs, "bad": lambda: match_recognize(df, sql("AB"), "no such", unit="s")})


@pytest.mark.parametrize("partition", [True, False])
@pytest.mark.parametrize("skip", ["SKIP PAST LAST ROW", "SKIP TO LAST C"])
def test_skips_leave_no_overlap(spark, skip, partition):
    r = random.Random(3)
    rows = [(i, i // 3, r.choice(["x", "x", "x", "y", None]), r.choice("ABCD"), float(r.randrange(4))) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    # a C with v >= 2 can be an A as well, so SKIP TO LAST differs from SKIP PAST LAST ROW
    text = f"SELECT * FROM t MATCH_RECOGNIZE({'PARTITION BY p ' if partition else ''}ORDER BY ts, event_id MEASURES A.event_id AS a, B.event_id AS b, C.event_id AS c AFTER MATCH {skip} PATTERN (A N1*? B N2*? C) WITHIN INTERVAL '10' SECOND DEFINE A AS A.type = 'A' OR (A.type = 'C' AND A.v >= 2), B AS B.type = 'B', C AS C.type = 'C')"
    every = [tuple(x) for x in match_recognize(df, text.replace(skip, "SKIP TO NEXT ROW"), unit="s").collect()]
    place = {i: (t, i) for i, t, *_ in rows}
    part = {i: p if partition else 0 for i, _, p, *_ in rows}
    want = []
    for p in set(part.values()):
        free = None
        for m in sorted((m for m in every if part[m[0]] == p), key=lambda m: place[m[0]]):
            if free is None or place[m[0]] > free or ("LAST C" in skip and place[m[0]] == free):
                want.append(m)
                free = place[m[2]]
    got = sorted(tuple(x) for x in match_recognize(df, text, unit="s").collect())
    assert got == sorted(want) and 3 < len(got) < len(every)
    assert match_recognize(df.limit(0), text, unit="s").count() == 0


@pytest.mark.parametrize("strategy", [STRICT, NEXT_MATCH, NEXT_ROW])
def test_spread_partitions_give_the_same(spark, strategy):
    r = random.Random(17)
    rows = [(i, i // 2 + 50 * (i // 60), r.choice(["x", "x", "x", "y", None]), r.choice("ABC"), 0.0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for names in ("ABC", "AB", "A"):
        a, b = (sorted(tuple(x) for x in match_recognize(df, sql(names), strategy, unit="s", spread=spread).collect()) for spread in (False, True))
        assert a == b and len(a) > 5
    assert match_recognize(df.limit(0), sql(), strategy, unit="s", spread=True).count() == 0


@pytest.mark.parametrize("strategy", [NEXT_MATCH, NEXT_ROW])
def test_without_a_key_by_window_gives_the_same_as_by_joins(spark, strategy):
    r = random.Random(23)
    rows = [(i, r.choice([None, i // 3]) if i % 20 == 0 else i // 3 + 40 * (i // 70), r.choice("xy"), r.choice("AABCDZ") if i % 200 > 60 else "Z", 0.0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for names in ("ABCD", "ABC", "AB", "A"):
        a, b = (match_recognize(df, sql(names, partition=False), strategy, unit="s", by_window=by_window) for by_window in (False, True))
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and b.count() > 5
        assert match_recognize(df.limit(0), sql(names, partition=False), strategy, unit="s").count() == 0


def test_next_rows_far_behind_empty_ranges(spark):
    # with four ranges of time the rows after A, and after B, are ranges away
    rows = rows_of((1, 1, "x", "A", 0.0), *[(i, i, "x", "A", 0.0) for i in range(2, 9)], (9, 40, "x", "B", 0.0), *[(i, i + 50, "x", "A", 0.0) for i in range(10, 19)], (30, 90, "x", "C", 0.0), (31, 91, "x", "B", 0.0))
    for within in (100, 85, 60):
        text = sql(within=f"'{within}' SECOND", partition=False)
        assert run(spark, rows, text, NEXT_ROW) == run(spark, rows, text, NEXT_MATCH) == brute(rows, parse(text), NEXT_MATCH)


def test_next_rows_without_a_key_are_found_without_joins(spark, monkeypatch):
    def extend(*_):
        raise AssertionError("all rows of a window are paired")

    monkeypatch.setattr(match, "extend", extend)
    assert registry.QUERIES["skip_past_last_row_nopart"](spark, "/root/testdata/sf0.001").count() > 20


@pytest.mark.parametrize("strategy", [NEXT_MATCH, NEXT_ROW])
def test_without_a_key_equal_and_null_ties_are_as_by_joins(spark, strategy):
    r = random.Random(29)
    rows = [(r.choice([None, 1, 2, 3]), i // 12, "x", r.choice("ABCDZ"), r.choice([None, 1.0, 2.0, float("nan")])) for i in range(240)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for order in (["v", "event_id"], ["event_id"]):
        measures = ", ".join(f"{x}.{c} AS {x}_{c}" for x in "ABC" for c in ["ts", *order])
        text = f"SELECT * FROM t MATCH_RECOGNIZE(ORDER BY ts, {', '.join(order)} MEASURES {measures} PATTERN (A N1*? B N2*? C) WITHIN INTERVAL '2' SECOND DEFINE A AS A.type IN ('A', 'B'), B AS B.type IN ('B', 'C'), C AS C.type IN ('A', 'C'))"
        a, b = (sorted(map(repr, match_recognize(df, text, strategy, unit="s", by_window=by_window).collect())) for by_window in (False, True))
        assert a == b and len(a) > 40


@pytest.mark.parametrize("mode", [prune.TWO_TRIPS, prune.SEQUENTIAL, prune.SLICED, prune.DUAL])
def test_sets_of_keys_are_not_broadcast(spark, mode):
    rows = [(i, i * 3600, str(i % 7), "ABC"[i % 3], 0.0) for i in range(60)]
    q = parse(sql(within="'1' DAY"))
    cands = candidates.split(spark.createDataFrame(rows, SCHEMA), q, "s")
    for df in prune.reduce_candidates(cands, q, mode, 1).values():
        joins = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x and "LeftSemi" in x]
        assert not joins


def test_a_long_window_repeats_intervals_of_keys_a_few_times_only(spark):
    rows = [(i, i * 10 * 86400, str(i % 7), "ABC"[i % 3], 0.0) for i in range(60)]
    q = parse(sql(within="'1' DAY"))
    cands = candidates.split(spark.createDataFrame(rows, SCHEMA), q, "s")
    one = prune._within(cands, q, "A", prune._intervals(cands, q, "A"))
    width = prune._width(q, ["__p0"])
    assert one.count() == 20 and prune._intervals(cands, q, "B").where(f"floor(end / {width}) - floor(start / {width}) > 2").isEmpty()


def test_report_broadcasts_no_sets_of_keys(spark):
    rows = [(i, i * 3600, str(i % 7), "ABC"[i % 3], 0.0) for i in range(60)]
    q = parse(sql(within="'1' DAY"))
    df = prune.report(candidates.split(spark.createDataFrame(rows, SCHEMA), q, "s"), q, 1, (prune.NONE, prune.TWO_TRIPS, prune.SEQUENTIAL, prune.DUAL))
    assert _set_broadcasts(df) == []
    out = {(r.mode, r.variable): r.rows for r in df.collect()}
    assert len(out) == 12 and all(out[prune.NONE, v] == 20 and out[m, v] <= 20 for m, v in out)


def test_report_counts_one_mode_at_a_time(spark):
    rows = [(i, i * 3600, str(i % 7), "ABC"[i % 3], float(i % 5)) for i in range(60)]
    q = parse(sql(within="'1' DAY"))
    cands = candidates.split(spark.createDataFrame(rows, SCHEMA), q, "s")
    df = prune.report(cands, q, 1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    counts = {v: x.count() for v, x in cands.items()}
    expected = {(m, v): x.count() for m in prune.MODES for v, x in prune.reduce_candidates(cands, q, m, 1, counts, cost.AlwaysOn()).items()}
    assert {(r.mode, r.variable): r.rows for r in df.collect()} == expected and len(expected) == 24
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema] == [("mode", "string", False), ("variable", "string", False), ("rows", "bigint", False)]


def test_merging_intervals_of_keys_broadcasts_nothing(spark):
    rows = spark.range(60).selectExpr("cast(id % 7 as string) k", "id * 100 start", "id * 100 + 150 end")
    df = intervals.coalesce(rows, ["k"], 1000)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 60 and intervals.coalesce(rows.drop("k"), bucket=1000).select("start", "end").collect() == [(0, 6050)]


def test_bounds_of_the_report_do_not_plan_its_modes_again(spark):
    df = registry.QUERIES["prune_report_bounds"](spark, "/root/testdata/sf0.001")
    assert "LeftSemi" not in df._jdf.queryExecution().executedPlan().toString()


def test_report_runs_small_plans_only(spark):
    rows = [(i, i * 3600, str(i % 7), "ABC"[i % 3], float(i % 5)) for i in range(60)]
    q = parse(sql(within="'1' DAY"))
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    prune.report(candidates.split(spark.createDataFrame(rows, SCHEMA), q, "s"), q, 1).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    ran = store.executionsList()
    graphs = [store.planGraph(ran.apply(i).executionId()).allNodes() for i in range(before, ran.size())]
    most = max(sum(g.apply(i).name() == "Exchange" for i in range(g.size())) for g in graphs)
    assert most <= 12  # 31 in a plan of whole modes


def test_joins_of_reduced_candidates_of_keys_are_not_broadcast(spark):
    rows = spark.range(60).selectExpr("id event_id", "id * 3600 ts", "cast(id % 7 as string) user", "element_at(array('A', 'B', 'C'), cast(id % 3 as int) + 1) kind", "cast(id % 5 as double) value")
    q = parse(sql(within="'1' DAY"))
    for df in prune.reduce_candidates(candidates.split(rows.toDF(*[f.split(" ")[0] for f in SCHEMA.split(", ")]), q, "s"), q, prune.JOIN, 1).values():
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def _set_broadcasts(df):
    """Joins that broadcast a set repeated in buckets or slices."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x and "LeftSemi" in x and ("__b#" in x or "slice" in x)]
