import math
import random

import pytest
from pyspark.sql import functions as F

from seqmatch.operators import intervals as iv
from seqmatch.operators import results
from seqmatch.plans import cost
from seqmatch.plans.parser import parse

Q = parse("SELECT * FROM t MATCH_RECOGNIZE(ORDER BY ts, id PATTERN (A N1*? B N2*? C N3*? D) WITHIN INTERVAL '3' SECOND DEFINE A AS A.x = 1, B AS B.x = A.x AND B.y > A.y, C AS C.x = 2, D AS D.z = C.z)")


def merged(pairs):
    out = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "start long, end long")


def rows(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


def test_sets_against_lists(spark):
    r = random.Random(1)
    for _ in range(2):
        a = [(s, s + r.randrange(9)) for s in (r.randrange(120) for _ in range(25))]
        b = [(s, s + r.randrange(30)) for s in (r.randrange(120) for _ in range(6))]
        ma, mb = merged(a), merged(b)
        fa, fb = iv.coalesce(frame(spark, a), bucket=7), iv.coalesce(frame(spark, b), bucket=7)
        assert rows(fa) == ma
        assert rows(iv.union(frame(spark, ma), frame(spark, mb))) == merged(ma + mb)
        both = sorted((max(x, u), min(y, v)) for x, y in ma for u, v in mb if max(x, u) <= min(y, v))
        assert rows(iv.intersect(frame(spark, ma), frame(spark, mb), width=11)) == both
        points = spark.createDataFrame([(i,) for i in range(150)], "t long")
        assert sorted(x.t for x in iv.contains(points, "t", frame(spark, ma), width=13).collect()) == [i for i in range(150) if any(x <= i <= y for x, y in ma)]
        assert iv.time_length(frame(spark, ma)).first()[0] == sum(y - x + 1 for x, y in ma)
        assert iv.key_number(frame(spark, ma), 10).first()[0] == len({w for x, y in ma for w in range(x // 10, y // 10 + 1)})
        slices = iv.slice_set(frame(spark, ma), 40)
        kept = {x.t for x in iv.slice_filter(points, "t", slices, 40).collect()}
        assert kept >= {i for i in range(150) if any(x <= i <= y for x, y in ma)}


def test_empty_sets(spark):
    none = frame(spark, [])
    assert rows(iv.coalesce(none)) == [] and iv.time_length(none).first()[0] == 0 and iv.key_number(none, 5).first()[0] == 0
    assert rows(iv.intersect(none, frame(spark, [(1, 2)]))) == []


def test_expected_cover_matches_simulation():
    r, total, rate, w = random.Random(3), 100_000, 0.002, 300
    points = [r.uniform(0, total) for _ in range(int(rate * total))]
    length = sum(b - a for a, b in merged([(p, p + w) for p in points]))
    assert abs(length - cost.expected_cover(rate, w, total)) / total < 0.05
    assert math.isclose(cost.expected_cover(rate, w, 1.0, both_sides=True), 1 - math.exp(-2 * rate * w))


def test_plans():
    counts = {"A": 100, "B": 90, "C": 10, "D": 50}
    assert cost.basic_plan(Q, counts) == ["C", "D", "A", "B"]
    assert cost.join_plan(Q, counts)[:2] == ["C", "D"]
    assert cost.filter_plan(Q, counts) == ["C", "D", "B", "A"] or cost.filter_plan(Q, counts)[0] == "C"
    best = cost.communication_cost(Q, counts, cost.cheapest_order(Q, counts))
    assert len(cost.all_plans(Q)) == 24 and all(best <= cost.communication_cost(Q, counts, o) for o in cost.all_plans(Q))


def test_cost_models():
    rare = cost.Reduction(1_000_000, 10**9, 1_000, 1e-6, False)
    dense = cost.Reduction(1_000_000, 10**9, 1_000_000, 1e-3, False)
    for name in ("naive", "constant", "adaptive"):
        assert cost.MODELS[name].worthwhile(rare), name
        assert not cost.MODELS[name].worthwhile(dense), name
    assert cost.MODELS["always"].worthwhile(dense) and not cost.MODELS["never"].worthwhile(rare)


def test_lists(spark):
    a = spark.createDataFrame([(1, True, False), (2, True, False)], "id int, is_a boolean, is_b boolean")
    b = spark.createDataFrame([(2, False, True)], "id int, is_a boolean, is_b boolean")
    assert sorted(map(tuple, results.merge_flags(a, b, ["id"]).collect())) == [(1, True, False), (2, True, True)]
    assert results.merge(a, a).count() == 4 and results.merge(a, a, True).count() == 2
    assert [r.id for r in results.first_per_key(a, ["is_a"], ["id"]).collect()] == [1]


def test_gate_and_retries(spark):
    import threading

    from seqmatch.operators import sessions

    df, failed, lock = spark.range(1000), [], threading.Lock()
    assert sessions.estimated_bytes(df) > 0

    def action(d):
        with lock:
            first = not failed
            failed.append(1)
        if first:
            raise RuntimeError("once")
        return d.count()

    assert sessions.run_many(spark, {"a": lambda: df, "b": lambda: df.limit(7)}, action, most_bytes=1) == {"a": 1000, "b": 7}
    with pytest.raises(ZeroDivisionError):
        sessions.run_many(spark, {"a": lambda: df}, lambda d: 1 // 0, retries=2)
    gate, order = sessions.Gate(10), []
    gate.enter(8)
    waiting = threading.Thread(target=lambda: (gate.enter(5), order.append("in"), gate.leave(5)))
    waiting.start()
    waiting.join(0.2)
    assert waiting.is_alive() and not order
    gate.leave(8)
    waiting.join(5)
    assert order == ["in"] and (gate.inside, gate.sum) == (0, 0)
    gate.enter(100)
    gate.leave(100)


def test_measured_costs(spark):
    from seqmatch.operators.measure import measured

    model = measured(spark, 2000)
    assert min(model.look_ns, model.keyed_look_ns, model.keyed_build_ns, model.build_ns, model.match_ns) >= 1
    few = cost.Reduction(1_000_000, 10**9, 1000, 1e-9, False)
    assert few.kept_share < cost.Reduction(1_000_000, 10**9, 1000, 1e-9, False, both_sides=True).kept_share
    assert isinstance(model.worthwhile(few), bool)


def test_expected_keys(spark):
    rows = [(t, k) for k in range(30) for t in range(0, 1000, 10 + 10 * (k % 3))]
    df = spark.createDataFrame([*rows, (3, None)], "t long, k int")
    counts = sorted((sum(1 for _, x in rows if x == k) for k in range(30)), reverse=True)
    span = max(t for t, _ in rows) + 1
    want = sum(1 - math.exp(-n * 50 / span) for n in counts[:15]) + 15 * (1 - math.exp(-sum(counts[15:]) / 15 * 50 / span))
    assert math.isclose(iv.expected_keys(df, "t", F.col("k"), 50).first().expected, want, rel_tol=1e-5)
    assert iv.expected_keys(df, "t", F.col("k"), 10**9).first().expected == 30


def test_tables_are_dropped(spark):
    from seqmatch.functions import storage

    storage.drop_tables(spark)
    kept = storage.materialize(spark.range(5), "x")
    assert kept.count() == 5 and storage.drop_tables(spark) == 1 and storage.drop_tables(spark) == 0
