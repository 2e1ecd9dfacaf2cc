import datetime as dt
import random

import pytest

from seqmatch import match_recognize
from seqmatch.plans.ast import ANY, NEXT_MATCH, NEXT_ROW, STRICT
from seqmatch.streaming.streams import any_match_stream, match_stream

SCHEMA = "event_id long, ts timestamp, p string, type string, v double"
TEXT = "SELECT * FROM t MATCH_RECOGNIZE(PARTITION BY p ORDER BY ts, event_id MEASURES A.event_id AS a, B.event_id AS b, C.event_id AS c PATTERN (A N1*? B N2*? C) WITHIN INTERVAL '10' SECOND DEFINE A AS A.type = 'A', B AS B.type = 'B' AND B.v >= A.v, C AS C.type = 'C')"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three files in order of time, rows within a file in any order, and a last row that moves the watermark on."""
    r, path = random.Random(5), str(tmp_path_factory.mktemp("stream"))
    rows = [(i, START + dt.timedelta(seconds=i // 2), r.choice("xy"), r.choice("ABCZ"), float(r.randrange(3))) for i in range(60)]
    parts = [rows[:20], rows[20:40], rows[40:], [(1000 + i, START + dt.timedelta(hours=1), k, "Z", 0.0) for i, k in enumerate("xy")]]
    for part in parts:
        r.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def collect(spark, out, name):
    q = out.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted(tuple(x) for x in spark.table(name).collect())


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


@pytest.mark.parametrize("strategy", [ANY, NEXT_ROW, NEXT_MATCH, STRICT])
def test_stateful(spark, folder, strategy):
    want = sorted(tuple(x) for x in match_recognize(spark.read.parquet(folder), TEXT, strategy).collect())
    assert collect(spark, match_stream(source(spark, folder), TEXT, strategy), f"s_{strategy}") == want


def test_stream_joins(spark, folder):
    want = sorted(tuple(x) for x in match_recognize(spark.read.parquet(folder), TEXT, ANY).collect())
    assert want and collect(spark, any_match_stream(source(spark, folder), TEXT, "10 seconds"), "s_join") == want


NULLS = "SELECT * FROM t MATCH_RECOGNIZE(PARTITION BY p ORDER BY ts, event_id MEASURES A.event_id AS a, B.event_id AS b PATTERN (A N1*? B) WITHIN INTERVAL '10' SECOND DEFINE A AS A.type = 'A', B AS B.type = 'B' AND {})"
CONDITIONS = ["B.v <> A.v", "B.w = A.w", "NOT (B.v = A.v)", "NOT (B.v > A.v AND B.w = A.w)", "B.v = A.v OR B.w <> A.w", "B.v % 2 < A.v / 2 + 1", "(B.v IS NULL AND A.v IS NOT NULL) OR B.k = A.k", "B.k <> A.k", "NOT (NOT (B.v >= A.v))"]


@pytest.fixture(scope="module")
def with_nulls(spark, tmp_path_factory):
    r, path = random.Random(7), str(tmp_path_factory.mktemp("nulls"))
    some = lambda *x: r.choice([*x, None])
    rows = [(i, START + dt.timedelta(seconds=i), r.choice("xy"), r.choice("AB"), some(0.0, 1.0, 3.0), some("u", "v"), some(1, 2)) for i in range(40)]
    schema = SCHEMA + ", w string, k int"
    for part in (rows, [(1000 + i, START + dt.timedelta(hours=1), k, "Z", 0.0, None, None) for i, k in enumerate("xy")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return path, schema


@pytest.mark.parametrize("strategy", [ANY, NEXT_ROW, NEXT_MATCH, STRICT])
def test_nulls_in_streams(spark, with_nulls, strategy):
    """All conditions at once would hide each other, so each has its stream; nulls are as in batch."""
    path, schema = with_nulls
    some = 0
    for i, condition in enumerate(CONDITIONS):
        text = NULLS.format(condition)
        want = sorted(tuple(x) for x in match_recognize(spark.read.parquet(path), text, strategy).collect())
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        assert collect(spark, match_stream(stream, text, strategy), f"n_{strategy}_{i}") == want, condition
        some += len(want)
    assert some
