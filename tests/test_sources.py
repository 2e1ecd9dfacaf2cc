import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqmatch.functions import columns as fc
from seqmatch.plans.parser import parse
from seqmatch.sources import datasets, io


def test_ddl():
    name, schema = io.parse_ddl("CREATE TABLE SYNTHETIC(type VARCHAR(4), a1 INT, a2 varchar(8), v FLOAT, w DOUBLE, eventTime LONG)")
    assert name == "SYNTHETIC" and schema["type"].dataType == T.StringType() and schema["eventTime"].dataType == T.LongType() and schema["v"].dataType == T.FloatType()
    for bad in ("CREATE TABLE t(a INT)", "CREATE TABLE t(a BLOB, eventTime LONG)", "DROP TABLE t"):
        with pytest.raises(ValueError):
            io.parse_ddl(bad)


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "x.csv").write_text("type,a,eventTime\nA,1,5\nB,2,7\n")
    _, schema = io.parse_ddl("CREATE TABLE x(type VARCHAR(1), a INT, eventTime LONG)")
    io.csv_to_parquet(spark, str(tmp_path / "x.csv"), str(tmp_path / "out"), schema, sort_by="eventTime")
    io.append(spark.read.parquet(str(tmp_path / "out")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    (tmp_path / "bad.csv").write_text("type,a,eventTime\nA,1\n")
    with pytest.raises(Exception):
        io.read_csv(spark, str(tmp_path / "bad.csv"), schema).collect()


def test_query_files_and_generator():
    made = datasets.generate_queries(4, 5, 0.2, seed=1)
    assert io.read_queries("\n".join(made)) == made and made == datasets.generate_queries(4, 5, 0.2, seed=1)
    assert all(parse(m).variables == ("A", "B", "C", "D") for m in made)


@pytest.mark.parametrize("arrivals", ["exponential", "uniform", "gaussian", "rayleigh"])
def test_synthetic(spark, arrivals):
    df = datasets.synthetic(spark, 4000, 5, arrivals=arrivals)
    assert df.count() == 4000 and {r[0] for r in df.select("type").distinct().collect()} <= {f"T_{i:02d}" for i in range(20)}
    top = df.groupBy("type").count().orderBy(F.desc("count")).first()
    assert top["type"] == "T_00" and 1100 < top["count"] < 1700
    assert df.agg(F.min("a1"), F.max("a1")).first()[0] >= 0 and df.agg(F.max("a1")).first()[0] <= 1000


def test_splits_and_sample(spark):
    df = spark.range(1000).withColumn("t", F.col("id") * 1_000_000)
    sizes = [r["count"] for r in datasets.split_round_robin(df, 4, ["id"]).groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 4
    assert datasets.split_by_window(df, 3, F.col("t"), 60_000_000).groupBy(F.floor(F.col("id") / 60)).agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0
    s = datasets.reservoir(df, 100, ["id"], 4)
    assert s.count() == 100 and {r.id for r in s.collect()} == {r.id for r in datasets.reservoir(df.repartition(7), 100, ["id"], 4).collect()}


def test_cleaning(spark):
    raw = spark.createDataFrame([("1", "HX1", "01/02/2020 03:04:05 PM", "041A", "MOTOR VEHICLE THEFT", "11", "1", "41.8", "-87.6", "06"), ("2", None, "01/02/2020 03:04:05 PM", "041A", "X", "11", "1", "41.8", "-87.6", "06")], ["ID", "Case Number", "Date", "IUCR", "Primary Type", "Beat", "District", "Latitude", "Longitude", "FBI Code"])
    out = datasets.clean_crimes(raw).collect()
    assert len(out) == 1 and out[0]["type"] == "MOTOR_VEHICLE_THEFT" and out[0]["eventTime"] == 1577977445
    rides = spark.createDataFrame([("a", "electric_bike", "2022-01-01 00:00:00", "2022-01-01 00:07:00", "5788.13", "6004.07", "40.7", "-73.9", "40.6", "-73.8", "member")], ["ride_id", "rideable_type", "started_at", "ended_at", "start_station_id", "end_station_id", "start_lat", "start_lng", "end_lat", "end_lng", "member_casual"])
    r = datasets.clean_rides(rides).first()
    assert r["type"] == "H" and r["start_station_id"] == 578813 and r["eventTime"] == 1640995200000
    jobs = spark.createDataFrame([("SUB", "7", "1", "0", "2", "0.5", "0.25", "0.1", "99"), (None, "7", "1", "0", "2", "0.5", "0.25", "0.1", "99")], ["type", "JOBID", "index", "scheduling", "priority", "CPU", "RAM", "disk", "eventTime"])
    assert datasets.clean_jobs(jobs).count() == 1


def test_columns(spark):
    df = spark.createDataFrame([(7, 7.9, "a")], "i int, d double, s string")
    r = df.select(fc.fixed_width(F.col("i"), "/", 2, T.IntegerType()).alias("a"), fc.fixed_width(F.col("i"), "/", 0, T.IntegerType()).alias("b"), fc.value_bucket("d", 1, 2).alias("c"), fc.record("i", "s").alias("r"), fc.linear_hash("i").alias("h")).first()
    assert (r.a, r.b, r.c, r.r) == (3, None, 3, "7,a") and r.h == (2_654_435_761 * 7 + 12_345) % 2**32
    with pytest.raises(TypeError):
        fc.micros(df, "s")
