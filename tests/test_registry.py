"""Every query of the engine runs, and a spread of them equals its SQL on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from seqmatch import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SPREAD = ["any_match_part", "next_row", "next_match", "strict_nopart", "next_row_by_window", "dp_eq_arith", "intervals_union", "slices_shrink", "keyed_filter", "prune_dual", "participation_stats", "orders_sequence", "measures"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda x: None if pd.isna(x) else round(float(x), 6) if isinstance(x, (float, int)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(cell(x) for x in r) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", SPREAD)
def test_equals_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(registry.ORACLE_SQL[name]).df())


def test_names():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 70


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_report_bounds_hold_and_no_set_of_keys_is_broadcast(spark):
    df = registry.QUERIES["prune_report_bounds"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [x for x in plan if "BroadcastHashJoin" in x and "LeftSemi" in x and ("__b#" in x or "slice" in x)]
    out = df.collect()
    assert len(out) == 24 and all(r.keeps_matches and r.adds_nothing for r in out)
