"""Every sample query against DuckDB on the same Parquet files."""

import duckdb
import pytest

from tupelo.queries import SAMPLES, TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(rows):
    return [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]


@pytest.mark.parametrize("name", SAMPLES)
def test_sample(spark, duck, name):
    got = SAMPLES[name].run(spark, SF)
    want = duck.sql(SAMPLES[name].sql)
    assert sorted(got.columns) == sorted(want.columns)
    rows, target = norm(map(tuple, got.collect())), norm(want.fetchall())
    if got.columns != want.columns:
        order = [want.columns.index(c) for c in got.columns]
        target = [tuple(r[i] for i in order) for r in target]
    if name in ("order_asc", "order_desc_multi", "order_hidden"):
        assert rows == target
    assert sorted(rows, key=repr) == sorted(target, key=repr)


def plan_of(spark, name):
    return SAMPLES[name].run(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    for name, node in (("join_2_block_nested", "BroadcastHashJoin"), ("join_2_sort_merge", "SortMergeJoin"), ("join_2_hash", "ShuffledHashJoin"), ("join_nested", "CartesianProduct")):
        assert node in plan_of(spark, name)
    scan = plan_of(spark, "filter_int_eq")
    assert "PushedFilters: [IsNotNull(c_nationkey), EqualTo(c_nationkey,1)]" in scan
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_nationkey:int>" in scan
    for name in ("join_4_range", "join_4_range_project", "join_4_order"):
        # Read from the innermost join outwards, the filtered table comes before the largest one's other neighbours.
        logical = SAMPLES[name].run(spark, SF)._jdf.queryExecution().analyzed().toString()
        depth = {k: len(line) - len(line.lstrip(" :+-")) for line in logical.split("\n") for k in ("p_retailprice", "c_custkey") if f"Relation [{k[0]}_" in line}
        assert depth["p_retailprice"] > depth["c_custkey"]
    assert "Join" in (composite := plan_of(spark, "join_composite")) and composite.count("Join ") == 1
    assert "PushedFilters: [IsNotNull(l_quantity), IsNotNull(l_linenumber)]" in plan_of(spark, "filter_col_col")
