"""The sample tables that the registered queries share."""

from __future__ import annotations

import datetime as dt

import pytest

import plans
from checks import CASES, Tables
from checks.compare import difference

SF = "/root/testdata/sf0.001"
DAY = dt.datetime(1997, 3, 4)


@pytest.fixture(scope="module")
def far_keys(spark, tmp_path_factory):
    """A star schema whose part and supplier numbers have more than five digits."""
    path = tmp_path_factory.mktemp("star")
    tables = {
        "lineitem": (
            "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_shipdate timestamp_ntz,"
            " l_extendedprice double, l_discount double",
            [(1, 1, 112_345, 1, 3.0, DAY, 10.0, 0.1), (11, 1, 12_345, 1, 3.0, DAY, 20.0, 0.1), (11, 2, 7, 123_456, 40.0, DAY, 30.0, 0.0),
             (90_000_000, 7, 1_200_001, 99_999, 36.0, DAY, 5.5, 0.05)],
        ),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string", [(1, 5, "F"), (11, 6, "O"), (90_000_000, 5, "P")]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(1, "a", 1), (123_456, "b", 2), (99_999, "c", 3)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int", [(5, "x", 1), (6, "y", 2)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_leg_ids_of_long_keys_are_those_of_the_sql(spark, far_keys):
    import duckdb

    from checks.base import SAMPLE_SQL
    from lanewise.sources import star_schema

    con = duckdb.connect()
    for name in ("lineitem", "orders", "supplier", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{far_keys}/{name}.parquet/*.parquet'")
    legs = star_schema.legs(spark, far_keys).select("warpId", "orderCode")
    assert difference(legs, con, f"WITH {SAMPLE_SQL} SELECT warpId, orderCode FROM legs") is None
    assert legs.select("warpId").distinct().count() == 4


def test_a_query_alone_stages_nothing_and_reads_only_its_columns(spark):
    for name in ("p12_pick_in_year", "a16_metric_stats", "o15_within_market_ftl", "k01_check_margin"):
        tables = Tables(spark, SF)
        frame = CASES[name].build(tables)
        assert "legs" not in vars(tables), name
        if name == "p12_pick_in_year":
            scan = plans.text(frame)
            assert "l_shipdate" in scan and "l_extendedprice" not in scan


def test_buckets_hold_only_the_columns_that_the_work_reads(spark):
    tables = Tables(spark, SF)
    frame = CASES["a01_order_row_counts_in_buckets"].build(tables)
    ((columns, made),) = tables._by_order.items()
    assert columns == ("mainShipment",)
    assert made.legs.columns == made.hot.columns == ["orderCode", "mainShipment"]
    assert "legs" not in vars(tables)
    assert frame.count() == CASES["a01_order_row_counts"].build(tables).count()
