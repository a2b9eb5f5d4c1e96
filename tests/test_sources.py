"""Staging, exports, readers."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lanewise import schema as S
from lanewise.functions.places import lane_label
from lanewise.plans import client
from lanewise.sources import choices, reports, tables
from lanewise.sources.staging import (
    coerce_numeric,
    explode_route_shipments,
    load_staged_legs,
    stage_legs,
)


def test_stage_and_load(make_legs, tmp_path, spark):
    legs = make_legs({}, {"pickWindowFrom": "02/01/2025 08:00:00"}, {"pickWindowFrom": "Invalid date"})
    path = str(tmp_path / "staged")
    stage_legs(legs.select(*S.LEGS.names), path)
    back = load_staged_legs(spark, path)
    assert back.schema.names == S.STAGED_LEGS.names
    assert sorted(map(str, back.select(*legs.columns).collect())) == sorted(map(str, legs.collect()))
    months = {r[0] for r in back.select("pick_month").distinct().collect()}
    assert months == {dt.date(2025, 1, 1), dt.date(2025, 2, 1), None}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_readers_use_the_declared_schema(spark, tmp_path, fmt):
    path = str(tmp_path / "orders")
    rows = [("a", "Acme", S.LTL, "Complete", "12.345", "x", "2025-01-02", 7)]
    frame = spark.createDataFrame(rows, S.ORDERS)
    frame.write.format(fmt).option("header", True).save(path)
    row = tables.load_orders(spark, path, fmt).first()
    assert (float(row["revenue"]), row["cost"], row["created_on"]) == (12.35, None, dt.date(2025, 1, 2))


def test_readers_of_legs_routes_and_names(spark, tmp_path, make_legs):
    legs = make_legs({"pieces": 3}).select(*S.LEGS.names)
    legs.write.parquet(str(tmp_path / "legs"))
    assert tables.load_legs(spark, str(tmp_path / "legs")).first() == legs.first()
    spark.createDataFrame([("1", "Acme")], S.CLIENTS).write.parquet(str(tmp_path / "clients"))
    assert tables.load_dimension(spark, "clients", str(tmp_path / "clients")).first()["name"] == "Acme"
    spark.createDataFrame([("l", 1, "2", "[]", "[]")], S.ROUTES).write.parquet(str(tmp_path / "routes"))
    assert tables.load_routes(spark, str(tmp_path / "routes")).first()["routeId"] == "l"


def test_jdbc_options():
    options = tables.jdbc_options("jdbc:x", "legs", "id", (1, 100), 8)
    assert options["numPartitions"] == "8"
    assert options["upperBound"] == "100"
    with pytest.raises(ValueError, match="partition column"):
        tables.jdbc_options("jdbc:x", "legs", partitions=4)
    with pytest.raises(ValueError, match="bounds"):
        tables.jdbc_options("jdbc:x", "legs", "id", partitions=4)


def test_month_predicates_part_the_table(spark):
    parts = tables.month_predicates("d", (2024, 12), (2025, 2))
    assert len(parts) == 4
    rows = ["12/31/2024 10:00:00", "01/01/2025", "02/28/2025 00:00:00", "03/01/2025", "Invalid date", "", None]
    df = spark.createDataFrame([(r,) for r in rows], "d string")
    found = [[r.d for r in df.where(p).collect()] for p in parts]
    assert found == [rows[:1], rows[1:2], rows[2:3], rows[3:]]
    with pytest.raises(ValueError, match="before"):
        tables.month_predicates("d", (2025, 2), (2024, 12))
    with pytest.raises(ValueError, match="not both"):
        tables.read_jdbc(
            spark, tables.S.CLIENTS, parts, url="jdbc:x", table="t", partition_column="id", bounds=(1, 9), partitions=2
        )


def test_report_export(make_legs, tmp_path, spark):
    legs = make_legs({"pickLocationName": "a", "dropLocationName": "b", "clientName": "B"},
                     {"pickLocationName": "a", "dropLocationName": "b"})
    summary = client.client_otp_otd_summary(legs, "2025-01-01", "2025-12-31")
    shown = reports.number_rows(client.rank_clients(summary, "worst", 5), "otd_rate", "client")
    assert [(r["row"], r["client"]) for r in shown.orderBy("row").collect()] == [(1, "Acme"), (2, "B")]
    path = str(tmp_path / "out")
    reports.write_report(reports.with_headings(summary, "client_summary"), path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns[0] == "Client Name"
    assert back.count() == 2
    reports.write_report(summary, str(tmp_path / "pq"), "parquet")
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("1.5",), ("n/a",), (None,)], "v string")
    assert [r[0] for r in coerce_numeric(df, ["v"]).collect()] == [1.5, 0, 0]
    assert [r[0] for r in coerce_numeric(df, ["v"], fill=None).collect()] == [1.5, None, None]


def test_route_arrays(spark):
    df = spark.createDataFrame(
        [("a", '["S-1","S-2"]', "[1,2]"), ("b", None, None), ("c", "bad", "[]")],
        "routeId string, shipmentCodes string, shipmentWarpIds string",
    )
    codes = sorted(map(tuple, explode_route_shipments(df).collect()), key=str)
    assert codes == [("a", "S-1"), ("a", "S-2"), ("b", None), ("c", None)]
    numbers = explode_route_shipments(df, "shipmentWarpIds", "bigint")
    assert {r[1] for r in numbers.where(F.col("routeId") == "a").collect()} == {1, 2}


def test_option_lists(make_legs):
    legs = make_legs({"clientName": ""}, {"clientName": None}, {"clientName": "b", "startMarket": ""}, {"clientName": "a"})
    assert [r[0] for r in choices.distinct_clients(legs).collect()] == ["", "a", "b"]
    assert [r[0] for r in choices.distinct_customers(legs).collect()] == ["a", "b"]
    assert [r[0] for r in choices.distinct_customers(legs, limit=1).collect()] == ["a"]
    assert [r[0] for r in choices.distinct_lanes(legs, "b").collect()] == []
    assert [r[0] for r in choices.distinct_lanes(legs).collect()] == ["LAX → EWR"]


def test_further_text_columns_survive_staging(make_legs, tmp_path, spark):
    extra = ["pickAddress", "dropAddress"]
    wide = make_legs({}).select(*S.LEGS.names, F.lit("1 A St").alias("pickAddress"), F.lit("2 B St").alias("dropAddress"))
    wide.write.parquet(str(tmp_path / "legs"))
    stage_legs(tables.load_legs(spark, str(tmp_path / "legs"), extra=extra), str(tmp_path / "staged"))
    legs = load_staged_legs(spark, str(tmp_path / "staged"), extra)
    assert legs.select(lane_label("address")).first()[0] == "1 A St → 2 B St"
