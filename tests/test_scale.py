"""Hot keys, empty inputs, exact quantiles, and what plans may not contain."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import Tables
from lanewise import schema as S
from lanewise.operators import stats
from lanewise.operators.orders import financial_totals, select_financial_rows
from lanewise.operators.skew import attach, hot_keys
from lanewise.plans import board, carrier, client, lanes, questions
from lanewise.sources.staging import normalize_legs
from lanewise.sources.tables import typed_orders

PACKAGE = Path(__file__).resolve().parents[1] / "lanewise"


@pytest.fixture
def hot_left(spark):
    return spark.range(6000).selectExpr(
        "concat('S-', id) AS warpId",
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 5 = 0 THEN NULL ELSE concat('k', id % 1500) END AS key",
    )


def test_hot_key_is_found(hot_left):
    assert set(hot_keys(hot_left, "key", 1 / 10).first()["keys"]) >= {"hot"}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_attach_equals_plain_join(spark, hot_left, how):
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k7", 3), ("k8", 4), (None, 5)], "key string, v int")
    plain = hot_left.join(right, "key", how).orderBy("warpId")
    spread = attach(hot_left, right, "key", how, share=1 / 50)
    assert Counter(map(tuple, spread.collect())) == Counter(map(tuple, plain.collect()))
    assert spread.columns == plain.columns


def test_attach_spreads_a_hot_key(spark, hot_left):
    right = spark.createDataFrame([("hot", 1)], "key string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = attach(hot_left, right, "key", "inner", share=1 / 50)
        tasks = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r[1] for r in tasks) == 2000
    assert len(tasks) > 2


def test_one_order_with_a_third_of_all_rows(make_legs):
    rows = [
        {
            "orderCode": "P-hot" if i % 3 == 0 else f"P-{i % 40}",
            "mainShipment": "YES" if i % 7 == 0 else "NO",
            "shipmentType": (S.LTL, S.FTL, S.PARCEL)[i % 5 % 3],
            "startMarket": f"M{i % 4}",
            "revenueAllocationNumber": i,
            "costAllocationNumber": i // 2,
        }
        for i in range(300)
    ]
    legs = make_legs(*rows)
    for kind in S.SHIPMENT_TYPES:
        for compat in ("corrected", "reference"):
            picked = select_financial_rows(legs, kind, compat)
            by_rows = picked.groupBy("startMarket").agg(
                F.count_distinct("orderCode").alias("n"), F.sum("revenueAllocationNumber").alias("r")
            )
            direct = financial_totals(legs, ["startMarket"], kind, compat).selectExpr(
                "startMarket", "order_count AS n", "revenue AS r"
            )
            assert sorted(map(tuple, by_rows.collect())) == sorted(map(tuple, direct.collect())), (kind, compat)


@pytest.mark.parametrize("width", [0.5, 10.0, 1e6])
def test_exact_quantiles(spark, width):
    rng = np.random.default_rng(7)
    data = [("a" if i % 3 else None, float(round(v, 2))) for i, v in enumerate(rng.normal(0, 40, 500))]
    data += [("one", 3.25), ("flat", 1.0), ("flat", 1.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    found = {r["g"]: (r["p10"], r["p50"], r["p90"]) for r in stats.exact_quantiles(df, F.col("v"), ["g"], width=width).collect()}
    for group in ("a", None, "one", "flat"):
        values = [v for g, v in data if g == group and v is not None]
        assert found[group] == pytest.approx(tuple(np.quantile(values, [0.1, 0.5, 0.9])))
    pack = {r["g"]: r for r in stats.metric_stats(df, F.col("v"), ["g"]).collect()}
    assert (pack["none"]["n"], pack["none"]["p50"]) == (0, None)
    assert pack[None]["p50"] == pytest.approx(found[None][1])


def test_approximate_quantiles_are_close(spark):
    df = spark.range(1001).selectExpr("double(id) AS v")
    row = stats.metric_stats(df, F.col("v"), approximate=True).first()
    assert row["p50"] == pytest.approx(500, abs=2)


def test_correlation_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert stats.metric_corr(df, F.col("y"), F.col("x")).first()[0] is None


def test_empty_input_gives_empty_reports(spark):
    legs = normalize_legs(spark.createDataFrame([], S.LEGS))
    orders = typed_orders(spark.createDataFrame([], S.ORDERS))
    routes = spark.createDataFrame([], S.ROUTES)
    window = ("2025-01-01", "2025-12-31")
    detail = client.client_detail(legs, "x", *window)
    pnl = board.ltl_market_quarter(legs, 2025)
    for frame in (
        client.client_otp_otd_summary(legs, *window), detail, client.otp_otd_trend(detail, *window),
        carrier.carrier_transit(legs, routes, "x", *window), lanes.profit_by_lane(legs, *window),
        lanes.drill_down(legs, *window, "customer", "x"), lanes.profit_within_market(legs, *window), pnl,
        board.market_trends(pnl), questions.lane_profit_orders(orders, legs, "2025-01-15"),
    ):
        assert frame.count() == 0
    assert client.trend_status(detail, *window).first()["status"] == "empty"
    assert client.client_kpis(client.client_otp_otd_summary(legs, *window)).first()["otp_rate"] is None


def test_operators_stay_lazy_and_in_the_engine():
    for source in PACKAGE.rglob("*.py"):
        text = source.read_text()
        assert not re.search("localCheckpoint|crossJoin", text), source
        if "llm" not in source.parts:  # the operators of that folder may take a style of their own
            assert not re.search(r"\.(collect|toPandas|toLocalIterator)\(|udf", text), source


def test_date_filter_reaches_partitions_and_files(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    tables = Tables.of(spark, "/root/testdata/sf0.001")
    plan = client.client_otp_otd_summary(tables.legs, "1997-01-01", "1997-03-31")._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*pick_month", text)
    assert "EqualTo(shipmentStatus,Complete)" in text
    assert "costAllocationNumber" not in text


def test_market_and_carrier_reports_skip_months(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    legs = Tables.of(spark, "/root/testdata/sf0.001").legs
    for report in (board.ltl_market_quarter_revenue(legs, 1997), carrier.carrier_otp(legs, "x", "1997-01-01", "1997-04-01")):
        assert re.search(r"PartitionFilters: \[[^\]]*pick_month", report._jdf.queryExecution().executedPlan().toString())


def test_a_second_session_leaves_the_first_ones_files(spark):
    first = Tables.of(spark, "/root/testdata/sf0.001").legs
    rows = first.count()
    other = Tables.of(spark.newSession(), "/root/testdata/sf0.001").legs
    assert set(first.inputFiles()).isdisjoint(other.inputFiles())
    assert first.count() == other.count() == rows
