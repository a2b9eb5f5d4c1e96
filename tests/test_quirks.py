"""Behaviour that is easy to lose: NULLs, ties, rounding, odd dates, repeats."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from legs import money
from lanewise import schema as S
from lanewise.functions import money as M
from lanewise.functions import predicates as P
from lanewise.functions import times as T
from lanewise.operators import orders as R
from lanewise.operators.dedup import first_per_stop, flag_dedup, inherited_codes
from lanewise.operators.stats import metric_stats, period_change, r_squared, rolling_avg
from lanewise.plans import board, carrier, client, lanes, questions

WINDOW = ("2025-01-01", "2025-12-31")


def test_mixed_type_order_repeats_in_reference_mode(make_legs):
    legs = make_legs(
        money(10, 1, "YES", shipmentType=S.FTL), money(20, 2, "YES"), money(30, 3, "NO"),
        money(40, 4, "YES", shipmentType=S.PARCEL), money(50, 5, "NO", shipmentType=S.PARCEL),
    )
    # Groups: FTL of 1 row, LTL of 2, parcel of 2.
    repeated = R.select_financial_rows(legs, compat="reference")
    assert Counter(r["warpId"] for r in repeated.collect()) == {"S-1": 3, "S-2": 1, "S-3": 3, "S-4": 3}
    once = R.select_financial_rows(legs)
    assert Counter(r["warpId"] for r in once.collect()) == {"S-1": 1, "S-3": 1, "S-4": 1}
    for compat, expected in (("reference", 3 * 10 + 20 + 3 * 30 + 3 * 40), ("corrected", 80)):
        row = R.financial_totals(legs, ["startMarket"], compat=compat).first()
        assert (row["order_count"], row["revenue"]) == (1, expected)


def test_counts_are_taken_after_the_filter(make_legs):
    legs = make_legs(money(85, 0, "YES"), money(42, 57, dropTimeArrived="01/12/2024 09:00:00"))
    row = lanes.profit_by_lane(legs, *WINDOW, shipment_type=S.LTL).first()
    assert (row["order_count"], row["total_revenue"]) == (1, 85)


def test_crossdock_exclusion_comes_after_the_counts(make_legs):
    legs = make_legs(
        money(10, 1, "YES", pickLocationName="a", dropLocationName="b"),
        money(20, 2, "NO", pickLocationName="c", dropLocationName="c"),
        startMarket="LAX", endMarket="LAX",
    )
    assert lanes.profit_within_market(legs, *WINDOW, crossdock=False).count() == 0
    assert lanes.profit_within_market(legs, *WINDOW).first()["total_revenue"] == 20


def test_several_headers_multiply_cost_only_in_reference_mode(make_legs):
    place = {"pickLocationName": "WTCH-LAX-1", "dropLocationName": "Shop"}
    legs = make_legs(money(10, 5, "YES", **place), money(10, 7, "YES", **place), money(0, 8, "NO"))
    for compat, expected in (("reference", 40), ("corrected", 20)):
        row = board.ltl_market_quarter_cost(legs, 2025, compat=compat).first()
        assert (row["market"], row["quarter"], row["cost"]) == ("LAX", "Q1", expected)


def test_missing_arrival_differs_per_report(make_legs):
    legs = make_legs({"pickLocationName": "a", "dropLocationName": "b", "loadId": "l"})
    assert client.client_detail(legs, "Acme", *WINDOW).first()["otp_status"] == "No Pickup Data"
    row = client.client_otp_otd_summary(legs, *WINDOW).first()
    assert (row["shipments"], row["otp_total"], row["otp_rate"]) == (1, 0, 0)
    routes = legs.sparkSession.createDataFrame([], S.ROUTES)
    assert carrier.carrier_transit(legs, routes, "Carrier", *WINDOW).first()["otp"] == "On Time"


def test_arrival_at_the_window_end(make_legs):
    legs = make_legs({"pickTimeArrived": "01/10/2025 12:00:00"})
    row = legs.select(T.in_time("pick", True), T.in_time("pick", False)).first()
    assert tuple(row) == (True, False)


def test_late_without_a_code(make_legs):
    legs = make_legs({"pickTimeArrived": "01/10/2025 13:00:00", "pickLocationName": "a", "dropLocationName": "b"})
    detail = client.client_detail(legs, "Acme", *WINDOW)
    assert client.delay_breakdown(detail, "pick").first()[0] == "No Code"
    assert client.delay_breakdown(detail, "pick", impute_carrier=True).first()[0] == "Carrier Failure"


def test_constant_trend_has_no_fit(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert df.agg(r_squared(F.col("y"), F.col("x"))).first()[0] == 0


def test_unpadded_dates(make_legs):
    place = {"pickLocationName": "WTCH-LAX-1", "dropLocationName": "Shop"}
    legs = make_legs({"pickWindowFrom": "1/5/2025 8:00:00", **place})
    assert legs.first()["pick_from_ts"] == dt.datetime(2025, 1, 5, 8)
    assert board.ltl_market_quarter_revenue(legs, 2025).first()["quarter"] == "Unknown"
    pnl = board.ltl_market_quarter(legs, 2025)
    assert board.market_trends(pnl).count() == 0
    assert board.market_quarterly(pnl, "LAX").first()["quarter"] is None


@pytest.mark.parametrize(
    "text", [None, "", "Invalid date", "02/31/2025 08:00:00", "2025-01-05 08:00:00", "01/05/2025", "01/05/2025 08:00:00 x"]
)
def test_unreadable_times_are_null(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.parse_timestamp(F.col("t"))).first()[0] is None


def test_zero_revenue_lane(make_legs):
    row = lanes.profit_by_lane(make_legs(money(0, 9, "YES")), *WINDOW).first()
    assert (row["margin_pct"], row["crossdock_cost_pct"]) == (0, 0)
    row = lanes.profit_by_lane(make_legs(money(0, 0, "YES")), *WINDOW).first()
    assert (row["margin_pct"], row["crossdock_cost_pct"]) == (0, 0)


def test_ties_resolve_by_leg_id(make_legs):
    same = {"loadId": "l", "pickLocationName": "p", "pickTimeArrived": "01/10/2025 09:00:00"}
    legs = make_legs({"warpId": "S-9", **same}, {"warpId": "S-2", **same}, {"warpId": "S-5", **same})
    assert [r["warpId"] for r in first_per_stop(legs, "pick", ["warpId"]).collect()] == ["S-2"]
    kept = {r["warpId"] for r in flag_dedup(legs).where("keep_for_pickup").collect()}
    assert kept == {"S-2"}


def test_rows_without_a_stop_key_share_one(make_legs):
    legs = make_legs({"loadId": None}, {"loadId": "l", "carrierName": None}, {"loadId": "l"})
    assert flag_dedup(legs).where("keep_for_pickup").count() == 1
    assert first_per_stop(legs, "pick", ["warpId"]).count() == 3


def test_inherited_codes_skip_handling_legs_and_blanks(make_legs):
    legs = make_legs(
        {"pickupDelayCode": "", "pickWindowFrom": "01/01/2025 08:00:00"},
        {"pickupDelayCode": "early", "pickWindowFrom": "01/02/2025 08:00:00", "deliveryDelayCode": "old"},
        {"pickupDelayCode": "late", "dropWindowFrom": "01/20/2025 08:00:00", "deliveryDelayCode": "new"},
        {"pickupDelayCode": "dock", "pickWindowFrom": "01/01/2024 08:00:00", "pickLocationName": "d", "dropLocationName": "d"},
    )
    row = inherited_codes(legs).first()
    assert (row["first_pick_code"], row["last_drop_code"]) == ("early", "new")
    undated = make_legs({"pickupDelayCode": "a"}, {"pickupDelayCode": "b", "pickWindowFrom": "Invalid date"})
    assert inherited_codes(undated).first()["first_pick_code"] == "b"


def test_last_day_counts_to_midnight_only(make_legs):
    legs = make_legs(
        money(1, 0, "YES", orderCode="a", dropTimeArrived="01/31/2025 00:00:00"),
        money(2, 0, "YES", orderCode="b", dropTimeArrived="01/31/2025 00:00:01"),
    )
    assert lanes.profit_by_lane(legs, "2025-01-01", "2025-01-31").first()["total_revenue"] == 1
    picked = make_legs({"pickWindowFrom": "01/31/2025 23:59:59"}, {"pickWindowFrom": "02/01/2025 00:00:00"})
    assert picked.where(P.pick_day_between("2025-01-01", "2025-01-31")).count() == 1


def test_effective_delivery_does_not_fall_through(make_legs):
    legs = make_legs(
        {"dropTimeArrived": "garbage", "dropDateArrived": "01/15/2025"},
        {"dropDateArrived": "01/15/2025"},
        {},
        {"pickLocationName": "d", "dropLocationName": "d", "dropTimeArrived": "01/16/2025 08:00:00"},
    )
    days = [r["delivered_ts"] and r["delivered_ts"].day for r in legs.orderBy("warpId").collect()]
    assert days == [None, 15, 12, 12]


def test_rows_without_order(make_legs):
    legs = make_legs(
        money(5, 1, "YES", orderCode=None, shipmentType=S.FTL), money(7, 1, "YES", orderCode=None)
    )
    ftl = lanes.profit_by_lane(legs, *WINDOW, shipment_type=S.FTL).first()
    assert (ftl["order_count"], ftl["total_revenue"]) == (0, 5)
    assert lanes.profit_by_lane(legs, *WINDOW, shipment_type=S.LTL).count() == 0
    assert lanes.profit_by_lane(legs, *WINDOW).count() == 0


def test_other_types_use_header_rows(make_legs):
    legs = make_legs(
        money(5, 1, "YES", shipmentType="LTL_CD"), money(7, 1, "NO", shipmentType="LTL_CD"),
        money(9, 1, "YES", shipmentType=None),
    )
    assert [r["warpId"] for r in R.select_financial_rows(legs).collect()] == ["S-1"]


def test_names_are_values_and_case_matters(make_legs):
    legs = make_legs(
        money(3, 1, "YES", orderCode="a", clientName="O'Brien"), money(4, 1, "YES", orderCode="b", clientName="o'brien")
    )
    rows = lanes.drill_down(legs, *WINDOW, "customer", "O'Brien").collect()
    assert [r["order_code"] for r in rows] == ["a"]
    assert lanes.profit_by_lane(legs, *WINDOW, customers=["O'Brien"]).first()["total_revenue"] == 3


def test_blank_time_stays_and_is_not_on_time(make_legs):
    legs = make_legs(
        {"pickTimeArrived": "", "loadId": "l"}, {"pickTimeArrived": None, "loadId": "l"},
        {"pickTimeArrived": "01/10/2025 09:00:00", "loadId": "l"},
    )
    row = carrier.carrier_otp(legs, "Carrier", "2025-01-01", "2026-01-01").first()
    assert (row["total"], row["on_time"], float(row["otp_pct"])) == (2, 1, 50.0)


def test_unreadable_window_end_is_late(make_legs):
    legs = make_legs({"pickTimeArrived": "01/10/2025 09:00:00", "pickWindowTo": None,
                      "pickLocationName": "a", "dropLocationName": "b"})
    assert client.client_detail(legs, "Acme", *WINDOW).first()["otp_status"] == "Late"
    row = client.client_otp_otd_summary(legs, *WINDOW).first()
    assert (row["otp_on_time"], row["otp_total"]) == (0, 1)


def test_load_with_several_rows_repeats_the_leg(make_legs, spark):
    legs = make_legs({"loadId": "l"}, {"loadId": None})
    routes = spark.createDataFrame(
        [("l", 1, "12.5", None, None), ("l", 2, "n/a", None, None)], S.ROUTES
    )
    rows = carrier.carrier_transit(legs, routes, "Carrier", *WINDOW).collect()
    assert sorted((r["leg_id"], r["pallet_count"] or 0, float(r["transit_cost"] or 0)) for r in rows) == [
        ("S-1", 1, 12.5), ("S-1", 2, 0.0), ("S-2", 0, 0.0),
    ]


@pytest.mark.parametrize("whole", [7, 16, 80, 400, 2000, 4000])
def test_printed_and_table_rounding(spark, whole):
    df = spark.range(whole + 1).select(
        F.col("id"), M.printed_percent(F.col("id"), F.lit(whole)), M.table_percent(F.col("id"), F.lit(whole))
    )
    import numpy as np

    for part, printed, table in df.collect():
        value = part / whole * 100
        assert printed == round(value, 1)
        assert table == float(np.round(value, 1))


def test_period_grain():
    assert T.grain_for("2025-01-01", "2025-01-15") == "day"
    assert T.grain_for("2025-01-01", "2025-01-16") == "week"
    assert T.grain_for("2025-01-01", "2025-04-01") == "week"
    assert T.grain_for("2025-01-01", "2025-04-02") == "month"


def test_as_of_windows(make_legs):
    legs = make_legs({"dropWindowFrom": "12/29/2024 23:00:00"}, {"dropWindowFrom": "12/30/2024 00:00:00"},
                     {"dropWindowFrom": "01/05/2025 23:59:59"}, {"dropWindowFrom": "01/06/2025 00:00:00"})
    weekly = legs.where(P.in_last_week("drop_from_ts", "2025-01-08"))
    assert {r["warpId"] for r in weekly.collect()} == {"S-2", "S-3"}
    monthly = legs.where(P.in_last_month("drop_from_ts", "2025-01-08"))
    assert {r["warpId"] for r in monthly.collect()} == {"S-1", "S-2"}


def test_targets(spark):
    df = spark.createDataFrame([(98.5, 97.9)], "otp_rate double, otd_rate double")
    row = questions.vs_target(df, {"otp": "otp_rate", "otd": "otd_rate"}, S.TARGETS | {"otd": 98.0}).first()
    assert (row["otp_met"], row["otd_met"], float(row["otd_gap"])) == (True, False, -0.1)


def test_accessorials(spark):
    orders = spark.createDataFrame(
        [("a", "10.5", None), ("b", "bad", "2"), ("c", "0", "3")], "code string, `liftgate-delivery` string, detention string"
    )
    rows = {r["charge"]: (float(r["total"]), r["orders"]) for r in questions.accessorials(orders, ["liftgate-delivery", "detention"]).collect()}
    assert rows == {"liftgate-delivery": (10.5, 1), "detention": (5.0, 2)}


def test_case_insensitive_names_are_opt_in(make_legs):
    legs = make_legs({"dropLocationName": "DOORDASH LAX"}, {"dropLocationName": "Doordash DTX"}, {"dropLocationName": "x"})
    assert legs.where(P.is_platform_customer("DoorDash", by="site")).count() == 1
    folded = legs.withColumn("dropLocationName", F.collate("dropLocationName", "UTF8_LCASE"))
    assert folded.where(P.is_platform_customer("DoorDash", by="site")).count() == 2


def test_missing_periods_are_not_stepped_over(spark):
    months = spark.createDataFrame(
        [("a", dt.date(2025, 1, 1), 10), ("a", dt.date(2025, 3, 1), 30), ("a", dt.date(2025, 4, 1), 60)],
        "e string, p date, v int",
    )
    change = period_change(months, "v", "p", ["e"], "month").orderBy("p").collect()
    assert [(r["v_before"], r["v_change_pct"]) for r in change] == [(None, None), (None, None), (30, 100.0)]
    mean = rolling_avg(months, "v", 3, "p", ["e"], "month").orderBy("p").collect()
    assert [r["v_avg_3"] for r in mean] == [10.0, 20.0, 45.0]
    weeks = spark.createDataFrame(
        [("a", dt.date(2024, 12, 30), 1), ("a", dt.date(2025, 1, 6), 2), ("a", dt.date(2025, 1, 20), 4)],
        "e string, p date, v int",
    )
    change = period_change(weeks, "v", "p", ["e"], "week").orderBy("p").collect()
    assert [r["v_before"] for r in change] == [None, 1, None]


def test_weighted_mean_needs_no_quantiles(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 4.0, 2)], "g string, v double, w int")
    found = metric_stats(df, F.col("v"), ["g"], weight=F.col("w"), quantiles=False)
    assert found.columns == ["g", "n", "mean", "std", "variance", "weighted_mean"]
    assert found.first()["weighted_mean"] == 3.0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
