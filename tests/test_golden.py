"""Worked examples of the business rules, typed by hand."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from legs import money
from lanewise import schema as S
from lanewise.functions.money import COST, REVENUE
from lanewise.functions.places import market_of
from lanewise.operators import orders as R

DOCK = {"pickLocationName": "Bound Brook", "dropLocationName": "Bound Brook"}


def totals(rows):
    row = rows.agg(F.sum(REVENUE), F.sum(COST)).first()
    return tuple(float(v) for v in row)


def orders_and_money(legs, kind):
    row = R.financial_totals(legs, ["startMarket", "endMarket"], kind).first()
    return row["order_count"], float(row["revenue"]), float(row["cost"])


LTL_REPEATED = [money(85, 0, "YES"), money(42, 57), money(43, 58)]
LTL_REPEATED_2 = [money(158.65, 0, "YES"), money(100.65, 60), money(58, 40)]
LTL_HEADER_ZERO = [
    money(0, 0, "YES"),
    money(133.14, 65.13),
    money(458, 413.33),
    money(0, 0, **DOCK),
    money(58, 24.83),
]
FTL_MULTIDROP = [money(r, c, "YES", loadId="2571-2603") for r, c in ((107, 90), (40, 33), (30, 25), (52, 44), (76, 63))]
FTL_MULTISTOP = [
    money(1529, 1510, "YES"),
    money(0, 440, pickLocationName="WTCH-ATL-2", dropLocationName="WTCH-ATL-2"),
    money(500, 400, pickLocationName="WTCH-ATL-1", dropLocationName="WTCH-ATL-2"),
]
FTL_ON_HEADER = [money(1050, 900, "YES"), money(0, 0), money(0, 0, **DOCK), money(0, 0)]


@pytest.mark.parametrize(
    ("kind", "rows", "expected"),
    [
        (S.LTL, LTL_REPEATED, (85, 115)),
        (S.LTL, LTL_REPEATED_2, (158.65, 100)),
        (S.LTL, LTL_HEADER_ZERO, (649.14, 503.29)),
        (S.FTL, FTL_MULTIDROP, (305, 255)),
        (S.FTL, FTL_MULTISTOP, (2029, 2350)),
        (S.FTL, FTL_ON_HEADER, (1050, 900)),
    ],
)
@pytest.mark.parametrize("scope", ["typed", "all"])
def test_financial_rows(make_legs, kind, rows, expected, scope):
    legs = make_legs(*rows, shipmentType=kind)
    selected = kind if scope == "typed" else S.ALL_TYPES
    assert totals(R.select_financial_rows(legs, selected)) == pytest.approx(expected)
    assert orders_and_money(legs, selected) == pytest.approx((1, *expected))


def test_single_ltl_header_counts(make_legs):
    legs = make_legs(money(500, 320, "YES"))
    assert totals(R.select_financial_rows(legs, S.LTL)) == (500, 320)


def test_order_revenue_rules(make_legs):
    legs = make_legs(
        money(85, 0, "YES", orderCode="a"), money(42, 57, orderCode="a"), money(43, 58, orderCode="a"),
        money(0, 0, "YES", orderCode="b"), money(60, 20, orderCode="b"),
        money(5, 1, orderCode="b", pickLocationName="WTCH-LAX-1", dropLocationName="WTCH-LAX-1"),
        money(70, 0, "YES", orderCode="c"), money(0, 30, orderCode="c"),
    )
    revenue = {r["orderCode"]: float(r["revenue"]) for r in R.ltl_order_revenue(legs).collect()}
    assert revenue == {"a": 85, "b": 60, "c": 70}
    patterns = {r["pattern"]: (r["orders"], float(r["share_pct"])) for r in R.revenue_pattern(legs).collect()}
    assert patterns == {"header repeats legs": (1, 33.3), "header zero": (1, 33.3), "legs zero": (1, 33.3)}


def test_order_pieces_rules(make_legs):
    legs = make_legs(
        money(10, 1, "YES", orderCode="a", pieces=4), money(10, 1, orderCode="a", pieces=9),
        money(0, 0, "YES", orderCode="b", pieces=0), money(10, 1, orderCode="b", pieces=3),
        money(0, 1, orderCode="b", pieces=5),
        money(9, 1, orderCode="b", pieces=7, pickLocationName="WTCH-LAX-1", dropLocationName="WTCH-LAX-1"),
    )
    assert {r["orderCode"]: r["pieces"] for r in R.ltl_order_pieces(legs).collect()} == {"a": 4, "b": 3}


def test_truckload_split_over_markets(make_legs):
    parts = (("DFW", 6, 2032.63, 1693.86), ("IAH", 8, 2821.15, 2350.96), ("SAT", 3, 1146.23, 955.19))
    legs = make_legs(
        *(money(r, c, "YES", pieces=p, pickLocationName=f"WTCH-{m}-1", dropLocationName="Shop") for m, p, r, c in parts),
        shipmentType=S.FTL,
    )
    split = {
        r["market"]: (r["legs"], r["pieces"], float(r["revenue"]), float(r["cost"]))
        for r in R.ftl_market_split(legs).collect()
    }
    assert split == {m: (1, p, r, c) for m, p, r, c in parts}
    whole = R.ftl_order_pnl(legs, market_only=True).first()
    assert (whole["pieces"], whole["revenue"], whole["cost"]) == (17, Decimal("6000.0100"), Decimal("5000.0100"))


def test_order_shapes(make_legs):
    legs = make_legs(
        {"orderCode": "a"},
        {"orderCode": "b"}, {"orderCode": "b", "mainShipment": "NO"},
        {"orderCode": "c", "shipmentType": S.FTL},
        {"orderCode": "d", "shipmentType": S.FTL, "loadId": "x"}, {"orderCode": "d", "shipmentType": S.FTL, "loadId": "x"},
        {"orderCode": "e", "shipmentType": S.FTL}, {"orderCode": "e", "shipmentType": S.FTL, "mainShipment": "NO"},
    )
    shapes = {r["orderCode"]: r["shape"] for r in R.classify_order(legs).collect()}
    assert shapes == {
        "a": "LTL direct",
        "b": "LTL multi-leg",
        "c": "FTL direct",
        "d": "FTL multidrop",
        "e": "FTL multistop",
    }


MARKETS = {
    "WTCH-LAX-9": "LAX",
    "ACCL-EWR": "EWR",
    "SB-ATL-1": "ATL",
    "SB-DC-1": "DCA",
    "SB-DAL-1": "DFW",
    "SB-SEA-1": "SEA",
    "SB-LA-1": "LAX",
    "SB-DEN-1": "DEN",
    "SB-NYC-UG": "EWR",
    "SB-PHX-1": "PHX",
    "SB-MIA-1": "MIA",
    "GoBolt NYC Cross-Dock": "EWR",
    "ACME Cross-Dock Chicago": "ORD",
    "SB-ZZZ-1": None,
    "Shop": None,
    None: None,
}


def test_markets(spark):
    df = spark.createDataFrame([(k,) for k in MARKETS], "place string")
    assert {r[0]: r[1] for r in df.select("place", market_of(F.col("place"))).collect()} == MARKETS
    coded = {r[0] for r in df.where(market_of(F.col("place"), "wtch").isNotNull()).collect()}
    assert coded == {"WTCH-LAX-9"}


def test_dedup_overlap(make_legs):
    legs = make_legs(
        {"orderCode": "a", "pickLocationName": "Shop", "dropLocationName": "End"},
        {"orderCode": "a", "pickLocationName": "Shop", "dropLocationName": "Dock", "mainShipment": "NO"},
        {"orderCode": "a", "pickLocationName": "Dock", "dropLocationName": "End", "mainShipment": "NO"},
        {"orderCode": "b", "pickLocationName": "Plant", "dropLocationName": "Dock"},
        {"orderCode": "b", "pickLocationName": "Dock", "dropLocationName": "Dock", "mainShipment": "NO"},
        {"orderCode": "c", "pickLocationName": "Shop"},
    )
    found = {r["side"]: (r["orders"], r["matching"]) for r in R.dedup_overlap(legs).collect()}
    assert found == {"pick": (2, 1), "drop": (2, 2)}
