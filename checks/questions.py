"""Standing questions with an as-of date, targets and accessorials."""

from __future__ import annotations


from checks.base import AS_OF, CLIENT, REP, case
from checks.client import RATED_SQL, summary
from checks.sql import pct
from lanewise.plans import questions as Q

LAST_MONTH = ">= DATE '1997-06-01' AND {0} < DATE '1997-07-01'"
BUSY = "1997-09-17"  # the client has deliveries in the week before, on every sample
LANE = "startMarket <> '' AND endMarket <> ''"


def last_month(column: str) -> str:
    return f"{column} {LAST_MONTH.format(column)}"


case(
    "o27_customer_otd_by_lane_equipment",
    "lane s, start_market s, end_market s, equipment s, shipment_type s, total_deliveries i, on_time i, otd_pct d",
    f"""SELECT *, {pct('on_time', 'total_deliveries')} AS otd_pct FROM (
          SELECT startMarket || ' → ' || endMarket AS lane, startMarket AS start_market, endMarket AS end_market, equipment,
            shipmentType AS shipment_type, count(*) AS total_deliveries, count(*) FILTER (WHERE da < dt) AS on_time
          FROM t WHERE clientName = '{CLIENT}' AND mainShipment = 'YES' AND shipmentStatus = 'Complete'
            AND dropTimeArrived IS NOT NULL AND dropWindowTo IS NOT NULL
            AND yearweek(df) = yearweek(DATE '{BUSY}' - INTERVAL 7 DAY)
          GROUP BY ALL)""",
)(lambda x: Q.customer_otd_by_lane_equipment(x.typed, CLIENT, BUSY))

_ORDER_MONEY = """count(DISTINCT {code}) AS order_count, sum({r}) AS total_revenue, sum({c}) AS total_cost,
    sum({r} - {c}) AS total_profit"""
_FROM_ORDERS = _ORDER_MONEY.format(code="code", r="revenue", c="cost")
_FROM_LEGS = _ORDER_MONEY.format(code="orderCode", r="rev", c="cost")
_MARGIN = f"{pct('total_profit', 'total_revenue')} AS margin_pct"
_MONEY_COLUMNS = "order_count i, total_revenue d, total_cost d, total_profit d"

case(
    "o28_customer_profit_orders",
    "shipment_type s, " + _MONEY_COLUMNS,
    f"""SELECT shipmentType AS shipment_type, {_FROM_ORDERS} FROM orders_fin
        WHERE customerName = '{CLIENT}' AND status = 'Complete' AND {last_month('created_on')} GROUP BY 1""",
)(lambda x: Q.customer_profit_orders(x.orders, CLIENT, AS_OF))
case(
    "o29_customer_profit_legs",
    "shipment_type s, " + _MONEY_COLUMNS + ", margin_pct d",
    f"""SELECT *, {_MARGIN} FROM (SELECT shipmentType AS shipment_type, {_FROM_LEGS} FROM t
        WHERE clientName = '{CLIENT}' AND mainShipment = 'YES' AND shipmentStatus = 'Complete' AND {last_month('df')}
        GROUP BY 1)""",
)(lambda x: Q.customer_profit_legs(x.typed, CLIENT, AS_OF))

_LANE_GROUP = "startMarket || ' → ' || endMarket AS lane"
_TOP = "ORDER BY total_profit DESC, lane, shipment_type LIMIT 20"
for _name in ("o31_lane_profit_orders", "t06_top_lanes"):
    case(
        _name,
        "lane s, shipment_type s, " + _MONEY_COLUMNS,
        f"""SELECT lane, o.shipmentType AS shipment_type,
              {_ORDER_MONEY.format(code='o.code', r='o.revenue', c='o.cost')}
            FROM orders_fin AS o
            JOIN (SELECT orderCode, {_LANE_GROUP} FROM t WHERE mainShipment = 'YES' AND {LANE} AND {last_month('df')}) AS h
              ON h.orderCode = o.code
            WHERE o.status = 'Complete' GROUP BY 1, 2 {_TOP}""",
    )(lambda x: Q.lane_profit_orders(x.orders, x.typed, AS_OF))
case(
    "o32_lane_profit_legs",
    "lane s, shipment_type s, " + _MONEY_COLUMNS + ", margin_pct d",
    f"""SELECT *, {_MARGIN} FROM (SELECT {_LANE_GROUP}, shipmentType AS shipment_type, {_FROM_LEGS} FROM t
        WHERE mainShipment = 'YES' AND shipmentStatus = 'Complete' AND {LANE} AND {last_month('df')} GROUP BY 1, 2)
        {_TOP}""",
)(lambda x: Q.lane_profit_legs(x.typed, AS_OF))
case(
    "o33_booked_by_rep",
    "rep s, booked_date day, shipment_type s, shipment_count i",
    f"""SELECT carrierSaleRep AS rep, bk::DATE AS booked_date, shipmentType AS shipment_type, count(*) AS shipment_count
        FROM t WHERE carrierSaleRep = '{REP}' AND loadBookedTime <> '' AND bk::DATE = DATE '{AS_OF}' GROUP BY ALL""",
)(lambda x: Q.booked_by_rep(x.typed, REP, AS_OF))

case(
    "o34_vs_target",
    "client s, otp_gap d, otp_met b, otd_gap d, otd_met b",
    f"""SELECT client, (otp_rate::DECIMAL(10,4) - 98.5) AS otp_gap, otp_rate::DECIMAL(10,4) >= 98.5 AS otp_met,
        (otd_rate::DECIMAL(10,4) - 99.9) AS otd_gap, otd_rate::DECIMAL(10,4) >= 99.9 AS otd_met FROM ({RATED_SQL})""",
)(lambda x: Q.vs_target(summary(x), {"otp": "otp_rate", "otd": "otd_rate"}))
case(
    "o35_accessorials",
    "shipmentType s, charge s, total d, orders i",
    """SELECT shipmentType, 'revenueAllocation' AS charge, sum(revenue) AS total,
         count(*) FILTER (WHERE revenue <> 0) AS orders FROM orders_fin GROUP BY shipmentType
       UNION ALL
       SELECT shipmentType, 'costAllocation', sum(cost), count(*) FILTER (WHERE cost <> 0) FROM orders_fin
       GROUP BY shipmentType""",
)(lambda x: Q.accessorials(x.orders, ["revenueAllocation", "costAllocation"], ["shipmentType"]))
