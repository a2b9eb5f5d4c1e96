"""Lane and within-market profit family."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import FIRST, LAST, Tables, case
from checks.sql import printed0, table0
from lanewise.operators import orders as R
from lanewise.plans import lanes as L
from lanewise.sources.reports import number_report

DELIVERED = f"shipmentStatus = 'Complete' AND delivered BETWEEN TIMESTAMP '{FIRST}' AND TIMESTAMP '{LAST}'"
LANE_TEXT, CLIENT_LANE = "startMarket || ' → ' || endMarket", "M15 → M15"  # the client's legs on it are on every sample
CITY_LANE = "pickCity || ', ' || pickState || ' → ' || dropCity || ', ' || dropState"
HAS_LANE = "startMarket <> '' AND endMarket <> ''"
SAME_MARKET = "startMarket <> '' AND startMarket = endMarket"
FTL, LTL, PARCEL = "Full Truckload", "Less Than Truckload", "Parcel"
SHORT = {"ftl": FTL, "ltl": LTL, "parcel": PARCEL, "all": "All"}


def rows_sql(where: str, kind: str, compat: str = "corrected") -> str:
    """The legs that carry the money, straight from the row rules."""
    if kind == FTL:
        return f"SELECT * FROM t WHERE {where} AND shipmentType = '{FTL}'"
    if kind == PARCEL:
        return f"SELECT * FROM t WHERE {where} AND shipmentType = '{PARCEL}' AND mainShipment = 'YES'"
    if kind == LTL:
        return f"""SELECT * FROM t WHERE {where} AND shipmentType = '{LTL}' AND orderCode IS NOT NULL
                   QUALIFY count(*) OVER (PARTITION BY orderCode) = 1 OR mainShipment = 'NO'"""
    if compat == "corrected":
        return f"""SELECT * FROM t WHERE {where} AND orderCode IS NOT NULL
                   QUALIFY CASE shipmentType WHEN '{FTL}' THEN true
                     WHEN '{LTL}' THEN count(*) OVER (PARTITION BY orderCode, shipmentType) = 1 OR mainShipment = 'NO'
                     ELSE mainShipment = 'YES' END"""
    return f"""SELECT f.* FROM (SELECT * FROM t WHERE {where}) AS f
               JOIN (SELECT orderCode, shipmentType AS g, count(*) AS size FROM t WHERE {where} GROUP BY 1, 2) AS type_groups
                 USING (orderCode)
               WHERE CASE f.shipmentType WHEN '{FTL}' THEN true WHEN '{LTL}' THEN size = 1 OR mainShipment = 'NO'
                     ELSE mainShipment = 'YES' END"""


_MONEY = """count(DISTINCT orderCode) AS order_count, sum(coalesce(rev, 0)) AS total_revenue,
    sum(coalesce(cost, 0)) AS total_cost, sum(coalesce(rev, 0)) - sum(coalesce(cost, 0)) AS total_profit,
    coalesce(sum(cost) FILTER (WHERE pickLocationName = dropLocationName), 0) AS crossdock_cost,
    coalesce(sum(rev) FILTER (WHERE pickLocationName = dropLocationName), 0) AS crossdock_revenue"""


def lane_sql(kind: str, compat: str = "corrected", extra: str = "true") -> str:
    return f"""
  SELECT *, {table0('crossdock_cost', 'total_cost')} AS crossdock_cost_pct, {table0('total_profit', 'total_revenue')} AS margin_pct
  FROM (SELECT startMarket || ' → ' || endMarket AS lane, startMarket AS start_market, endMarket AS end_market, {_MONEY}
        FROM ({rows_sql(f"{DELIVERED} AND {HAS_LANE} AND {extra}", kind, compat)}) GROUP BY startMarket, endMarket)
"""


LANE_COLUMNS = (
    "lane s, start_market s, end_market s, order_count i, total_revenue d, total_cost d, total_profit d,"
    "crossdock_cost d, crossdock_cost_pct d, margin_pct d"
)
for _short, _kind in SHORT.items():
    case(f"o11_profit_by_lane_{_short}", LANE_COLUMNS, lane_sql(_kind))(
        lambda x, kind=_kind: L.profit_by_lane(x.typed, FIRST, LAST, kind)
    )
case("o11_profit_by_lane_all_reference", LANE_COLUMNS, lane_sql("All", "reference"))(
    lambda x: L.profit_by_lane(x.typed, FIRST, LAST, compat="reference")
)
case(
    "o11_profit_by_lane_filtered",
    LANE_COLUMNS,
    lane_sql("All", extra=f"clientName IN ('DoorDash', 'Customer#000000004') AND {LANE_TEXT} IN ('M03 → M01', '{CLIENT_LANE}')"),
)(
    lambda x: L.profit_by_lane(
        x.typed, FIRST, LAST, customers=["DoorDash", "Customer#000000004"], lanes=["M03 → M01", CLIENT_LANE]
    )
)
case(
    "o11_profit_by_lane_city",
    "lane s, start_city s, end_city s, order_count i, total_revenue d, total_cost d, total_profit d, crossdock_cost d, margin_pct d",
    f"""SELECT *, {table0('total_profit', 'total_revenue')} AS margin_pct
        FROM (SELECT {CITY_LANE} AS lane, pickCity || ', ' || pickState AS start_city, dropCity || ', ' || dropState AS end_city, {_MONEY}
              FROM ({rows_sql(f"{DELIVERED} AND ({CITY_LANE}) IS NOT NULL", 'All')}) GROUP BY ALL)""",
)(lambda x: L.profit_by_lane(x.typed, FIRST, LAST, level="city"))
case(
    "t02_lanes_by_profit",
    "lane s, total_profit d",
    f"SELECT lane, total_profit FROM ({lane_sql('All')}) ORDER BY total_profit DESC, lane",
)(lambda x: L.profit_by_lane(x.typed, FIRST, LAST))
case(
    "o12_lane_kpis",
    "total_revenue d, total_cost d, total_profit d, crossdock_cost d, crossdock_cost_pct d",
    f"""SELECT *, CASE WHEN total_cost > 0 THEN {printed0('crossdock_cost', 'total_cost')} ELSE 0 END AS crossdock_cost_pct
        FROM (SELECT sum(total_revenue) AS total_revenue, sum(total_cost) AS total_cost, sum(total_profit) AS total_profit,
              sum(crossdock_cost) AS crossdock_cost FROM ({lane_sql('All')}))""",
)(lambda x: L.lane_kpis(L.profit_by_lane(x.typed, FIRST, LAST)))

# ---- drill-down ----------------------------------------------------------------
CLIENT_WHERE, LANE_WHERE = "clientName = 'DoorDash'", "startMarket || ' → ' || endMarket = 'M03 → M01'"


def drill_sql(where: str, kind: str, compat: str = "corrected", limit: str = "") -> str:
    return f"""
  SELECT orderCode AS order_code, warpId AS leg_id, mainShipment AS main_shipment, startMarket || ' → ' || endMarket AS lane,
    clientName AS client, carrierName AS carrier, pickLocationName AS pick_location, dropLocationName AS drop_location,
    coalesce(rev, 0) AS revenue, coalesce(cost, 0) AS cost, coalesce(rev, 0) - coalesce(cost, 0) AS profit,
    CASE WHEN pickLocationName = dropLocationName THEN 'Yes' ELSE 'No' END AS crossdock, shipmentType AS shipment_type,
    pickWindowFrom AS pick_window_from
  FROM ({rows_sql(f"{DELIVERED} AND {where}", kind, compat)})
  ORDER BY orderCode NULLS FIRST, mainShipment DESC NULLS LAST, warpId {limit}
"""


DRILL_COLUMNS = (
    "order_code s, leg_id s, main_shipment s, lane s, client s, carrier s, pick_location s, drop_location s,"
    "revenue d, cost d, profit d, crossdock s, shipment_type s, pick_window_from s"
)
for _short, _kind in SHORT.items():
    case(f"o13_drill_down_customer_{_short}", DRILL_COLUMNS, drill_sql(CLIENT_WHERE, _kind))(
        lambda x, kind=_kind: L.drill_down(x.typed, FIRST, LAST, "customer", "DoorDash", shipment_type=kind)
    )
case("o13_drill_down_lane", DRILL_COLUMNS, drill_sql(LANE_WHERE, "All"))(
    lambda x: L.drill_down(x.typed, FIRST, LAST, "lane", "M03 → M01")
)
case("o13_drill_down_customer_lane", DRILL_COLUMNS, drill_sql(f"{CLIENT_WHERE} AND {LANE_TEXT} = '{CLIENT_LANE}'", "All"))(
    lambda x: L.drill_down(x.typed, FIRST, LAST, "customer", "DoorDash", CLIENT_LANE)
)
case(
    "s09_numbered_drill_down",
    "row i, " + DRILL_COLUMNS,
    f"""SELECT *, row_number() OVER (ORDER BY order_code NULLS FIRST, main_shipment DESC NULLS LAST, leg_id NULLS FIRST) AS row
        FROM ({drill_sql(CLIENT_WHERE, "All")})""",
)(
    lambda x: number_report(
        L.drill_down(x.typed, FIRST, LAST, "customer", "DoorDash"),
        x.folder("numbered"),
        F.asc("order_code"),
        F.desc("main_shipment"),
        F.asc("leg_id"),
    )
)
case("o13_drill_down_reference", DRILL_COLUMNS, drill_sql(CLIENT_WHERE, "All", "reference"))(
    lambda x: L.drill_down(x.typed, FIRST, LAST, "customer", "DoorDash", compat="reference")
)
case(
    "t03_drill_down_order",
    "order_code s, leg_id s, main_shipment s",
    drill_sql(CLIENT_WHERE, "All", limit="LIMIT 5000"),
)(lambda x: L.drill_down(x.typed, FIRST, LAST, "customer", "DoorDash", limit=5000))
case(
    "o14_drill_down_kpis",
    "orders i, rows i, total_revenue d, total_cost d, total_profit d, crossdock_cost d, crossdock_cost_pct d",
    f"""SELECT *, CASE WHEN total_cost > 0 THEN {printed0('crossdock_cost', 'total_cost')} ELSE 0 END AS crossdock_cost_pct
        FROM (SELECT count(DISTINCT order_code) AS orders, count(*) AS rows, sum(revenue) AS total_revenue,
              sum(cost) AS total_cost, sum(profit) AS total_profit,
              sum(CASE crossdock WHEN 'Yes' THEN cost ELSE 0 END) AS crossdock_cost
              FROM ({drill_sql(CLIENT_WHERE, 'All')}))""",
)(lambda x: L.drill_down_kpis(L.drill_down(x.typed, FIRST, LAST, "customer", "DoorDash")))


# ---- within one market ------------------------------------------------------------
def within_sql(kind: str, crossdock: bool = True, compat: str = "corrected") -> str:
    counted = "true" if crossdock else "pickLocationName <> dropLocationName"
    return f"""
  SELECT *, {printed0('total_profit', 'total_revenue')} AS margin_pct
  FROM (SELECT startMarket AS market, {_MONEY}
        FROM (SELECT * FROM ({rows_sql(f"{DELIVERED} AND {SAME_MARKET}", kind, compat)}) WHERE {counted})
        GROUP BY startMarket)
"""


WITHIN_COLUMNS = (
    "market s, order_count i, total_revenue d, total_cost d, total_profit d, crossdock_cost d, crossdock_revenue d, margin_pct d"
)
for _short, _kind in SHORT.items():
    for _xd in (True, False):
        case(f"o15_within_market_{_short}{'' if _xd else '_no_crossdock'}", WITHIN_COLUMNS, within_sql(_kind, _xd))(
            lambda x, kind=_kind, xd=_xd: L.profit_within_market(x.typed, FIRST, LAST, kind, xd)
        )
for _xd in (True, False):
    case(
        f"o15_within_market_reference{'' if _xd else '_no_crossdock'}", WITHIN_COLUMNS, within_sql("All", _xd, "reference")
    )(lambda x, xd=_xd: L.profit_within_market(x.typed, FIRST, LAST, crossdock=xd, compat="reference"))
case(
    "o16_within_market_kpis",
    "total_revenue d, total_cost d, total_profit d, total_orders i",
    f"""SELECT sum(total_revenue) AS total_revenue, sum(total_cost) AS total_cost, sum(total_profit) AS total_profit,
        sum(order_count) AS total_orders FROM ({within_sql('All')})""",
)(lambda x: L.within_market_kpis(L.profit_within_market(x.typed, FIRST, LAST)))

# ---- the row selection itself --------------------------------------------------------
_SELECTED = ["orderCode", "warpId", "mainShipment", "shipmentType", "revenueAllocationNumber"]
_COMPLETE = "shipmentStatus = 'Complete'"
SELECTED_COLUMNS = "orderCode s, warpId s, mainShipment s, shipmentType s, revenueAllocationNumber d"


def selected(x: Tables, kind: str, compat: str = "corrected"):
    return R.select_financial_rows(x.typed.where(_COMPLETE), kind, compat, _SELECTED)


for _short, _kind in SHORT.items():
    case(f"r01_financial_rows_{_short}", SELECTED_COLUMNS, rows_sql(_COMPLETE, _kind))(
        lambda x, kind=_kind: selected(x, kind)
    )
case("j03_financial_rows_reference", SELECTED_COLUMNS, rows_sql(_COMPLETE, "All", "reference"))(
    lambda x: selected(x, "All", "reference")
)
