"""Order-shape rules, joins and inherited codes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import FIRST, LAST, Tables, case
from checks.client import LEG_CODES_SQL
from checks.sql import DIFFERENT_PLACES, MARKET, ONE_XDOCK, pct
from lanewise.functions import predicates as P
from lanewise.functions.places import leg_number
from lanewise.operators import dedup as D
from lanewise.operators import joins as J
from lanewise.operators import orders as R
from lanewise.operators.chains import root_legs
from lanewise.sources import star_schema
from lanewise.sources.staging import explode_route_shipments

_COUNTS = """count(*) AS total_rows, count(*) FILTER (WHERE mainShipment = 'YES') AS yes_count,
    count(*) FILTER (WHERE mainShipment = 'NO') AS no_count"""
case(
    "a01_order_row_counts",
    "orderCode s, total_rows i, yes_count i, no_count i",
    f"SELECT orderCode, {_COUNTS} FROM legs GROUP BY orderCode",
)(lambda x: R.order_row_counts(x.typed))
case(
    "a01_order_row_counts_by_type",
    "orderCode s, shipmentType s, total_rows i, yes_count i, no_count i",
    f"SELECT orderCode, shipmentType, {_COUNTS} FROM legs GROUP BY ALL",
)(lambda x: R.order_row_counts(x.typed, by_type=True))
case(
    "w08_rows_with_order_total",
    "shipmentType s, total_rows i, rows i",
    """SELECT shipmentType, total_rows, count(*) AS rows
       FROM (SELECT shipmentType, count(*) OVER (PARTITION BY orderCode) AS total_rows FROM legs) GROUP BY ALL""",
)(
    lambda x: J.with_order_counts(x.typed.select("orderCode", "warpId", "shipmentType"), R.order_row_counts(x.typed))
    .groupBy("shipmentType", "total_rows")
    .agg(F.count(F.lit(1)).alias("rows"))
)
case(
    "j02_legs_with_order_counts",
    "warpId s, total_rows i, no_count i",
    f"SELECT warpId, total_rows, no_count FROM legs JOIN (SELECT orderCode, {_COUNTS} FROM legs GROUP BY 1) USING (orderCode)",
)(lambda x: J.with_order_counts(x.typed.select("orderCode", "warpId"), R.order_row_counts(x.typed)))
case(
    "r02_classify_order",
    "orderCode s, shipmentType s, shape s",
    """SELECT orderCode, shipmentType,
         CASE shipmentType WHEN 'Less Than Truckload' THEN if(rows = 1, 'LTL direct', 'LTL multi-leg')
           ELSE CASE WHEN no_rows > 0 THEN 'FTL multistop' WHEN yes_rows <= 1 THEN 'FTL direct'
                     WHEN loads > 1 THEN 'FTL several loads' ELSE 'FTL multidrop' END END AS shape
       FROM (SELECT orderCode, shipmentType, count(*) AS rows, count(DISTINCT loadId) AS loads,
               count(*) FILTER (WHERE mainShipment = 'YES') AS yes_rows, count(*) FILTER (WHERE mainShipment = 'NO') AS no_rows
             FROM legs WHERE orderCode <> '' AND shipmentType LIKE '%Truckload' GROUP BY ALL)""",
)(lambda x: R.classify_order(x.typed))

# ---- money per order ------------------------------------------------------------
_XD2 = "coalesce(pickLocationName = dropLocationName AND contains(pickLocationName, 'WTCH-'), false)"
_LTL_MONEY = f"""
  SELECT orderCode, coalesce(sum(rev) FILTER (WHERE mainShipment = 'YES'), 0) AS header_revenue,
    coalesce(sum(rev) FILTER (WHERE mainShipment = 'NO' AND NOT {_XD2}), 0) AS leg_revenue
  FROM t WHERE shipmentType = 'Less Than Truckload' AND orderCode <> '' GROUP BY orderCode
"""
case(
    "r05_ltl_order_revenue",
    "orderCode s, header_revenue d, leg_revenue d, revenue d",
    f"SELECT *, if(header_revenue > 0, header_revenue, leg_revenue) AS revenue FROM ({_LTL_MONEY})",
)(lambda x: R.ltl_order_revenue(x.typed))
case(
    "r06_ltl_order_pieces",
    "orderCode s, pieces i",
    f"""SELECT orderCode, if(h > 0, h, l) AS pieces FROM (
          SELECT orderCode, coalesce(sum(pieces) FILTER (WHERE mainShipment = 'YES'), 0) AS h,
            coalesce(sum(pieces) FILTER (WHERE rev > 0 AND NOT {_XD2}), 0) AS l
          FROM t WHERE shipmentType = 'Less Than Truckload' AND orderCode <> '' GROUP BY 1)""",
)(lambda x: R.ltl_order_pieces(x.typed))
case(
    "r07_order_cost",
    "orderCode s, cost d",
    "SELECT orderCode, coalesce(sum(cost), 0) AS cost FROM t WHERE orderCode <> '' GROUP BY 1",
)(lambda x: R.order_cost(x.typed))
_FTL_SQL = f"""
  SELECT orderCode, sum(coalesce(rev, 0)) AS revenue, sum(coalesce(cost, 0)) AS cost,
    sum(coalesce(rev, 0)) - sum(coalesce(cost, 0)) AS profit,
    coalesce(sum(pieces) FILTER (WHERE mainShipment = 'YES'), 0) AS pieces,
    count(*) FILTER (WHERE mainShipment = 'YES' AND {ONE_XDOCK}) > 0 AS touches_market
  FROM t WHERE shipmentType = 'Full Truckload' AND orderCode <> '' GROUP BY orderCode
"""
for _suffix, _only in (("", False), ("_market_only", True)):
    case(
        f"r08_ftl_order_pnl{_suffix}",
        "orderCode s, revenue d, cost d, profit d, pieces i, touches_market b",
        f"SELECT * FROM ({_FTL_SQL}) {'WHERE touches_market' if _only else ''}",
    )(lambda x, only=_only: R.ftl_order_pnl(x.typed, market_only=only))
case(
    "r09_ftl_market_split",
    "orderCode s, market s, legs i, pieces i, revenue d, cost d",
    f"""SELECT orderCode, {MARKET} AS market, count(*) AS legs, sum(coalesce(pieces, 0)) AS pieces,
          sum(coalesce(rev, 0)) AS revenue, sum(coalesce(cost, 0)) AS cost
        FROM t WHERE shipmentType = 'Full Truckload' AND orderCode <> '' AND mainShipment = 'YES' AND {ONE_XDOCK}
          AND {MARKET} IS NOT NULL GROUP BY 1, 2""",
)(lambda x: R.ftl_market_split(x.typed))
case(
    "r10_revenue_pattern",
    "pattern s, orders i, share_pct d",
    f"""SELECT *, {pct('orders', 'everything')} AS share_pct FROM (
          SELECT CASE WHEN header_revenue = 0 AND leg_revenue = 0 THEN 'no revenue'
              WHEN header_revenue = leg_revenue THEN 'header repeats legs' WHEN header_revenue = 0 THEN 'header zero'
              WHEN leg_revenue = 0 THEN 'legs zero' ELSE 'different' END AS pattern,
            count(*) AS orders, (SELECT count(*) FROM ({_LTL_MONEY})) AS everything
          FROM ({_LTL_MONEY}) GROUP BY 1)""",
)(lambda x: R.revenue_pattern(x.typed))


def _overlap(side: str) -> str:
    return f"""
  SELECT '{side}' AS side, count(*) AS orders, count(*) FILTER (WHERE EXISTS (
      SELECT 1 FROM legs h JOIN legs l USING (orderCode, {side}LocationName)
      WHERE h.orderCode = o.orderCode AND h.mainShipment = 'YES' AND l.mainShipment = 'NO' AND {side}LocationName <> ''))
    AS matching
  FROM (SELECT orderCode FROM legs WHERE orderCode <> '' GROUP BY orderCode
        HAVING bool_or(mainShipment = 'YES') AND bool_or(mainShipment = 'NO')) AS o
"""


case(
    "r11_dedup_overlap",
    "side s, orders i, matching i, match_pct d",
    f"SELECT *, {pct('matching', 'orders')} AS match_pct FROM ({_overlap('pick')} UNION ALL {_overlap('drop')})",
)(lambda x: R.dedup_overlap(x.typed))
case(
    "r12_orders_pnl",
    "code s, customerName s, shipmentType s, status s, revenue d, cost d, profit d",
    "SELECT code, customerName, shipmentType, status, revenue, cost, revenue - cost AS profit FROM orders_fin",
)(lambda x: R.orders_pnl(x.orders))

# ---- joins ------------------------------------------------------------------------
_CLIENT_ORDERS = f"""SELECT orderCode FROM t WHERE clientName = 'DoorDash' AND mainShipment = 'YES'
    AND shipmentStatus = 'Complete' AND pf::DATE BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"""


def client_orders(x: Tables):
    wanted = P.client_is("DoorDash") & P.is_main() & P.is_complete() & P.pick_day_between(FIRST, LAST)
    return x.typed.where(wanted).select("orderCode")


case(
    "j04_legs_of_orders",
    "orderCode s, warpId s",
    f"SELECT orderCode, warpId FROM legs WHERE orderCode IN ({_CLIENT_ORDERS})",
)(lambda x: J.legs_of(x.typed.select("orderCode", "warpId"), client_orders(x)))
case(
    "j05_inherited_codes",
    "orderCode s, first_pick_code s, last_drop_code s",
    f"SELECT * FROM ({LEG_CODES_SQL}) WHERE coalesce(first_pick_code, last_drop_code) IS NOT NULL",
)(lambda x: D.inherited_codes(x.typed))
case(
    "w01_earliest_pickup_code",
    "orderCode s, first_pick_code s",
    f"""SELECT orderCode, pickupDelayCode AS first_pick_code FROM t
        WHERE pickupDelayCode <> '' AND orderCode <> '' AND {DIFFERENT_PLACES}
        QUALIFY row_number() OVER (PARTITION BY orderCode ORDER BY pf ASC NULLS FIRST, warpId) = 1""",
)(lambda x: D.earliest_pickup_code(x.typed))
case(
    "w02_latest_dropoff_code",
    "orderCode s, last_drop_code s",
    f"""SELECT orderCode, deliveryDelayCode AS last_drop_code FROM t
        WHERE deliveryDelayCode <> '' AND orderCode <> '' AND {DIFFERENT_PLACES}
        QUALIFY row_number() OVER (PARTITION BY orderCode ORDER BY df DESC NULLS LAST, warpId DESC) = 1""",
)(lambda x: D.latest_dropoff_code(x.typed))
case(
    "j06_header_order_cost",
    "warpId s, cost d",
    """SELECT h.warpId, c.cost FROM t AS h
       JOIN (SELECT orderCode, coalesce(sum(cost), 0) AS cost FROM t WHERE orderCode <> '' GROUP BY 1) AS c USING (orderCode)
       WHERE h.mainShipment = 'YES'""",
)(lambda x: J.attach(x.typed.where(P.is_main()).select("orderCode", "warpId"), R.order_cost(x.typed), "orderCode", "inner"))
case(
    "j08_orders_with_lane",
    "warpId s, customerName s, orderType s, orderRevenue d, startMarket s, endMarket s",
    """SELECT warpId, customerName, o.shipmentType AS orderType, o.revenue AS orderRevenue, startMarket, endMarket
       FROM orders_fin AS o JOIN t ON o.code = t.orderCode AND t.mainShipment = 'YES'""",
)(
    lambda x: J.orders_with_lane(
        x.orders, x.typed.select("orderCode", "warpId", "mainShipment", "startMarket", "endMarket")
    )
)
case(
    "j09_reconcile_orders",
    "code s, orders_revenue d, legs_revenue d, revenue_diff d, cost_diff d",
    """SELECT code, o.revenue AS orders_revenue, legs_revenue, legs_revenue - o.revenue AS revenue_diff,
         legs_cost - o.cost AS cost_diff
       FROM orders_fin AS o JOIN (SELECT orderCode, sum(coalesce(rev, 0)) AS legs_revenue, sum(coalesce(cost, 0)) AS legs_cost
                                  FROM t GROUP BY 1) ON orderCode = code""",
)(lambda x: J.reconcile_orders(x.orders, x.typed))
case(
    "j10_with_carrier",
    "carrierName s, legs i, known i, balance d",
    """SELECT carrierName, count(*) AS legs, count(s_name) AS known, max(s_acctbal) AS balance
       FROM legs LEFT JOIN supplier ON s_name = carrierName GROUP BY 1""",
)(
    lambda x: J.with_carrier(
        x.typed.select("carrierName"), x.table("supplier").selectExpr("s_name AS name", "s_acctbal AS balance")
    )
    .groupBy("carrierName")
    .agg(
        F.count(F.lit(1)).alias("legs"),
        F.count("carrier_balance").alias("known"),
        F.max("carrier_balance").alias("balance"),
    )
)
case(
    "j10_with_client",
    "clientName s, legs i, segment s",
    """SELECT clientName, count(*) AS legs, max(c_mktsegment) AS segment
       FROM legs LEFT JOIN customer ON c_name = clientName GROUP BY 1""",
)(
    lambda x: J.with_client(
        x.typed.select("clientName"), x.table("customer").selectExpr("c_name AS name", "c_mktsegment AS segment")
    )
    .groupBy("clientName")
    .agg(F.count(F.lit(1)).alias("legs"), F.max("client_segment").alias("segment"))
)
case(
    "j11_leg_number",
    "leg_number i, orderCode s",
    """SELECT n AS leg_number, l.orderCode
       FROM (SELECT orderCode, max(substr(warpId, 3)::BIGINT) AS n FROM legs GROUP BY 1) AS o
       JOIN legs AS l ON substr(l.warpId, 3)::BIGINT = o.n""",
)(
    lambda x: x.typed.select(leg_number(F.col("warpId")).alias("leg_number"), "orderCode").join(
        x.typed.groupBy("orderCode").agg(F.max(leg_number(F.col("warpId"))).alias("leg_number")).select("leg_number"),
        "leg_number",
    )
)


case(
    "j11_orders_with_leg",
    "code s, leg_number i, warpId s, shipmentType s",
    """SELECT code, legNumber AS leg_number, l.warpId, l.shipmentType
       FROM orders_fin AS o JOIN legs AS l ON substr(l.warpId, 3)::BIGINT = legNumber""",
)(lambda x: J.orders_with_leg(x.orders, x.typed))


def shipments(x: Tables):
    """Every leg names the smallest leg id of its order as parent; that one names none."""
    first = x.typed.groupBy("orderCode").agg(F.min("warpId").alias("parent"))
    return J.attach(x.typed.select("orderCode", "warpId"), first, "orderCode", "inner").select(
        "warpId", F.when(F.col("parent") != F.col("warpId"), F.col("parent")).alias("parent")
    )


case(
    "j12_with_parent",
    "warpId s, parent s, grandparent s, parent_found b",
    """SELECT s.warpId, s.parent, p.parent AS grandparent, p.warpId IS NOT NULL AS parent_found
       FROM (SELECT warpId, nullif(min(warpId) OVER (PARTITION BY orderCode), warpId) AS parent FROM legs) AS s
       LEFT JOIN (SELECT warpId, nullif(min(warpId) OVER (PARTITION BY orderCode), warpId) AS parent FROM legs) AS p
         ON p.warpId = s.parent""",
)(lambda x: J.with_parent(shipments(x)))


def shipment_chains(x: Tables):
    """Every leg names the next smaller leg id of its order; in one order of twenty the smallest names the largest."""
    order = Window.partitionBy("orderCode")
    number = F.substring("orderCode", 3, 20).cast("bigint")
    before = F.lag("warpId").over(order.orderBy("warpId"))
    round_ = F.when(number % 20 == 0, F.max("warpId").over(order))
    return x.typed.select("orderCode", "warpId").distinct().select("warpId", F.coalesce(before, round_).alias("parent"))


case(
    "j12_root_legs",
    "warpId s, root s, depth i, in_cycle b",
    """SELECT warpId, CASE WHEN NOT c THEN min(warpId) OVER w END AS root,
         CASE WHEN NOT c THEN row_number() OVER (PARTITION BY orderCode ORDER BY warpId) - 1 END AS depth, c AS in_cycle
       FROM (SELECT DISTINCT warpId, orderCode, substr(orderCode, 3)::BIGINT % 20 = 0 AS c FROM legs)
       WINDOW w AS (PARTITION BY orderCode)""",
)(lambda x: root_legs(shipment_chains(x), x.folder("roots")))
case(
    "s11_explode_route_shipments",
    "routeId s, leg_code s",
    "SELECT loadId AS routeId, unnest([warpId, warpId || '0']) AS leg_code FROM legs",
)(lambda x: explode_route_shipments(star_schema.route_codes(x.typed)))
case(
    "j13_route_membership",
    "routeId s, warpId s, orderCode s",
    "SELECT r.loadId AS routeId, warpId, l.orderCode FROM legs AS r JOIN legs AS l USING (warpId)",
)(lambda x: J.route_membership(star_schema.route_codes(x.typed), x.typed, ["orderCode"]))
