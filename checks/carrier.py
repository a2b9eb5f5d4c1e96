"""Carrier transit and deduplicated on-time family."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import CARRIER, CLIENT, FIRST, LAST, Tables, case
from checks.sql import pct
from lanewise.operators import dedup as D
from lanewise.operators import orders as R
from lanewise.operators.joins import with_route
from lanewise.plans import carrier as C


def _morning(at: str, window: str) -> str:
    return f"CASE WHEN {at} > {window}::DATE + INTERVAL 9 HOUR THEN 'Late' ELSE 'On Time' END"


def _late_days(at: str, window: str) -> str:
    return f"CASE WHEN {at}::DATE < {window}::DATE THEN 0 ELSE {at}::DATE - {window}::DATE END"


_DAYS = "round_even(epoch(da - pa)::DOUBLE / 86400 * 100, 0) / 100"

TRANSIT_SQL = f"""
  SELECT loadId AS load_id, warpId AS leg_id, pf AS scheduled_pick, pa AS actual_pick,
    {_morning('pa', 'pf')} AS otp, {_late_days('pa', 'pf')} AS otp_days_late,
    df AS scheduled_drop, da AS actual_drop, {_morning('da', 'df')} AS otd, {_late_days('da', 'df')} AS otd_days_late,
    {_DAYS} AS transit_days, palletCount AS pallet_count, try_cast(transitCost AS DECIMAL(18,4)) AS transit_cost
  FROM t LEFT JOIN routes ON routeId = loadId
  WHERE carrierName = '{CARRIER}' AND shipmentStatus = 'Complete' AND pickWindowFrom NOT IN ('', 'Invalid date')
    AND pf BETWEEN TIMESTAMP '{FIRST}' AND TIMESTAMP '{LAST}'
"""


def transit(x: Tables):
    return C.carrier_transit(x.typed, x.routes, CARRIER, FIRST, LAST)


case(
    "o01_carrier_transit",
    "load_id s, leg_id s, scheduled_pick t, actual_pick t, otp s, otp_days_late i, scheduled_drop t, actual_drop t,"
    "otd s, otd_days_late i, transit_days d, pallet_count i, transit_cost d",
    TRANSIT_SQL,
)(transit)
case(
    "o02_carrier_transit_kpis",
    "loads i, avg_transit_days r, min_transit_days d, max_transit_days d, avg_transit_cost r",
    f"""SELECT count(*) AS loads, avg(transit_days) AS avg_transit_days, min(transit_days) AS min_transit_days,
        max(transit_days) AS max_transit_days, avg(transit_cost::DOUBLE) AS avg_transit_cost FROM ({TRANSIT_SQL})""",
)(lambda x: C.carrier_transit_kpis(transit(x)))

case(
    "j01_with_route",
    "carrier s, legs i, with_load i, pallets i",
    """SELECT carrierName AS carrier, count(*) AS legs, count(routeId) AS with_load, sum(palletCount) AS pallets
       FROM legs LEFT JOIN routes ON loadId = routeId GROUP BY 1""",
)(
    lambda x: with_route(x.raw.select("loadId", "warpId", "carrierName"), x.routes)
    .groupBy(F.col("carrierName").alias("carrier"))
    .agg(
        F.count(F.lit(1)).alias("legs"),
        F.count("palletCount").alias("with_load"),
        F.sum("palletCount").alias("pallets"),
    )
)


def first_stop_sql(side: str, where: str) -> str:
    """One row per stop by a window, the way a ranking query would do it."""
    at = {"pick": "pa", "drop": "da"}[side]
    return f"""
      SELECT * FROM t WHERE {where}
      QUALIFY row_number() OVER (PARTITION BY loadId, carrierName, {side}LocationName, {at}::DATE
                                 ORDER BY {at} ASC NULLS FIRST, warpId) = 1
    """


_DONE = {s: f"(shipmentStatus = 'Complete' OR {s}Status = 'Succeeded')" for s in ("pick", "drop")}
_TIMED = {s: f"{s}TimeArrived IS NOT NULL AND {s}WindowTo IS NOT NULL" for s in ("pick", "drop")}

case(
    "o26_carrier_otp",
    "shipmentType s, total i, on_time i, otp_pct d",
    f"""SELECT *, {pct('on_time', 'total')} AS otp_pct FROM (
          SELECT shipmentType, count(*) AS total, count(*) FILTER (WHERE pa < pt) AS on_time
          FROM ({first_stop_sql('pick', f"{_DONE['pick']} AND {_TIMED['pick']} AND carrierName = '{CARRIER}' "
                                "AND pf >= DATE '1997-01-01' AND pf < DATE '1998-01-01'")})
          GROUP BY 1)""",
)(lambda x: C.carrier_otp(x.typed, CARRIER, FIRST, "1998-01-01"))

case(
    "o26_carrier_otd",
    "shipmentType s, total i, on_time i, otd_pct d",
    f"""SELECT *, {pct('on_time', 'total')} AS otd_pct FROM (
          SELECT shipmentType, count(*) AS total, count(*) FILTER (WHERE da < dt) AS on_time
          FROM ({first_stop_sql('drop', f"{_DONE['drop']} AND {_TIMED['drop']} AND carrierName = '{CARRIER}' "
                                "AND df >= DATE '1997-01-01' AND df < DATE '1998-01-01'")})
          GROUP BY 1)""",
)(lambda x: C.carrier_otd(x.typed, CARRIER, FIRST, "1998-01-01"))

case(
    "o30_site_otd",
    "dropLocationName s, shipmentType s, total i, on_time i, otd_pct d",
    f"""SELECT *, {pct('on_time', 'total')} AS otd_pct FROM (
          SELECT dropLocationName, shipmentType, count(*) AS total, count(*) FILTER (WHERE da < dt) AS on_time
          FROM ({first_stop_sql('drop', f"{_DONE['drop']} AND {_TIMED['drop']} "
                                "AND regexp_matches(dropLocationName, 'Door[Dd]ash')")})
          GROUP BY 1, 2)""",
)(lambda x: C.site_otd(x.typed, CLIENT))

for _id, _side, _dedup in (("w03", "pick", D.dedup_pickups), ("w04", "drop", D.dedup_deliveries)):
    case(
        f"{_id}_dedup_{_side}",
        "warpId s, carrierName s, shipmentType s",
        first_stop_sql(_side, "shipmentStatus = 'Complete'"),
    )(
        lambda x, dedup=_dedup: dedup(
            x.typed.where("shipmentStatus = 'Complete'"), ["warpId", "carrierName", "shipmentType"]
        )
    )


def _kept(side: str, at: str) -> str:
    key = f"loadId || '|' || carrierName || '|' || {side}LocationName || '|' || strftime({at}::DATE, '%Y-%m-%d')"
    return f"row_number() OVER (PARTITION BY {key} ORDER BY {at} ASC NULLS FIRST, warpId) = 1"


case(
    "w05_flag_dedup",
    "warpId s, keep_for_pickup b, keep_for_delivery b",
    f"SELECT warpId, {_kept('pick', 'pa')} AS keep_for_pickup, {_kept('drop', 'da')} AS keep_for_delivery FROM t",
)(lambda x: D.flag_dedup(x.typed.select("warpId", "loadId", "carrierName", "pickLocationName", "dropLocationName",
                                        "pick_arrived_ts", "drop_arrived_ts"), x.folder("flags")))

case(
    "r03_perspective_customer",
    "warpId s, mainShipment s",
    "SELECT warpId, mainShipment FROM legs WHERE mainShipment = 'YES' AND shipmentStatus = 'Complete'",
)(lambda x: R.perspective(x.typed, "customer", columns=["warpId", "mainShipment"]))
case(
    "r03_perspective_carrier",
    "warpId s, mainShipment s",
    first_stop_sql("pick", f"{_DONE['pick']} AND pickTimeArrived IS NOT NULL"),
)(lambda x: R.perspective(x.typed, "carrier", "pick", ["warpId", "mainShipment"]))

case(
    "r04_carrier_shipment_count",
    "carrierName s, shipmentType s, shipments i",
    """SELECT carrierName, shipmentType, count(*) AS shipments FROM (
         SELECT carrierName, shipmentType, mainShipment, count(*) OVER (PARTITION BY carrierName, orderCode) AS n
         FROM legs WHERE shipmentType = 'Less Than Truckload' AND orderCode IS NOT NULL AND (shipmentStatus = 'Complete' OR pickStatus = 'Succeeded')
         QUALIFY n = 1 OR mainShipment = 'NO') GROUP BY ALL
       UNION ALL
       SELECT carrierName, shipmentType, count(*) FROM (
         SELECT * FROM t WHERE shipmentType = 'Full Truckload' AND (shipmentStatus = 'Complete' OR pickStatus = 'Succeeded')
         QUALIFY row_number() OVER (PARTITION BY loadId, carrierName, pickLocationName, pa::DATE) = 1) GROUP BY ALL""",
)(
    lambda x: R.carrier_shipment_count(x.typed)
)
