"""Predicates and column functions, tallied over all legs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from checks.base import AS_OF, CARRIER, CLIENT, FIRST, LAST, YEAR, Tables, case
from checks.sql import DIFFERENT_PLACES, MARKET, ONE_XDOCK, market, printed0, quarter, table0, xdock
from lanewise.functions import labels as L
from lanewise.functions import money as M
from lanewise.functions import places as G
from lanewise.functions import predicates as P
from lanewise.functions import times as T
from lanewise.operators.dedup import inherited_codes
from lanewise.operators.joins import keep_listed
from lanewise.operators.skew import attach


def tally(name: str, value: Callable[[], Column], sql: str) -> None:
    """How often each value occurs, NULL included."""
    case(
        name,
        "value s, rows i",
        f"SELECT value, count(*) AS rows FROM (SELECT ({sql})::VARCHAR AS value FROM t) GROUP BY value",
    )(lambda x: x.typed.select(value().cast("string").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("rows")))


def by_leg(name: str, columns: str, values: Callable[[], list[Column]], sql: str) -> None:
    """The value of every leg."""
    case(name, "warpId s, " + columns, f"SELECT warpId, {sql} FROM t")(
        lambda x: x.typed.select("warpId", *values())
    )


def ts(text: str) -> str:
    return f"TIMESTAMP '{text}'"


# ---- predicates -----------------------------------------------------------------
tally("p01_is_complete", P.is_complete, "shipmentStatus = 'Complete'")
tally("p02_is_done_pick", P.is_done, "shipmentStatus = 'Complete' OR pickStatus = 'Succeeded'")
tally("p02_is_done_drop", lambda: P.is_done("drop"), "shipmentStatus = 'Complete' OR dropStatus = 'Succeeded'")
tally("p03_is_present", lambda: P.is_present("pickTimeArrived"), "coalesce(length(pickTimeArrived), 0) > 0")
tally(
    "p04_is_valid_date_text",
    lambda: P.is_valid_date_text("pickWindowFrom"),
    "coalesce(pickWindowFrom NOT IN ('', 'Invalid date'), false)",
)
tally("p05_not_crossdock_leg", P.not_crossdock_leg, DIFFERENT_PLACES)
tally("p06_not_crossdock_leg_strict", lambda: P.not_crossdock_leg(strict=True), "pickLocationName <> dropLocationName")
tally("p07_is_main", P.is_main, "mainShipment = 'YES'")
tally(
    "p08_in_customers_and_lanes",
    lambda: P.in_customers(["DoorDash", "Customer#000000004"]) & P.in_lanes(["M03 → M01", "M05 → M01"]),
    "clientName IN ('DoorDash', 'Customer#000000004')"
    " AND startMarket || ' → ' || endMarket IN ('M03 → M01', 'M05 → M01')",
)
tally("p08_empty_list", lambda: P.in_customers([]) & P.in_lanes(None), "true")
case(
    "p08_keep_listed",
    "warpId s, clientName s",
    """SELECT warpId, clientName FROM legs WHERE clientName IN
       (SELECT c_name FROM customer WHERE c_mktsegment = 'MACHINERY')""",
)(
    lambda x: keep_listed(
        x.typed.select("warpId", "clientName"),
        x.table("customer").where("c_mktsegment = 'MACHINERY'").selectExpr("c_name AS clientName"),
        "clientName",
    )
)
tally("p09_pick_day_between", lambda: P.pick_day_between("1997-02-03", "1997-03-04"),
      "pf::DATE BETWEEN DATE '1997-02-03' AND DATE '1997-03-04'")
tally("p10_ts_between_midnight", lambda: P.ts_between_midnight("delivered_ts", FIRST, LAST),
      f"delivered >= {ts(FIRST)} AND delivered <= {ts(LAST)}")
tally("p11_ts_half_open", lambda: P.ts_half_open("pick_from_ts", FIRST, "1998-01-01"), "year(pf) = 1997")
tally("p12_pick_in_year", lambda: P.pick_in_year(YEAR), f"contains(pickWindowFrom, '/{YEAR}')")
tally("p13_in_last_week", lambda: P.in_last_week("drop_from_ts", AS_OF),
      f"date_trunc('week', df) = date_trunc('week', DATE '{AS_OF}' - INTERVAL 7 DAY)")
tally("p14_in_last_month", lambda: P.in_last_month("drop_from_ts", AS_OF), "strftime(df, '%Y-%m') = '1997-06'")
tally("p15_is_crossdock_location", lambda: P.is_crossdock_location("pickLocationName"), xdock("pickLocationName"))
tally("p16_touches_one_crossdock", lambda: F.coalesce(P.touches_one_crossdock(), F.lit(False)), ONE_XDOCK)
tally("p17_same_market", P.same_market, "coalesce(startMarket, '') <> '' AND startMarket = endMarket")
tally("p18_has_lane", lambda: F.coalesce(P.has_lane(), F.lit(False)),
      "coalesce(startMarket, '') <> '' AND coalesce(endMarket, '') <> ''")
tally(
    "p19_shipment_types",
    lambda: F.when(P.is_ftl(), "F").when(P.is_ltl(), "L").when(P.is_parcel() & P.is_other(), "P"),
    "CASE shipmentType WHEN 'Full Truckload' THEN 'F' WHEN 'Less Than Truckload' THEN 'L' WHEN 'Parcel' THEN 'P' END",
)
tally("p20_carrier_is", lambda: P.carrier_is(CARRIER), f"carrierName = '{CARRIER}'")
tally("p21_platform_customer_client", lambda: P.is_platform_customer(CLIENT), f"clientName = '{CLIENT}'")
tally(
    "p21_platform_customer_site",
    lambda: P.is_platform_customer(CLIENT, by="site"),
    "contains(dropLocationName, 'DoorDash') OR contains(dropLocationName, 'Doordash')",
)
case(
    "p21_platform_customer_table",
    "warpId s, clientName s",
    "SELECT warpId, clientName FROM legs WHERE contains(dropLocationName, 'DoorDash')",
)(
    lambda x: keep_listed(
        x.typed.select("warpId", "clientName"), x.typed.where(P.is_platform_customer(CLIENT, by="site")), "warpId"
    )
)
tally("p22_is_xdock_to_xdock", P.is_xdock_to_xdock,
      "pickLocationName = dropLocationName AND starts_with(pickLocationName, 'WTCH-')")
tally("p23_has_order", P.has_order, "orderCode <> ''")

# ---- functions -------------------------------------------------------------------
by_leg(
    "f01_parse_times",
    "pick_from_ts t, drop_arrived_ts t, drop_date day",
    lambda: [
        T.parse_timestamp(F.col("pickWindowFrom")).alias("pick_from_ts"),
        T.parse_timestamp(F.col("dropTimeArrived")).alias("drop_arrived_ts"),
        T.parse_date(F.col("dropDateArrived")).alias("drop_date"),
    ],
    "pf AS pick_from_ts, da AS drop_arrived_ts, try_strptime(dropDateArrived, '%m/%d/%Y') AS drop_date",
)
tally("f02_day_of", lambda: T.day_of(F.col("pick_arrived_ts")), "pa::DATE")
by_leg(
    "f03_dwell_hours",
    "pick_hours d, drop_hours d",
    lambda: [T.dwell_hours("pick").alias("pick_hours"), T.dwell_hours("drop").alias("drop_hours")],
    """CASE WHEN pickTimeArrived <> '' AND pickTimeDeparted <> '' THEN round(date_sub('minute', pa, pd) / 60.0, 2) END
         AS pick_hours,
       CASE WHEN dropTimeArrived <> '' AND dropTimeDeparted <> '' THEN round(date_sub('minute', da, dd) / 60.0, 2) END
         AS drop_hours""",
)
by_leg(
    "f04_elapsed_days",
    "days d",
    lambda: [T.elapsed_days(F.col("pick_arrived_ts"), F.col("drop_arrived_ts")).alias("days")],
    "round_even(epoch(da - pa)::DOUBLE / 86400 * 100, 0) / 100 AS days",
)
by_leg(
    "f05_morning_cutoff",
    "cutoff t",
    lambda: [T.morning_cutoff(F.col("pick_from_ts")).alias("cutoff")],
    "date_trunc('day', pf) + INTERVAL 9 HOUR AS cutoff",
)
by_leg(
    "f06_days_late",
    "pick_late i, drop_late i",
    lambda: [
        T.days_late(F.col("pick_arrived_ts"), F.col("pick_from_ts")).alias("pick_late"),
        T.days_late(F.col("drop_arrived_ts"), F.col("drop_from_ts")).alias("drop_late"),
    ],
    """if(pa IS NULL OR pf IS NULL, NULL, greatest(date_diff('day', pf, pa), 0)) AS pick_late,
       if(da IS NULL OR df IS NULL, NULL, greatest(date_diff('day', df, da), 0)) AS drop_late""",
)
for _grain in ("day", "week", "month"):
    tally(f"f07_period_start_{_grain}", lambda g=_grain: T.period_start(F.col("pick_from_ts"), g),
          f"date_trunc('{_grain}', pf)::DATE")
tally("f08_quarter_label", lambda: T.quarter_label(F.col("pickWindowFrom"), YEAR), quarter(YEAR))
tally("f09_market_of", lambda: G.market_of(F.col("pickLocationName")), market("pickLocationName"))
tally("f09_market_of_numbered_docks", lambda: G.market_of(F.col("pickLocationName"), "wtch"),
      "CASE WHEN starts_with(pickLocationName, 'WTCH-') THEN substr(pickLocationName, 6, 3) END")
tally("f10_leg_market", G.leg_market, MARKET)
tally("f11_lane_label", G.lane_label, "startMarket || ' → ' || endMarket")
tally("f11_lane_label_city", lambda: G.lane_label("city"),
      "pickCity || ', ' || pickState || ' → ' || dropCity || ', ' || dropState")
by_leg("f12_window_label", "pick_window s", lambda: [G.window_label("pick").alias("pick_window")],
       "pickWindowFrom || ' - ' || pickWindowTo AS pick_window")


@case(
    "f13_inherit_code",
    "warpId s, code s",
    f"""SELECT warpId, CASE WHEN pickupDelayCode <> '' THEN pickupDelayCode ELSE first_code END AS code
        FROM t LEFT JOIN (
          SELECT orderCode, first(pickupDelayCode ORDER BY pf ASC NULLS FIRST, warpId) AS first_code
          FROM t WHERE pickupDelayCode <> '' AND orderCode <> '' AND {DIFFERENT_PLACES} GROUP BY orderCode)
        USING (orderCode)""",
)
def inherit_code(x: Tables):
    rows = attach(x.typed.select("orderCode", "warpId", "pickupDelayCode"), inherited_codes(x.typed), "orderCode")
    return rows.select("warpId", L.blank_to(F.col("pickupDelayCode"), F.col("first_pick_code")).alias("code"))


tally("f14_code_or_none", lambda: L.code_or_none(F.col("pickupDelayCode")),
      "CASE WHEN pickupDelayCode <> '' THEN pickupDelayCode ELSE 'No Code' END")


def _window_status(raw: str, at: str, end: str, missing: str) -> str:
    return (
        f"CASE WHEN coalesce({raw}, '') = '' THEN '{missing}' WHEN {at} <= {end} THEN 'On Time' ELSE 'Late' END"
    )


tally("f16_window_status_pick", lambda: L.window_status("pick"),
      _window_status("pickTimeArrived", "pa", "pt", "No Pickup Data"))
tally("f16_window_status_drop", lambda: L.window_status("drop"),
      _window_status("dropTimeArrived", "da", "dt", "No Delivery Data"))
tally("f17_morning_status", lambda: L.morning_status("drop"),
      "CASE WHEN da > df::DATE + INTERVAL 9 HOUR THEN 'Late' ELSE 'On Time' END")
tally("f18_in_time_strict", lambda: T.in_time("pick", inclusive=False), "pa < pt")
tally("f18_in_time_inclusive", lambda: T.in_time("pick", inclusive=True), "pa <= pt")
tally("f19_lateness_hour", lambda: T.lateness("pick", "hour", hour=10), "pa > pf::DATE + INTERVAL 10 HOUR")
tally("f19_lateness_after_start", lambda: T.lateness("drop", "after_start", hours_after_start=2.5),
      "da > df + INTERVAL 150 MINUTE")
tally("f19_lateness_grace", lambda: T.lateness("drop", "grace", grace_minutes=45), "da > dt + INTERVAL 45 MINUTE")
by_leg("f20_effective_delivery", "delivered t", lambda: [F.col("delivered_ts").alias("delivered")], "delivered")
tally("f22_crossdock_label", G.crossdock_label, "if(pickLocationName = dropLocationName, 'Yes', 'No')")
by_leg("f23_profit", "profit d, raw_profit d", lambda: [M.profit().alias("profit"), M.profit(raw=True).alias("raw_profit")],
       "coalesce(rev, 0) - coalesce(cost, 0) AS profit, rev - cost AS raw_profit")
case(
    "f24_cost_per_piece_and_margin",
    "client s, cost_per_piece r, margin_pct r",
    """SELECT clientName AS client, if(p > 0, c / p, 0) AS cost_per_piece, if(r > 0, (r - c) / r * 100, 0) AS margin_pct
       FROM (SELECT clientName, sum(cost)::DOUBLE AS c, sum(rev)::DOUBLE AS r, sum(pieces)::DOUBLE AS p FROM t GROUP BY 1)""",
)(
    lambda x: x.typed.groupBy(F.col("clientName").alias("client"))
    .agg(F.sum(M.COST).alias("c"), F.sum(M.REVENUE).alias("r"), F.sum("pieces").alias("p"))
    .select(
        "client",
        M.ratio_or_zero(F.col("c"), F.col("p")).alias("cost_per_piece"),
        M.ratio_or_zero(F.col("r") - F.col("c"), F.col("r"), 100).alias("margin_pct"),
    )
)
tally(
    "f26_equipment_class",
    lambda: F.concat_ws(
        "|",
        G.equipment_temperature(F.col("equipment")),
        G.equipment_size(F.col("equipment")),
        G.equipment_has(F.col("equipment"), "Lift Gate").cast("string"),
    ),
    """CASE equipment WHEN '53-ft Trailer' THEN 'dry|53-ft|false' WHEN '53-ft Reefer' THEN 'reefer|53-ft|false'
       WHEN '26-ft Straight Truck' THEN 'dry|26-ft|false' WHEN 'Cargo Van /w Lift Gate' THEN 'dry|van|true'
       ELSE 'reefer|straight|false' END""",
)
tally(
    "f27_id_shapes",
    lambda: F.concat_ws(
        "|", *(G.has_id_shape(F.col(c), k).cast("string") for c, k in
               (("orderCode", "order"), ("warpId", "leg"), ("loadId", "load"), ("carrierName", "ulid")))
    ),
    """concat_ws('|', regexp_full_match(orderCode, '[PO]-[0-9]+-[0-9]{4}')::VARCHAR,
       regexp_full_match(warpId, 'S-[0-9]+')::VARCHAR, regexp_full_match(loadId, '[0-9]+-[0-9]{4}')::VARCHAR,
       (length(carrierName) = 26 AND regexp_full_match(carrierName, '[0-9A-HJKMNP-TV-Z]+'))::VARCHAR)""",
)
case(
    "a09_printed_percent",
    "part i, whole i, printed d, in_table d",
    f"""SELECT part, whole, {printed0('part', 'whole')} AS printed, {table0('part', 'whole')} AS in_table
        FROM (SELECT DISTINCT (l_partkey % 2001)::BIGINT AS part, (80 * (1 + l_suppkey % 25))::BIGINT AS whole
              FROM lineitem)""",
)(
    lambda x: x.table("lineitem")
    .selectExpr("l_partkey % 2001 AS part", "80 * (1 + l_suppkey % 25) AS whole")
    .distinct()
    .withColumns(
        {
            "printed": M.printed_percent(F.col("part"), F.col("whole")),
            "in_table": M.table_percent(F.col("part"), F.col("whole")),
        }
    )
)
tally("f28_iso_week", lambda: F.date_format(T.week_start(F.col("drop_from_ts")), "yyyy-MM-dd"),
      "strftime(df::DATE - (isodow(df) - 1)::INTEGER, '%Y-%m-%d')")
tally("f29_period_label", lambda: T.period_label(T.period_start(F.col("pick_from_ts"), "month")),
      "strftime(date_trunc('month', pf), '%b %d, %Y')")
case(
    "f25_consistency_score",
    "supplier i, score r",
    """SELECT l_suppkey AS supplier, abs(regr_slope(l_discount, l_quantity)) *
         coalesce(covar_pop(l_discount, l_quantity) ** 2 / nullif(var_pop(l_discount) * var_pop(l_quantity), 0), 0) * 1000
         AS score
       FROM lineitem GROUP BY 1""",
)(lambda x: consistency(x))


def consistency(x: Tables):
    from lanewise.operators.stats import r_squared, slope

    y, q = F.col("l_discount"), F.col("l_quantity")
    return x.table("lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(
        (F.abs(slope(y, q)) * r_squared(y, q) * 1000).alias("score")
    )
