"""Client on-time family."""

from __future__ import annotations

from checks.base import CLIENT, FIRST, LAST, Tables, also, case
from checks.sql import DIFFERENT_PLACES, ON_TIME_DROP, ON_TIME_PICK, headers, printed, printed0
from lanewise.plans import client as C
from lanewise.sources.reports import number_rows, with_headings

SHORT_LAST, MID_LAST = "1997-01-14", "1997-03-25"

SUMMARY_SQL = f"""
  SELECT clientName AS client, count(*) AS shipments,
    count(*) FILTER (WHERE {ON_TIME_PICK}) AS otp_on_time,
    count(*) FILTER (WHERE pickTimeArrived <> '') AS otp_total,
    count(*) FILTER (WHERE {ON_TIME_DROP}) AS otd_on_time,
    count(*) FILTER (WHERE dropTimeArrived <> '') AS otd_total
  FROM ({headers(FIRST, LAST)}) WHERE clientName IS NOT NULL GROUP BY clientName
"""
RATED_SQL = f"""
  SELECT *, {printed0('otp_on_time', 'otp_total')} AS otp_rate, {printed0('otd_on_time', 'otd_total')} AS otd_rate
  FROM ({SUMMARY_SQL})
"""
SUMMARY_COLUMNS = (
    "client s, shipments i, otp_on_time i, otp_total i, otd_on_time i, otd_total i, otp_rate d, otd_rate d"
)


def summary(x: Tables):
    return C.client_otp_otd_summary(x.typed, FIRST, LAST)


case("o03_client_otp_otd_summary", SUMMARY_COLUMNS, RATED_SQL)(summary)

case("o04_rank_clients_worst", SUMMARY_COLUMNS, f"SELECT * FROM ({RATED_SQL}) ORDER BY otd_rate, client LIMIT 20")(
    lambda x: C.rank_clients(summary(x), "worst", 20)
)
case("t01_top_clients_best", SUMMARY_COLUMNS, f"SELECT * FROM ({RATED_SQL}) ORDER BY otd_rate DESC, client LIMIT 20")(
    lambda x: C.rank_clients(summary(x), "best", 20)
)
case(
    "o04_rank_clients_selected",
    SUMMARY_COLUMNS,
    f"SELECT * FROM ({RATED_SQL}) WHERE client = 'DoorDash' OR client = 'Customer#000000007'",
)(lambda x: C.rank_clients(summary(x), "selected", names=["DoorDash", "Customer#000000007", "nobody"]))

case(
    "o05_client_kpis",
    "clients i, shipments i, otp_rate d, otd_rate d",
    f"""SELECT count(*) AS clients, sum(shipments) AS shipments,
        {printed('sum(otp_on_time)', 'sum(otp_total)')} AS otp_rate, {printed('sum(otd_on_time)', 'sum(otd_total)')} AS otd_rate
        FROM ({RATED_SQL})""",
)(lambda x: C.client_kpis(summary(x)))

case(
    "f21_rate_band",
    "client s, otp_band s, otd_band s",
    f"""SELECT client, CASE WHEN otp_rate >= 95 THEN 'good' WHEN otp_rate < 85 THEN 'poor' ELSE 'fair' END AS otp_band,
        CASE WHEN otd_rate >= 95 THEN 'good' WHEN otd_rate < 85 THEN 'poor' ELSE 'fair' END AS otd_band
        FROM ({RATED_SQL})""",
)(lambda x: C.with_bands(summary(x)))


# The export: shown columns under their titles, numbered from 1.
@case(
    "s09_client_summary_export",
    "row i, client s, shipments i, otp_on_time i, otp_rate d, otd_on_time i, otd_rate d",
    f"""SELECT row_number() OVER (ORDER BY otd_rate, client) AS row, * FROM
        (SELECT * FROM ({RATED_SQL}) ORDER BY otd_rate, client LIMIT 50)""",
)
def export(x: Tables):
    return number_rows(C.rank_clients(summary(x), "worst", 50), "otd_rate", "client")


@case(
    "p24_report_headings",
    "client_name s, total_shipments i, otd_rate_pct d",
    f"SELECT client AS client_name, shipments AS total_shipments, otd_rate AS otd_rate_pct FROM ({RATED_SQL})",
)
def titles(x: Tables):
    shown = with_headings(summary(x), "client_summary")
    return shown.withColumnsRenamed(
        {"Client Name": "client_name", "Total Shipments": "total_shipments", "OTD Rate %": "otd_rate_pct"}
    )


LEG_CODES_SQL = f"""
  SELECT orderCode,
    (array_agg(pickupDelayCode ORDER BY pf ASC NULLS FIRST, warpId ASC)
      FILTER (WHERE pickupDelayCode <> ''))[1] AS first_pick_code,
    (array_agg(deliveryDelayCode ORDER BY df DESC NULLS LAST, warpId DESC)
      FILTER (WHERE deliveryDelayCode <> ''))[1] AS last_drop_code
  FROM t WHERE {DIFFERENT_PLACES} AND orderCode <> '' GROUP BY orderCode
"""


def _status(raw: str, at: str, end: str, missing: str) -> str:
    return (
        f"CASE WHEN coalesce({raw}, '') = '' THEN '{missing}' WHEN coalesce({at} <= {end}, false) THEN 'On Time'"
        " ELSE 'Late' END"
    )


def _hours(raw_a: str, raw_b: str, a: str, b: str) -> str:
    # complete minutes / 60, two decimals, half away from zero, in integers
    minutes = f"date_sub('minute', {a}, {b})"
    return (
        f"CASE WHEN {raw_a} <> '' AND {raw_b} <> '' THEN"
        f" sign({minutes}) * ((abs({minutes}) * 200 + 60) // 120)::BIGINT / 100.0::DOUBLE END"
    )


def detail_sql(first: str = FIRST, last: str = LAST) -> str:
    return f"""
  SELECT h.orderCode AS order_code, h.warpId AS leg_id, h.shipmentType AS shipment_type,
    h.pickLocationName AS pick_location, h.dropLocationName AS drop_location,
    h.pickWindowFrom || ' - ' || h.pickWindowTo AS pick_window,
    h.pickTimeArrived AS pick_arrived, h.pickTimeDeparted AS pick_departed,
    {_hours('h.pickTimeArrived', 'h.pickTimeDeparted', 'h.pa', 'h.pd')} AS pick_load_hours,
    CASE WHEN h.pickupDelayCode <> '' THEN h.pickupDelayCode ELSE first_pick_code END AS pick_delay_code,
    h.dropWindowFrom || ' - ' || h.dropWindowTo AS drop_window,
    h.dropTimeArrived AS drop_arrived, h.dropTimeDeparted AS drop_departed,
    {_hours('h.dropTimeArrived', 'h.dropTimeDeparted', 'h.da', 'h.dd')} AS drop_load_hours,
    CASE WHEN h.deliveryDelayCode <> '' THEN h.deliveryDelayCode ELSE last_drop_code END AS drop_delay_code,
    {_status('h.pickTimeArrived', 'h.pa', 'h.pt', 'No Pickup Data')} AS otp_status,
    {_status('h.dropTimeArrived', 'h.da', 'h.dt', 'No Delivery Data')} AS otd_status,
    h.pf AS pick_from_ts
  FROM ({headers(first, last)}) AS h LEFT JOIN ({LEG_CODES_SQL}) AS codes USING (orderCode)
  WHERE h.clientName = '{CLIENT}'
"""


def detail(x: Tables, first: str = FIRST, last: str = LAST):
    return C.client_detail(x.typed, CLIENT, first, last)


def status(x: Tables, first: str = FIRST, last: str = LAST):
    return C.client_status(x.typed, CLIENT, first, last)


case(
    "o06_client_detail",
    "order_code s, leg_id s, shipment_type s, pick_location s, drop_location s, pick_window s, pick_arrived s,"
    "pick_departed s, pick_load_hours d, pick_delay_code s, drop_window s, drop_arrived s, drop_departed s,"
    "drop_load_hours d, drop_delay_code s, otp_status s, otd_status s, pick_from_ts t",
    detail_sql(),
)(detail)

_KPI_COUNTS = """
    count(*) AS shipments,
    count(*) FILTER (WHERE otp_status = 'On Time') AS otp_on_time, count(*) FILTER (WHERE otp_status = 'Late') AS otp_late,
    count(*) FILTER (WHERE otd_status = 'On Time') AS otd_on_time, count(*) FILTER (WHERE otd_status = 'Late') AS otd_late
"""
case(
    "o07_client_detail_kpis",
    "shipments i, otp_on_time i, otp_late i, otd_on_time i, otd_late i, otp_rate d, otd_rate d",
    f"""SELECT *, {printed('otp_on_time', 'otp_on_time + otp_late')} AS otp_rate,
        {printed('otd_on_time', 'otd_on_time + otd_late')} AS otd_rate
        FROM (SELECT {_KPI_COUNTS} FROM ({detail_sql()}))""",
)(lambda x: C.client_detail_kpis(status(x)))


def trend_sql(grain: str, first: str, last: str) -> str:
    return f"""
  SELECT period, strftime(period, '%b %d, %Y') AS period_label,
    otp_on_time::DOUBLE / nullif(otp_on_time + otp_late, 0)::DOUBLE * 100 AS otp_rate,
    otd_on_time::DOUBLE / nullif(otd_on_time + otd_late, 0)::DOUBLE * 100 AS otd_rate, shipments
  FROM (SELECT date_trunc('{grain}', pick_from_ts)::DATE AS period, {_KPI_COUNTS}
        FROM ({detail_sql(first, last)}) GROUP BY 1)
  WHERE otp_on_time + otp_late > 0 AND otd_on_time + otd_late > 0
"""


TREND_COLUMNS = "period day, period_label s, otp_rate d, otd_rate d, shipments i"
for _name, _grain, _last in (
    ("o08_otp_otd_trend_month", "month", LAST),
    ("o08_otp_otd_trend_week", "week", MID_LAST),
    ("o08_otp_otd_trend_day", "day", SHORT_LAST),
):
    case(_name, TREND_COLUMNS, trend_sql(_grain, FIRST, _last))(
        lambda x, last=_last: C.otp_otd_trend(status(x, FIRST, last), FIRST, last)
    )

for _name, _grain, _last in (
    ("o09_trend_status", "month", LAST),
    ("o09_trend_status_short", "day", "1997-01-02"),
):
    case(
        _name,
        "shipments i, periods i, status s",
        f"""SELECT *, CASE WHEN shipments = 0 THEN 'empty' WHEN shipments < 10 THEN 'few_shipments'
              WHEN periods < 3 THEN 'few_periods' ELSE 'ok' END AS status
            FROM (SELECT (SELECT count(*) FROM ({detail_sql(FIRST, _last)})) AS shipments,
                         (SELECT count(*) FROM ({trend_sql(_grain, FIRST, _last)})) AS periods)""",
    )(lambda x, last=_last: C.trend_status(status(x, FIRST, last), FIRST, last))

for _side, _kind in (("pick", "otp"), ("drop", "otd")):
    case(
        f"o10_delay_breakdown_{_side}",
        "delay_code s, count i",
        f"""SELECT coalesce({_side}_delay_code, 'No Code') AS delay_code, count(*) AS count
            FROM ({detail_sql()}) WHERE {_kind}_status = 'Late' GROUP BY 1""",
    )(lambda x, side=_side: C.delay_breakdown(detail(x), side))

case(
    "f15_carrier_failure",
    "delay_code s, count i",
    f"""SELECT coalesce(nullif(drop_delay_code, ''), 'Carrier Failure') AS delay_code, count(*) AS count
        FROM ({detail_sql()}) WHERE otd_status = 'Late' GROUP BY 1""",
)(lambda x: C.delay_breakdown(detail(x), "drop", impute_carrier=True))

also("a13_rate_by_period", "o08_otp_otd_trend_month")
