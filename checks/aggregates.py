"""Aggregates, statistics, windows over periods, quality checks and option lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import CLIENT, FIRST, LAST, Tables, also, case
from checks.client import RATED_SQL, SUMMARY_COLUMNS, summary
from checks.lanes import rows_sql
from checks.sql import pct
from lanewise.functions import money as M
from lanewise.functions import predicates as P
from lanewise.functions.predicates import crossdock_leg, is_main, is_present
from lanewise.functions.times import in_time
from lanewise.operators import quality as K
from lanewise.operators import stats as ST
from lanewise.operators.orders import select_financial_rows
from lanewise.plans.client import client_detail
from lanewise.sources import choices, reports, tables
from lanewise.sources.staging import coerce_numeric


def rev():
    return F.col(M.REVENUE)


def cost():
    return F.col(M.COST)


case(
    "a02_count_if",
    "carrierName s, on_time i, measured i",
    """SELECT carrierName, count(*) FILTER (WHERE pickTimeArrived <> '' AND pa <= pt) AS on_time,
         count(*) FILTER (WHERE pickTimeArrived <> '') AS measured FROM t GROUP BY 1""",
)(
    lambda x: x.typed.groupBy("carrierName").agg(
        M.count_if(is_present("pickTimeArrived") & in_time("pick", True)).alias("on_time"),
        M.count_if(is_present("pickTimeArrived")).alias("measured"),
    )
)
case(
    "a03_count_distinct",
    "carrierName s, orders i, legs i, revenue d",
    """SELECT carrierName, count(DISTINCT orderCode) AS orders, count(*) AS legs, sum(rev) AS revenue FROM t GROUP BY 1""",
)(
    lambda x: x.typed.groupBy("carrierName").agg(
        F.count_distinct("orderCode").alias("orders"), F.count(F.lit(1)).alias("legs"), F.sum(rev()).alias("revenue")
    )
)
for _name, _sql, _sum in (
    ("a04_sum0", "sum(coalesce(cost, 0))", lambda: M.sum0(cost())),
    ("a05_sum_if_cost", "sum(if(pickLocationName = dropLocationName, coalesce(cost, 0), 0))", lambda: M.crossdock_sum(cost())),
    ("a05_sum_if_revenue", "sum(if(pickLocationName = dropLocationName, coalesce(rev, 0), 0))",
     lambda: M.sum_if(rev(), crossdock_leg())),
    ("a06_sum_pos", "sum(greatest(coalesce(rev, 0), 0))", lambda: M.sum_pos(rev())),
):
    case(_name, "startMarket s, total d", f"SELECT startMarket, {_sql} AS total FROM t GROUP BY 1")(
        lambda x, total=_sum: x.typed.groupBy("startMarket").agg(total().alias("total"))
    )
case(
    "a08_filter_after_aggregate",
    "clientName s, rows i",
    "SELECT clientName, count(*) AS rows FROM t GROUP BY 1 HAVING count(*) > 50",
)(lambda x: ST.distribution(x.typed, "clientName").withColumnRenamed("count", "rows").where("rows > 50"))
case(
    "a09_ratio_of_sums",
    "shipmentType s, on_time_pct d",
    f"""SELECT shipmentType, {pct('on_time', 'n')} AS on_time_pct
        FROM (SELECT shipmentType, count(*) AS n, count(*) FILTER (WHERE pa < pt) AS on_time FROM t GROUP BY 1)""",
)(
    lambda x: x.typed.groupBy("shipmentType")
    .agg(F.count(F.lit(1)).alias("n"), M.count_if(in_time("pick", False)).alias("on_time"))
    .select("shipmentType", M.percent(F.col("on_time"), F.col("n")).alias("on_time_pct"))
)
case(
    "a10_margin_pct",
    "clientName s, margin_pct d",
    f"""SELECT clientName, {pct('profit', 'revenue')} AS margin_pct
        FROM (SELECT clientName, sum(rev - cost) AS profit, sum(rev) AS revenue FROM t GROUP BY 1)""",
)(
    lambda x: x.typed.groupBy("clientName")
    .agg(F.sum(M.profit(raw=True)).alias("profit"), F.sum(rev()).alias("revenue"))
    .select("clientName", M.percent(F.col("profit"), F.col("revenue")).alias("margin_pct"))
)
case(
    "a12_value_counts",
    "value s, count i",
    "SELECT coalesce(nullif(deliveryDelayCode, ''), 'No Code') AS value, count(*) AS count FROM t GROUP BY 1",
)(lambda x: ST.value_counts(x.typed, F.coalesce(F.nullif("deliveryDelayCode", F.lit("")), F.lit("No Code"))))

# ---- statistics --------------------------------------------------------------------
case(
    "a14_linear_regression",
    "carrierName s, slope r, r2 r",
    """SELECT carrierName, regr_slope(rev::DOUBLE, pieces) AS slope,
         coalesce(covar_pop(rev::DOUBLE, pieces) ** 2 / nullif(var_pop(pieces) * var_pop(rev::DOUBLE), 0), 0) AS r2
       FROM t WHERE rev IS NOT NULL GROUP BY 1""",
)(
    lambda x: x.typed.groupBy("carrierName").agg(
        ST.slope(rev().cast("double"), F.col("pieces")).alias("slope"),
        ST.r_squared(rev().cast("double"), F.col("pieces")).alias("r2"),
    )
)
case(
    "a15_mean_of_ratios",
    "carrierName s, mean_cost_per_piece r",
    """SELECT carrierName, avg(if(p > 0, c / p, 0)) AS mean_cost_per_piece FROM (
         SELECT carrierName, shipmentType, sum(cost)::DOUBLE AS c, sum(pieces)::DOUBLE AS p FROM t GROUP BY 1, 2) GROUP BY 1""",
)(
    lambda x: x.typed.groupBy("carrierName", "shipmentType")
    .agg(F.sum(cost()).alias("c"), F.sum("pieces").alias("p"))
    .groupBy("carrierName")
    .agg(F.avg(M.ratio_or_zero(F.col("c"), F.col("p"))).alias("mean_cost_per_piece"))
)


def _stats(value: str, group: str = "") -> str:
    lead = f"{group}, " if group else ""
    tail = f"GROUP BY {group}" if group else ""
    return f"""
  SELECT {lead}count({value}) AS n, avg({value}) AS mean, stddev_samp({value}) AS std, var_samp({value}) AS variance,
    sum({value} * pieces) / sum(pieces) FILTER (WHERE {value} IS NOT NULL) AS weighted_mean,
    quantile_cont({value}, 0.1) AS p10, quantile_cont({value}, 0.5) AS p50, quantile_cont({value}, 0.9) AS p90
  FROM (SELECT *, (rev - cost)::DOUBLE AS profit FROM t WHERE mainShipment = 'YES') {tail}
"""


_STATS_COLUMNS = "n i, mean r, std r, variance r, weighted_mean r, p10 r, p50 r, p90 r"
_A16 = "n i, mean r, std r, p10 r, p50 r, p90 r"
case("a16_metric_stats", "clientName s, " + _A16, _stats("profit", "clientName"))(
    lambda x: ST.metric_stats(x.typed.where(is_main()), M.profit(raw=True), ["clientName"], width=100.0)
)
case("o36_metric_stats_overall", _A16, _stats("profit"))(
    lambda x: ST.metric_stats(x.typed.where(is_main()), M.profit(raw=True), width=500.0)
)
case("a17_weighted_average", "equipment s, weighted_mean r", _stats("profit", "equipment"))(
    lambda x: ST.metric_stats(
        x.typed.where(is_main()), M.profit(raw=True), ["equipment"], weight=F.col("pieces"), quantiles=False
    )
)
case(
    "a18_metric_corr",
    "shipmentType s, correlation r",
    """SELECT shipmentType, corr(rev::DOUBLE, cost::DOUBLE) AS correlation FROM t
       WHERE rev IS NOT NULL AND cost IS NOT NULL GROUP BY 1""",
)(lambda x: ST.metric_corr(x.typed, rev(), cost(), ["shipmentType"]))


def monthly(x: Tables):
    return ST.by_period(
        x.typed, "pick_from_ts", "month", ["shipmentType"], profit=F.sum(M.profit()), legs=F.count(F.lit(1))
    )


_MONTHLY = """SELECT shipmentType, date_trunc('month', pf)::DATE AS period, count(*) AS legs,
    sum(coalesce(rev, 0) - coalesce(cost, 0)) AS profit FROM t WHERE pf IS NOT NULL GROUP BY ALL"""
case(
    "w06_rolling_avg",
    "shipmentType s, period day, profit d, profit_avg_3 r",
    f"""SELECT *, avg(profit::DOUBLE) OVER (PARTITION BY shipmentType ORDER BY period
          RANGE BETWEEN INTERVAL 2 MONTH PRECEDING AND CURRENT ROW) AS profit_avg_3
        FROM ({_MONTHLY})""",
)(lambda x: ST.rolling_avg(monthly(x), "profit", 3, "period", ["shipmentType"], "month"))
case(
    "w07_period_change",
    "shipmentType s, period day, legs i, legs_before i, legs_change i, legs_change_pct r",
    f"""SELECT *, legs - legs_before AS legs_change,
          (legs - legs_before)::DOUBLE * 100 / nullif(abs(legs_before::DOUBLE), 0) AS legs_change_pct
        FROM (SELECT *, max(legs) OVER (PARTITION BY shipmentType ORDER BY period
          RANGE BETWEEN INTERVAL 1 MONTH PRECEDING AND INTERVAL 1 MONTH PRECEDING) AS legs_before FROM ({_MONTHLY}))""",
)(lambda x: ST.period_change(monthly(x), "legs", "period", ["shipmentType"], "month"))

# ---- distributions and quality ---------------------------------------------------------
case(
    "a19_completeness",
    "shipmentType s, total i, missing_pickTimeArrived i, missing_dropTimeArrived i, missing_revenueAllocationNumber i",
    """SELECT shipmentType, count(*) AS total, count(*) - count(pickTimeArrived) AS missing_pickTimeArrived,
         count(*) - count(dropTimeArrived) AS missing_dropTimeArrived,
         count(*) - count(rev) AS missing_revenueAllocationNumber FROM t GROUP BY 1""",
)(lambda x: K.completeness(x.typed, by=["shipmentType"]))
case(
    "a20_time_coverage",
    "mainShipment s, total i, has_pick_time i, has_drop_time i, pick_pct d, drop_pct d",
    f"""SELECT *, {pct('has_pick_time', 'total')} AS pick_pct, {pct('has_drop_time', 'total')} AS drop_pct FROM (
          SELECT mainShipment, count(*) AS total, count(nullif(pickTimeArrived, '')) AS has_pick_time,
            count(nullif(dropTimeArrived, '')) AS has_drop_time FROM t GROUP BY 1)""",
)(lambda x: K.time_coverage(x.typed))
for _column in ("shipmentType", "equipment", "mainShipment"):
    case(
        f"a21_distribution_{_column.lower()}",
        f"{_column} s, count i",
        f"SELECT {_column}, count(*) AS count FROM t GROUP BY 1",
    )(lambda x, c=_column: ST.distribution(x.typed, c))
case(
    "k01_check_margin",
    "orderCode s, margin_pct d, margin_extreme b, margin_unusual b",
    f"""SELECT orderCode, margin_pct, coalesce(abs(margin_pct) > 100, false) AS margin_extreme,
          coalesce(abs(margin_pct) > 50, false) AS margin_unusual
        FROM (SELECT orderCode, {pct('profit', 'revenue')} AS margin_pct FROM (
          SELECT orderCode, sum(coalesce(rev, 0)) AS revenue, sum(coalesce(rev, 0) - coalesce(cost, 0)) AS profit
          FROM t GROUP BY 1))""",
)(
    lambda x: K.check_margin(
        x.typed.groupBy("orderCode").agg(M.sum0(rev()).alias("revenue"), F.sum(M.profit()).alias("profit")),
        "revenue",
        "profit",
    )
)
case(
    "k02_check_revenue",
    "revenue_unusual b, rows i",
    "SELECT coalesce(rev < 50 OR rev > 10000, false) AS revenue_unusual, count(*) AS rows FROM t GROUP BY 1",
)(lambda x: K.check_revenue(x.typed).groupBy("revenue_unusual").agg(F.count(F.lit(1)).alias("rows")))
case(
    "k03_zero_cost_share",
    "shipmentType s, rows i, zero_cost_rows i, zero_cost_pct d",
    f"""SELECT *, {pct('zero_cost_rows', 'rows')} AS zero_cost_pct FROM (
          SELECT shipmentType, count(*) AS rows, count(*) FILTER (WHERE coalesce(cost, 0) = 0) AS zero_cost_rows
          FROM t GROUP BY 1)""",
)(lambda x: K.zero_cost_share(x.typed, ["shipmentType"]))
case(
    "k04_crowded_orders",
    "orderCode s, shipmentType s, total_rows i",
    """SELECT orderCode, shipmentType, count(*) AS total_rows FROM t WHERE orderCode <> '' GROUP BY ALL
       HAVING (shipmentType = 'Less Than Truckload' AND count(*) > 8) OR (shipmentType = 'Full Truckload' AND count(*) > 5)""",
)(lambda x: K.crowded_orders(x.typed, {"Less Than Truckload": 8, "Full Truckload": 5}))
case(
    "k05_low_rates",
    SUMMARY_COLUMNS + ", otp_low b, otd_low b",
    f"""SELECT * FROM (SELECT *, otp_total > 0 AND otp_rate < 50 AS otp_low, otd_total > 0 AND otd_rate < 50 AS otd_low
        FROM ({RATED_SQL})) WHERE otp_low OR otd_low""",
)(lambda x: K.low_rates(summary(x)))
case(
    "k07_cross_validate",
    "code s, revenue_diff d, cost_diff d, mismatch b",
    """SELECT code, legs_revenue - o.revenue AS revenue_diff, legs_cost - o.cost AS cost_diff,
         coalesce(abs(legs_revenue - o.revenue) > 0.01 OR abs(legs_cost - o.cost) > 0.01, true) AS mismatch
       FROM orders_fin AS o JOIN (SELECT orderCode, sum(coalesce(rev, 0)) AS legs_revenue, sum(coalesce(cost, 0)) AS legs_cost
                                  FROM t GROUP BY 1) ON orderCode = code""",
)(lambda x: K.cross_validate(x.orders, x.typed))

# ---- sources and option lists ------------------------------------------------------------
_ALL = (
    "orderCode s, warpId s, loadId s, shipmentType s, mainShipment s, shipmentStatus s, pickStatus s, dropStatus s,"
    "clientName s, carrierName s, carrierSaleRep s, startMarket s, endMarket s, pickLocationName s, dropLocationName s,"
    "pickCity s, pickState s, dropCity s, dropState s, pickWindowFrom s, pickWindowTo s, pickTimeArrived s,"
    "pickTimeDeparted s, dropWindowFrom s, dropWindowTo s, dropTimeArrived s, dropTimeDeparted s, dropDateArrived s,"
    "loadBookedTime s, pickupDelayCode s, deliveryDelayCode s, equipment s, revenueAllocationNumber d,"
    "costAllocationNumber d, pieces i"
)
case("s01_legs", _ALL, "SELECT * FROM legs")(lambda x: tables.load_legs(x.spark, f"{x.files}/legs"))
case("s02_routes", "routeId s, palletCount i, transitCost s", "SELECT * FROM routes")(
    lambda x: tables.load_routes(x.spark, f"{x.files}/routes")
)
case(
    "s03_orders",
    "code s, customerName s, shipmentType s, status s, revenue d, cost d, created_on day",
    "SELECT * FROM orders_fin",
)(lambda x: tables.load_orders(x.spark, f"{x.files}/orders", "csv"))
case(
    "s04_name_dimensions",
    "kind s, id s, name s",
    """SELECT 'carrier' AS kind, s_suppkey::VARCHAR AS id, s_name AS name FROM supplier
       UNION ALL SELECT 'client', c_custkey::VARCHAR, c_name FROM customer""",
)(
    lambda x: tables.load_dimension(x.spark, "carriers", f"{x.files}/carriers", "csv")
    .withColumn("kind", F.lit("carrier"))
    .unionByName(tables.load_dimension(x.spark, "clients", f"{x.files}/clients", "csv").withColumn("kind", F.lit("client")))
)
case(
    "s05_parameterised_query",
    "client s, legs i",
    f"SELECT clientName AS client, count(*) AS legs FROM t WHERE clientName = '{CLIENT}' AND year(pf) = 1997 GROUP BY 1",
)(
    lambda x: x.spark.sql(
        "SELECT clientName AS client, count(*) AS legs FROM {legs} WHERE clientName = :client "
        "AND pick_from_ts BETWEEN :first AND :last GROUP BY 1",
        args={"client": CLIENT, "first": FIRST + " 00:00:00", "last": LAST + " 23:59:59"},
        legs=x.typed,
    )
)
case(
    "s06_normalized_legs",
    "warpId s, pick_from_ts t, pick_to_ts t, pick_arrived_ts t, pick_departed_ts t, drop_from_ts t, drop_to_ts t,"
    "drop_arrived_ts t, drop_departed_ts t, booked_ts t, drop_date day, delivered_ts t, pick_month day",
    """SELECT warpId, pf AS pick_from_ts, pt AS pick_to_ts, pa AS pick_arrived_ts, pd AS pick_departed_ts, df AS drop_from_ts,
         dt AS drop_to_ts, da AS drop_arrived_ts, dd AS drop_departed_ts, bk AS booked_ts,
         try_strptime(dropDateArrived, '%m/%d/%Y') AS drop_date, delivered AS delivered_ts,
         date_trunc('month', pf) AS pick_month FROM t""",
)(lambda x: x.typed)
case(
    "s07_coerce_numeric",
    "routeId s, transitCost d",
    "SELECT routeId, coalesce(try_cast(transitCost AS DECIMAL(18,2)), 0) AS transitCost FROM routes",
)(lambda x: coerce_numeric(x.routes, ["transitCost"], "decimal(18,2)"))
def exported(x: Tables):
    """The client report written as CSV under its headings and read from there."""
    path = x.folder("export")
    reports.write_report(reports.with_headings(client_detail(x.typed, CLIENT, FIRST, LAST), "client_detail"), path)
    shown = x.spark.read.option("header", True).csv(path)
    return shown.select(F.col("Order Code").alias("order_code"), F.col("Warp ID").alias("leg_id"), F.col("OTP Status").alias("otp_status"))


case(
    "s08_export_rows",
    "order_code s, leg_id s, otp_status s",
    f"""SELECT orderCode AS order_code, warpId AS leg_id,
          CASE WHEN coalesce(pickTimeArrived, '') = '' THEN 'No Pickup Data' WHEN pa <= pt THEN 'On Time' ELSE 'Late' END
            AS otp_status
        FROM t WHERE clientName = '{CLIENT}' AND shipmentStatus = 'Complete' AND mainShipment = 'YES' AND year(pf) = 1997
          AND (pickLocationName = dropLocationName) IS NOT TRUE AND orderCode <> ''""",
)(exported)
case(
    "s10_distinct_clients",
    "clientName s",
    "SELECT DISTINCT clientName FROM legs WHERE clientName IS NOT NULL",
)(lambda x: choices.distinct_clients(x.typed))
case(
    "s10_distinct_customers",
    "clientName s",
    "SELECT DISTINCT clientName FROM legs WHERE clientName <> '' ORDER BY clientName",
)(lambda x: choices.distinct_customers(x.typed))
_LANES = "SELECT DISTINCT startMarket || ' → ' || endMarket AS lane FROM legs WHERE startMarket <> '' AND endMarket <> ''"
case("s10_distinct_lanes", "lane s", f"{_LANES} ORDER BY lane")(lambda x: choices.distinct_lanes(x.typed))
case("u01_lanes_of_customer", "lane s", f"{_LANES} AND clientName = '{CLIENT}' ORDER BY lane")(
    lambda x: choices.distinct_lanes(x.typed, CLIENT)
)
case(
    "u02_union_of_type_rules",
    "shipmentType s, rows i, revenue d",
    f"""SELECT shipmentType, count(*) AS rows, sum(rev) AS revenue
        FROM ({rows_sql("shipmentStatus = 'Complete'", "All")}) GROUP BY 1""",
)(
    lambda x: select_financial_rows(
        x.typed.where(P.is_complete()), columns=["orderCode", "warpId", "shipmentType", M.REVENUE]
    )
    .groupBy("shipmentType")
    .agg(F.count(F.lit(1)).alias("rows"), F.sum(rev()).alias("revenue"))
)

# ---- queries that stand for two inventory items -----------------------------------------
also("k06_completeness", "a19_completeness")
also("o36_rolling_avg", "w06_rolling_avg")
also("o36_period_change", "w07_period_change")
also("o36_metric_corr", "a18_metric_corr")
