"""Profit by lane and within markets, and the rows behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise import schema as S
from lanewise.functions.money import COST, REVENUE, printed_percent, profit, table_percent
from lanewise.functions.places import crossdock_label, lane_ends, lane_label
from lanewise.functions.predicates import (
    Day,
    client_is,
    has_lane,
    in_customers,
    in_lanes,
    is_complete,
    not_crossdock_leg,
    prune_deliveries,
    same_market,
    ts_between_midnight,
)
from lanewise.operators.orders import financial_totals, select_financial_rows


def delivered_between(legs: DataFrame, first: Day, last: Day) -> DataFrame:
    """Finished legs by effective delivery time, up to the last day's midnight."""
    return prune_deliveries(legs, first, last).where(is_complete() & ts_between_midnight("delivered_ts", first, last))


def _with_profit(totals: DataFrame) -> DataFrame:
    return totals.withColumn("total_profit", F.col("revenue") - F.col("cost"))


def profit_by_lane(
    legs: DataFrame,
    first: Day,
    last: Day,
    shipment_type: str = S.ALL_TYPES,
    customers: Sequence[str] | None = None,
    lanes: Sequence[str] | None = None,
    compat: str = "corrected",
    level: str = "market",
) -> DataFrame:
    """Orders, money and cross-dock share per lane, most profitable first.

    ``level`` takes lanes between markets, cities or street addresses (the last
    two without rows where an end is unknown; addresses are further text columns
    of the leg table).
    """
    rows = delivered_between(legs, first, last).where(in_customers(customers))
    if level == "market":
        rows, ends, names = rows.where(has_lane() & in_lanes(lanes)), ("startMarket", "endMarket"), ("start_market", "end_market")
    else:
        ends = names = (f"start_{level}", f"end_{level}")
        start, end = lane_ends(level)
        rows = rows.withColumns({ends[0]: start, ends[1]: end}).where(start.isNotNull() & end.isNotNull())
        rows = rows.where(lane_label(level).isin(*lanes)) if lanes else rows
    totals = _with_profit(financial_totals(rows, list(ends), shipment_type, compat))
    return totals.select(
        F.concat(F.col(ends[0]), F.lit(" → "), F.col(ends[1])).alias("lane"),
        F.col(ends[0]).alias(names[0]),
        F.col(ends[1]).alias(names[1]),
        "order_count",
        F.col("revenue").alias("total_revenue"),
        F.col("cost").alias("total_cost"),
        "total_profit",
        F.col("xd_cost").alias("crossdock_cost"),
        table_percent(F.col("xd_cost"), F.col("cost")).alias("crossdock_cost_pct"),
        table_percent(F.col("total_profit"), F.col("revenue")).alias("margin_pct"),
    ).orderBy(F.desc("total_profit"), "lane")


def _crossdock_share() -> Column:
    share = printed_percent(F.col("crossdock_cost"), F.col("total_cost"))
    return F.when(F.col("total_cost") > 0, share).otherwise(0.0)


def lane_kpis(lanes: DataFrame) -> DataFrame:
    totals = lanes.agg(*(F.sum(c).alias(c) for c in ("total_revenue", "total_cost", "total_profit", "crossdock_cost")))
    return totals.withColumn("crossdock_cost_pct", _crossdock_share())


def drill_down(
    legs: DataFrame,
    first: Day,
    last: Day,
    by: str,
    value: str,
    lane: str | None = None,
    shipment_type: str = S.ALL_TYPES,
    compat: str = "corrected",
    limit: int | None = None,
) -> DataFrame:
    """The selected rows of one customer or lane, in order; the first ``limit`` if a caller asks for it."""
    if by not in ("customer", "lane"):
        raise ValueError("by must be 'customer' or 'lane'")
    chosen = client_is(value) if by == "customer" else lane_label() == value
    rows = delivered_between(legs, first, last).where(chosen)
    if lane is not None:
        rows = rows.where(lane_label() == lane)
    needed = [
        "orderCode", "warpId", "mainShipment", "startMarket", "endMarket", "clientName", "carrierName",
        "pickLocationName", "dropLocationName", REVENUE, COST, "shipmentType", "pickWindowFrom",
    ]
    selected = select_financial_rows(rows.select(*needed), shipment_type, compat, needed)
    ordered = selected.orderBy(F.asc("orderCode"), F.desc("mainShipment"), F.asc("warpId"))
    return (ordered if limit is None else ordered.limit(limit)).select(
        F.col("orderCode").alias("order_code"),
        F.col("warpId").alias("leg_id"),
        F.col("mainShipment").alias("main_shipment"),
        lane_label().alias("lane"),
        F.col("clientName").alias("client"),
        F.col("carrierName").alias("carrier"),
        F.col("pickLocationName").alias("pick_location"),
        F.col("dropLocationName").alias("drop_location"),
        F.coalesce(REVENUE, F.lit(0)).alias("revenue"),
        F.coalesce(COST, F.lit(0)).alias("cost"),
        profit().alias("profit"),
        crossdock_label().alias("crossdock"),
        F.col("shipmentType").alias("shipment_type"),
        F.col("pickWindowFrom").alias("pick_window_from"),
    )


def drill_down_kpis(rows: DataFrame) -> DataFrame:
    """Totals of the rows given."""
    handling: Column = F.when(F.col("crossdock") == "Yes", F.col("cost")).otherwise(0)
    totals = rows.agg(
        F.count_distinct("order_code").alias("orders"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("revenue").alias("total_revenue"),
        F.sum("cost").alias("total_cost"),
        F.sum("profit").alias("total_profit"),
        F.sum(handling).alias("crossdock_cost"),
    )
    return totals.withColumn("crossdock_cost_pct", _crossdock_share())


def profit_within_market(
    legs: DataFrame,
    first: Day,
    last: Day,
    shipment_type: str = S.ALL_TYPES,
    crossdock: bool = True,
    customers: Sequence[str] | None = None,
    compat: str = "corrected",
) -> DataFrame:
    """Legs that start and end in one market, least profitable market first.

    ``crossdock=False`` leaves out handling legs (and unnamed places) from the
    sums; what makes an order single-row is still judged with them.
    """
    rows = delivered_between(legs, first, last).where(same_market() & in_customers(customers))
    counted = None if crossdock else not_crossdock_leg(strict=True)
    totals = _with_profit(financial_totals(rows, ["startMarket"], shipment_type, compat, counted))
    return totals.select(
        F.col("startMarket").alias("market"),
        "order_count",
        F.col("revenue").alias("total_revenue"),
        F.col("cost").alias("total_cost"),
        "total_profit",
        F.col("xd_cost").alias("crossdock_cost"),
        F.col("xd_revenue").alias("crossdock_revenue"),
        F.coalesce(printed_percent(F.col("total_profit"), F.col("revenue")), F.lit(0.0)).alias("margin_pct"),
    ).orderBy(F.asc("total_profit"), "market")


def within_market_kpis(markets: DataFrame) -> DataFrame:
    """The order total adds up per-market counts, so one order can count twice."""
    return markets.agg(
        F.sum("total_revenue").alias("total_revenue"),
        F.sum("total_cost").alias("total_cost"),
        F.sum("total_profit").alias("total_profit"),
        F.sum("order_count").alias("total_orders"),
    )
