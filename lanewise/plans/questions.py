"""Standing questions: one customer, last month, last week, one rep, one target."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise import schema as S
from lanewise.functions.money import COST, REVENUE, count_if, percent
from lanewise.functions.places import lane_label
from lanewise.functions.predicates import (
    Day,
    as_date,
    client_is,
    has_lane,
    in_last_month,
    in_last_week,
    is_complete,
    is_main,
    is_present,
    last_month_days,
    last_week_days,
    prune_deliveries,
    ts_half_open,
)
from lanewise.functions.times import day_of, in_time
from lanewise.sources.staging import coerce_numeric


def customer_otd_by_lane_equipment(legs: DataFrame, client: str, as_of: Day) -> DataFrame:
    """Last week's deliveries of a customer before the window end."""
    rows = prune_deliveries(legs, *last_week_days(as_of), "drop_day").where(
        client_is(client)
        & is_main()
        & is_complete()
        & F.col("dropTimeArrived").isNotNull()
        & F.col("dropWindowTo").isNotNull()
        & in_last_week("drop_from_ts", as_of)
    )
    return (
        rows.groupBy("startMarket", "endMarket", "equipment", "shipmentType")
        .agg(
            F.count(F.lit(1)).alias("total_deliveries"),
            count_if(in_time("drop", inclusive=False)).alias("on_time"),
        )
        .select(
            lane_label().alias("lane"),
            F.col("startMarket").alias("start_market"),
            F.col("endMarket").alias("end_market"),
            "equipment",
            F.col("shipmentType").alias("shipment_type"),
            "total_deliveries",
            "on_time",
            percent(F.col("on_time"), F.col("total_deliveries")).alias("otd_pct"),
        )
        .orderBy(F.desc("total_deliveries"), "start_market", "end_market", "equipment", "shipment_type")
    )


def _order_money(revenue: Column, cost: Column, order: Column) -> list[Column]:
    """A row counts towards profit only when both of its sides are there."""
    return [
        F.count_distinct(order).alias("order_count"),
        F.sum(revenue).alias("total_revenue"),
        F.sum(cost).alias("total_cost"),
        F.sum(revenue - cost).alias("total_profit"),
    ]


def _margin() -> Column:
    return percent(F.col("total_profit"), F.col("total_revenue")).alias("margin_pct")


def customer_profit_orders(orders: DataFrame, customer: str, as_of: Day) -> DataFrame:
    """Last month's profit of a customer per type, from the order table."""
    rows = orders.where(
        (F.col("customerName") == customer)
        & (F.col("status") == S.COMPLETE)
        & in_last_month("created_on", as_of)
    )
    return rows.groupBy(F.col("shipmentType").alias("shipment_type")).agg(
        *_order_money(F.col("revenue"), F.col("cost"), F.col("code"))
    )


def customer_profit_legs(legs: DataFrame, client: str, as_of: Day) -> DataFrame:
    """The same from header legs; LTL headers may repeat their legs' revenue."""
    recent = prune_deliveries(legs, *last_month_days(as_of), "drop_day")
    rows = recent.where(client_is(client) & is_main() & is_complete() & in_last_month("drop_from_ts", as_of))
    return (
        rows.groupBy(F.col("shipmentType").alias("shipment_type"))
        .agg(*_order_money(F.col(REVENUE), F.col(COST), F.col("orderCode")))
        .withColumn("margin_pct", _margin())
    )


def _lanes_last_month(legs: DataFrame, as_of: Day) -> DataFrame:
    recent = prune_deliveries(legs, *last_month_days(as_of), "drop_day")
    return recent.where(is_main() & has_lane() & in_last_month("drop_from_ts", as_of))


def lane_profit_orders(orders: DataFrame, legs: DataFrame, as_of: Day, n: int = 20) -> DataFrame:
    """Last month's best lanes with order-table money.

    Header legs are first counted per order and lane; an order's money enters a
    lane once per header row, as joining the rows one by one would have it.
    """
    headers = (
        _lanes_last_month(legs, as_of)
        .groupBy(F.col("orderCode").alias("code"), "startMarket", "endMarket")
        .agg(F.count(F.lit(1)).alias("headers"))
    )
    finished = orders.where(F.col("status") == S.COMPLETE).select("code", "shipmentType", "revenue", "cost")
    revenue, cost = F.col("revenue") * F.col("headers"), F.col("cost") * F.col("headers")
    return (
        finished.join(headers, "code")
        .groupBy("startMarket", "endMarket", F.col("shipmentType").alias("shipment_type"))
        .agg(*_order_money(revenue, cost, F.col("code")))
        .select(
            lane_label().alias("lane"),
            "shipment_type",
            *("order_count", "total_revenue", "total_cost", "total_profit"),
        )
        .orderBy(F.desc("total_profit"), "lane", "shipment_type")
        .limit(n)
    )


def lane_profit_legs(legs: DataFrame, as_of: Day, n: int = 20) -> DataFrame:
    """Last month's best lanes from header legs alone."""
    return (
        _lanes_last_month(legs, as_of)
        .where(is_complete())
        .groupBy("startMarket", "endMarket", F.col("shipmentType").alias("shipment_type"))
        .agg(*_order_money(F.col(REVENUE), F.col(COST), F.col("orderCode")))
        .select(
            lane_label().alias("lane"),
            "shipment_type",
            *("order_count", "total_revenue", "total_cost", "total_profit"),
            _margin(),
        )
        .orderBy(F.desc("total_profit"), "lane", "shipment_type")
        .limit(n)
    )


def booked_by_rep(legs: DataFrame, rep: str, day: Day) -> DataFrame:
    """Shipment rows a sales rep booked on one day, per type."""
    on_day = ts_half_open("booked_ts", day, as_date(day) + timedelta(days=1))
    rows = legs.where((F.col("carrierSaleRep") == rep) & is_present("loadBookedTime") & on_day)
    return (
        rows.groupBy(
            F.col("carrierSaleRep").alias("rep"),
            day_of(F.col("booked_ts")).alias("booked_date"),
            F.col("shipmentType").alias("shipment_type"),
        )
        .agg(F.count(F.lit(1)).alias("shipment_count"))
        .orderBy("shipment_type")
    )


def vs_target(df: DataFrame, rates: Mapping[str, str], targets: Mapping[str, float] = S.TARGETS) -> DataFrame:
    """Gap to target of rate columns; ``rates`` maps a target name to its column."""
    added = {}
    for name, column in rates.items():
        gap = F.col(column).cast("decimal(10,4)") - F.lit(str(targets[name])).cast("decimal(10,4)")
        added[f"{name}_gap"] = gap
        added[f"{name}_met"] = gap >= 0
    return df.withColumns(added)


def accessorials(orders: DataFrame, charges: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sum and number of orders of each charge column."""
    money = coerce_numeric(orders.select(*by, *charges), charges, "decimal(18,2)", fill=None)
    long = money.unpivot(list(by), list(charges), "charge", "amount")
    return long.groupBy(*by, "charge").agg(
        F.sum("amount").alias("total"), count_if(F.col("amount") != 0).alias("orders")
    )
