"""Carrier transit times and deduplicated on-time rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.labels import morning_status
from lanewise.functions.money import count_if, percent
from lanewise.functions.predicates import (
    Day,
    carrier_is,
    is_complete,
    is_done,
    is_platform_customer,
    is_valid_date_text,
    prune_deliveries,
    prune_months,
    ts_between_midnight,
    ts_half_open,
)
from lanewise.functions.times import days_late, elapsed_days, in_time
from lanewise.operators.dedup import first_per_stop
from lanewise.operators.joins import with_route


def carrier_transit(legs: DataFrame, routes: DataFrame, carrier: str, first: Day, last: Day) -> DataFrame:
    """Transit days and morning-rule lateness of one carrier's finished legs.

    The date filter runs before the join, so only matching legs are shuffled.
    """
    mine = prune_months(legs, first, last).where(
        is_valid_date_text("pickWindowFrom")
        & carrier_is(carrier)
        & is_complete()
        & ts_between_midnight("pick_from_ts", first, last)
    )
    needed = mine.select(
        "loadId", "warpId", "pick_from_ts", "drop_from_ts", "pick_arrived_ts", "drop_arrived_ts"
    )
    return with_route(needed, routes).select(
        F.col("loadId").alias("load_id"),
        F.col("warpId").alias("leg_id"),
        F.col("pick_from_ts").alias("scheduled_pick"),
        F.col("pick_arrived_ts").alias("actual_pick"),
        morning_status("pick").alias("otp"),
        days_late(F.col("pick_arrived_ts"), F.col("pick_from_ts")).alias("otp_days_late"),
        F.col("drop_from_ts").alias("scheduled_drop"),
        F.col("drop_arrived_ts").alias("actual_drop"),
        morning_status("drop").alias("otd"),
        days_late(F.col("drop_arrived_ts"), F.col("drop_from_ts")).alias("otd_days_late"),
        elapsed_days(F.col("pick_arrived_ts"), F.col("drop_arrived_ts")).alias("transit_days"),
        F.col("palletCount").alias("pallet_count"),
        F.col("transitCost").try_cast("decimal(18,4)").alias("transit_cost"),
    )


def carrier_transit_kpis(transit: DataFrame) -> DataFrame:
    days = F.col("transit_days")
    return transit.agg(
        F.count(F.lit(1)).alias("loads"),
        F.avg(days).alias("avg_transit_days"),
        F.min(days).alias("min_transit_days"),
        F.max(days).alias("max_transit_days"),
        F.avg("transit_cost").alias("avg_transit_cost"),
    )


def _rates(stops: DataFrame, *by: str, name: str) -> DataFrame:
    totals = stops.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col("on_time")).alias("on_time")
    )
    return totals.withColumn(name, percent(F.col("on_time"), F.col("total")))


def _with_times(legs: DataFrame, side: str) -> DataFrame:
    """Times are tested for NULL only: a blank one stays and is not on time."""
    present = F.col(f"{side}TimeArrived").isNotNull() & F.col(f"{side}WindowTo").isNotNull()
    return legs.where(is_done(side) & present).withColumn("on_time", in_time(side, inclusive=False))


def carrier_otp(legs: DataFrame, carrier: str, first: Day, end: Day) -> DataFrame:
    """A carrier's pickups before the window end, per type, each stop once.

    ``end`` is the first day after the range.
    """
    mine = prune_months(legs, first, end).where(carrier_is(carrier) & ts_half_open("pick_from_ts", first, end))
    stops = first_per_stop(_with_times(mine, "pick"), "pick", ["shipmentType", "on_time"])
    return _rates(stops, "shipmentType", name="otp_pct")


def carrier_otd(legs: DataFrame, carrier: str, first: Day, end: Day) -> DataFrame:
    """A carrier's deliveries before the window end, per type, each stop once; the range is that of the delivery window."""
    mine = prune_deliveries(legs, first, end, "drop_day").where(carrier_is(carrier) & ts_half_open("drop_from_ts", first, end))
    stops = first_per_stop(_with_times(mine, "drop"), "drop", ["shipmentType", "on_time"])
    return _rates(stops, "shipmentType", name="otd_pct")


def site_otd(legs: DataFrame, customer: str | Column) -> DataFrame:
    """Deliveries before the window end at a customer's sites, each stop once."""
    at_site = is_platform_customer(customer, by="site") if isinstance(customer, str) else customer
    stops = first_per_stop(
        _with_times(legs.where(at_site), "drop"), "drop", ["dropLocationName", "shipmentType", "on_time"]
    )
    rates = _rates(stops, "dropLocationName", "shipmentType", name="otd_pct")
    return rates.orderBy(F.desc("total"), "dropLocationName", "shipmentType")
