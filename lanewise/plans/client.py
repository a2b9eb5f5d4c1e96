"""Client on-time reports. Every input is the typed leg table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.labels import LATE, ON_TIME, blank_to, code_if_late, code_or_none, rate_band, window_status
from lanewise.functions.money import count_if, printed_percent
from lanewise.functions.places import window_label
from lanewise.functions.predicates import (
    Day,
    client_is,
    has_order,
    is_complete,
    is_main,
    is_present,
    not_crossdock_leg,
    pick_day_between,
    prune_months,
)
from lanewise.functions.times import dwell_hours, grain_for, in_time, period_label, period_start
from lanewise.operators.ahead import may_hold
from lanewise.operators.dedup import inherited_codes
from lanewise.operators.stats import value_counts

MIN_SHIPMENTS, MIN_PERIODS = 10, 3


def client_headers(legs: DataFrame, first: Day, last: Day) -> DataFrame:
    """Finished customer-facing transport rows picked up in the window."""
    return prune_months(legs, first, last).where(
        is_complete() & pick_day_between(first, last) & has_order() & not_crossdock_leg() & is_main()
    )


def _rate_or_zero(kind: str) -> Column:
    return F.coalesce(printed_percent(F.col(f"{kind}_on_time"), F.col(f"{kind}_total")), F.lit(0.0))


def client_otp_otd_summary(legs: DataFrame, first: Day, last: Day) -> DataFrame:
    """On-time pickups and deliveries per client; one shuffle on the client."""

    def counts(side: str, name: str) -> list[Column]:
        arrived = is_present(f"{side}TimeArrived")
        return [
            count_if(arrived & in_time(side, inclusive=True)).alias(f"{name}_on_time"),
            count_if(arrived).alias(f"{name}_total"),
        ]

    return (
        client_headers(legs, first, last)
        .where(F.col("clientName").isNotNull())
        .groupBy(F.col("clientName").alias("client"))
        .agg(F.count(F.lit(1)).alias("shipments"), *counts("pick", "otp"), *counts("drop", "otd"))
        .withColumns(
            {
                "otp_rate": _rate_or_zero("otp"),
                "otd_rate": _rate_or_zero("otd"),
            }
        )
    )


def rank_clients(summary: DataFrame, mode: str = "worst", n: int = 20, names: Sequence[str] = ()) -> DataFrame:
    """Worst or best ``n`` by delivery rate, or a chosen list, worst first."""
    if mode == "selected":
        chosen = F.col("client").isin(*names) if names else F.lit(False)
        return summary.where(chosen).orderBy("otd_rate", "client")
    if mode not in ("worst", "best"):
        raise ValueError("mode must be 'worst', 'best' or 'selected'")
    rate = F.asc("otd_rate") if mode == "worst" else F.desc("otd_rate")
    return summary.orderBy(rate, F.asc("client")).limit(n)


def with_bands(summary: DataFrame) -> DataFrame:
    return summary.withColumns({"otp_band": rate_band(F.col("otp_rate")), "otd_band": rate_band(F.col("otd_rate"))})


def client_kpis(shown: DataFrame) -> DataFrame:
    """One row over the clients shown; a rate without data is NULL."""
    totals = shown.agg(
        F.count(F.lit(1)).alias("clients"),
        *(
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in ("shipments", "otp_on_time", "otp_total", "otd_on_time", "otd_total")
        ),
    )
    return totals.select(
        "clients",
        "shipments",
        printed_percent(F.col("otp_on_time"), F.col("otp_total")).alias("otp_rate"),
        printed_percent(F.col("otd_on_time"), F.col("otd_total")).alias("otd_rate"),
    )


def client_detail(legs: DataFrame, client: str, first: Day, last: Day) -> DataFrame:
    """Every header row of a client with windows, dwell hours, codes and statuses.

    A blank code is taken over from the order's earliest pickup or latest
    delivery leg. Legs of other orders leave at the scan; the codes of the rest
    are aggregated per order before the join, so no leg is shuffled row by row
    and an order that the filter let pass by mistake meets no header.
    """
    headers = client_headers(legs, first, last).where(client_is(client))
    codes = inherited_codes(legs.where(may_hold(headers, "orderCode")))
    rows = headers.join(codes, "orderCode", "left")
    return rows.select(
        F.col("orderCode").alias("order_code"),
        F.col("warpId").alias("leg_id"),
        F.col("shipmentType").alias("shipment_type"),
        F.col("pickLocationName").alias("pick_location"),
        F.col("dropLocationName").alias("drop_location"),
        window_label("pick").alias("pick_window"),
        F.col("pickTimeArrived").alias("pick_arrived"),
        F.col("pickTimeDeparted").alias("pick_departed"),
        dwell_hours("pick").alias("pick_load_hours"),
        blank_to(F.col("pickupDelayCode"), F.col("first_pick_code")).alias("pick_delay_code"),
        window_label("drop").alias("drop_window"),
        F.col("dropTimeArrived").alias("drop_arrived"),
        F.col("dropTimeDeparted").alias("drop_departed"),
        dwell_hours("drop").alias("drop_load_hours"),
        blank_to(F.col("deliveryDelayCode"), F.col("last_drop_code")).alias("drop_delay_code"),
        window_status("pick").alias("otp_status"),
        window_status("drop").alias("otd_status"),
        F.col("pick_from_ts"),
    )


def client_status(legs: DataFrame, client: str, first: Day, last: Day) -> DataFrame:
    """Pickup time and statuses of the same rows, for figures that need no codes: one scan, no join."""
    headers = client_headers(legs, first, last).where(client_is(client))
    return headers.select(
        "pick_from_ts", window_status("pick").alias("otp_status"), window_status("drop").alias("otd_status")
    )


def _status_counts(kind: str) -> list[Column]:
    status = F.col(f"{kind}_status")
    return [count_if(status == ON_TIME).alias(f"{kind}_on_time"), count_if(status == LATE).alias(f"{kind}_late")]


def client_detail_kpis(detail: DataFrame) -> DataFrame:
    """Shipments and rates over those with arrival data, of ``client_status`` or ``client_detail`` rows."""
    totals = detail.agg(F.count(F.lit(1)).alias("shipments"), *_status_counts("otp"), *_status_counts("otd"))
    return totals.withColumns(
        {
            f"{kind}_rate": printed_percent(F.col(f"{kind}_on_time"), F.col(f"{kind}_on_time") + F.col(f"{kind}_late"))
            for kind in ("otp", "otd")
        }
    )


def _by_period(detail: DataFrame, first: Day, last: Day, grain: str | None) -> DataFrame:
    """Shipments and rates of every period; a rate without data is NULL. Takes the rows of ``client_status``."""

    def rate(kind: str) -> Column:
        on_time, late = F.col(f"{kind}_on_time").cast("double"), F.col(f"{kind}_late").cast("double")
        return F.try_divide(on_time, on_time + late) * 100

    period = period_start(F.col("pick_from_ts"), grain or grain_for(first, last))
    return (
        detail.groupBy(period.alias("period"))
        .agg(F.count(F.lit(1)).alias("shipments"), *_status_counts("otp"), *_status_counts("otd"))
        .select(
            "period",
            period_label(F.col("period")).alias("period_label"),
            rate("otp").alias("otp_rate"),
            rate("otd").alias("otd_rate"),
            "shipments",
        )
    )


def _measured() -> Column:
    return F.col("otp_rate").isNotNull() & F.col("otd_rate").isNotNull()


def otp_otd_trend(detail: DataFrame, first: Day, last: Day, grain: str | None = None) -> DataFrame:
    """Rates per period; periods without any measurable shipment are left out."""
    return _by_period(detail, first, last, grain).where(_measured()).orderBy("period")


def trend_status(detail: DataFrame, first: Day, last: Day, grain: str | None = None) -> DataFrame:
    """Whether the trend rests on enough shipments and periods."""
    status = (
        F.when(F.col("shipments") == 0, "empty")
        .when(F.col("shipments") < MIN_SHIPMENTS, "few_shipments")
        .when(F.col("periods") < MIN_PERIODS, "few_periods")
        .otherwise("ok")
    )
    return (
        _by_period(detail, first, last, grain)
        .agg(F.coalesce(F.sum("shipments"), F.lit(0)).alias("shipments"), count_if(_measured()).alias("periods"))
        .withColumn("status", status)
    )


def delay_breakdown(detail: DataFrame, side: str, impute_carrier: bool = False) -> DataFrame:
    """Reasons of the late rows, most frequent first.

    A missing reason reads "No Code", or is put down to the carrier.
    """
    kind = {"pick": "otp", "drop": "otd"}[side]
    late = F.col(f"{kind}_status") == LATE
    code = F.col(f"{side}_delay_code")
    label = code_if_late(code, late) if impute_carrier else code_or_none(code)
    return value_counts(detail.where(late), label, "delay_code")
