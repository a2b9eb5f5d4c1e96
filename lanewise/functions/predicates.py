"""Row predicates (Column -> Column).

Three-valued logic is part of the meaning: a predicate that must keep or drop
NULLs says so in its name or docstring. Time windows compare the typed column
with constants, so on a staged table they reach the Parquet statistics.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise import schema as S

Day = str | dt.date


def as_date(day: Day) -> dt.date:
    return day if isinstance(day, dt.date) else dt.date.fromisoformat(day)


def midnight(day: Day) -> Column:
    """The first instant of a day as a zone-less timestamp constant."""
    return F.lit(f"{as_date(day).isoformat()} 00:00:00").cast("timestamp_ntz")


# ---- status and presence ----------------------------------------------------
def is_complete() -> Column:
    return F.col("shipmentStatus") == S.COMPLETE


def is_done(side: str = "pick") -> Column:
    """Whole shipment complete, or this end of the leg succeeded."""
    return is_complete() | (F.col(f"{side}Status") == S.SUCCEEDED)


def is_present(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def is_valid_date_text(name: str) -> Column:
    return F.col(name).isNotNull() & ~F.col(name).isin("", S.INVALID_DATE)


def has_order() -> Column:
    return is_present("orderCode")


def has_lane() -> Column:
    return is_present("startMarket") & is_present("endMarket")


def same_market() -> Column:
    return is_present("startMarket") & (F.col("startMarket") == F.col("endMarket"))


# ---- row role ---------------------------------------------------------------
def is_main() -> Column:
    return F.col("mainShipment") == S.HEADER


def is_leg() -> Column:
    return F.col("mainShipment") == S.LEG


def is_type(name: str) -> Column:
    return F.col("shipmentType") == name


def is_ftl() -> Column:
    return is_type(S.FTL)


def is_ltl() -> Column:
    return is_type(S.LTL)


def is_parcel() -> Column:
    return is_type(S.PARCEL)


def is_other() -> Column:
    """Neither truckload kind; a NULL type stays unknown and so drops out."""
    return ~F.col("shipmentType").isin(S.FTL, S.LTL)


def carrier_is(name: str) -> Column:
    return F.col("carrierName") == name


def client_is(name: str) -> Column:
    return F.col("clientName") == name


# ---- cross-docks ------------------------------------------------------------
def crossdock_leg() -> Column:
    """Picked and dropped at the same place; unknown when a name is missing."""
    return F.col("pickLocationName") == F.col("dropLocationName")


def not_crossdock_leg(strict: bool = False) -> Column:
    """``strict`` drops rows with a missing place name, the default keeps them."""
    differs = F.col("pickLocationName") != F.col("dropLocationName")
    if strict:
        return differs
    return F.col("pickLocationName").isNull() | F.col("dropLocationName").isNull() | differs


def is_crossdock_location(name: str) -> Column:
    return reduce(or_, (F.col(name).like(pattern) for pattern in S.CROSSDOCK_NAMES))


def touches_one_crossdock() -> Column:
    """Exactly one end is a cross-dock; the other may be unnamed."""
    pick, drop = is_crossdock_location("pickLocationName"), is_crossdock_location("dropLocationName")
    outbound = pick & (~drop | F.col("dropLocationName").isNull())
    inbound = drop & (~pick | F.col("pickLocationName").isNull())
    return outbound | inbound


def is_xdock_to_xdock() -> Column:
    return crossdock_leg() & F.col("pickLocationName").contains("WTCH-")


# ---- lists ------------------------------------------------------------------
def _in_list(value: Column, wanted: Sequence[str] | None) -> Column:
    return value.isin(*wanted) if wanted else F.lit(True)


def in_customers(names: Sequence[str] | None) -> Column:
    """An empty list means no restriction."""
    return _in_list(F.col("clientName"), names)


def in_lanes(labels: Sequence[str] | None) -> Column:
    return _in_list(F.concat(F.col("startMarket"), F.lit(" → "), F.col("endMarket")), labels)


def is_platform_customer(name: str, by: str = "client") -> Column:
    """One customer seen as the paying client or as the delivery place.
    (For a table of its legs use ``keep_listed``.)

    Delivery places are matched in two spellings: as given, and with only the
    first letter in upper case.
    """
    if by == "client":
        return client_is(name)
    if by == "site":
        place = F.col("dropLocationName")
        return place.contains(name) | place.contains(name.capitalize())
    raise ValueError("by must be 'client' or 'site'")


# ---- time windows -----------------------------------------------------------
def pick_day_between(first: Day, last: Day) -> Column:
    """Calendar days, both included."""
    after = as_date(last) + dt.timedelta(days=1)
    return ts_half_open("pick_from_ts", first, after)


def ts_between_midnight(name: str, first: Day, last: Day) -> Column:
    """Up to the *midnight* that starts the last day, that instant included."""
    return (F.col(name) >= midnight(first)) & (F.col(name) <= midnight(last))


def ts_half_open(name: str, first: Day, end: Day) -> Column:
    return (F.col(name) >= midnight(first)) & (F.col(name) < midnight(end))


def pick_in_year(year: int) -> Column:
    """Matches the text, so dates without leading zeros count as well."""
    return F.col("pickWindowFrom").like(f"%/{year}%")


def in_last_week(name: str, as_of: Day) -> Column:
    """The Monday-to-Sunday week before the one holding ``as_of``."""
    day = as_date(as_of)
    monday = day - dt.timedelta(days=day.weekday())
    return ts_half_open(name, monday - dt.timedelta(days=7), monday)


def in_last_month(name: str, as_of: Day) -> Column:
    this_month = as_date(as_of).replace(day=1)
    last_month = (this_month - dt.timedelta(days=1)).replace(day=1)
    return ts_half_open(name, last_month, this_month)


def _days(legs: DataFrame, column: str, first: Day, last: Day) -> DataFrame:
    """Days of a staged column, both included, for the statistics of its files."""
    low, high = (F.lit(as_date(day).isoformat()).cast("date") for day in (first, last))
    return legs.where(F.col(column).between(low, high)) if column in legs.columns else legs


def prune_months(legs: DataFrame, first: Day, last: Day) -> DataFrame:
    """Partition and day filter for staged legs; a frame without the columns passes as is."""
    if "pick_month" not in legs.columns:
        return legs
    months = (as_date(first).replace(day=1).isoformat(), as_date(last).replace(day=1).isoformat())
    inside = legs.where(F.col("pick_month").between(*(F.lit(m).cast("date") for m in months)))
    return _days(inside, "pick_day", first, last)


def prune_deliveries(legs: DataFrame, first: Day, last: Day, day: str = "delivered_day") -> DataFrame:
    """Partition and day filter for staged legs delivered from ``first`` to ``last``.

    ``day`` is ``delivered_day`` (when it counts as delivered) or ``drop_day``
    (start of the delivery window). Both lie between the two delivery months of
    their partition. A frame without those columns passes as is.
    """
    if "first_drop_month" not in legs.columns:
        return legs
    low, high = (F.lit(as_date(d).replace(day=1).isoformat()).cast("date") for d in (first, last))
    inside = legs.where((F.col("first_drop_month") <= high) & (F.col("last_drop_month") >= low))
    return _days(inside, day, first, last)


def last_week_days(as_of: Day) -> tuple[dt.date, dt.date]:
    """Monday and Sunday of the week before the one holding ``as_of``."""
    day = as_date(as_of)
    monday = day - dt.timedelta(days=day.weekday())
    return monday - dt.timedelta(days=7), monday - dt.timedelta(days=1)


def last_month_days(as_of: Day) -> tuple[dt.date, dt.date]:
    """First and last day of the month before the one holding ``as_of``."""
    last = as_date(as_of).replace(day=1) - dt.timedelta(days=1)
    return last.replace(day=1), last


def prune_year(legs: DataFrame, year: int) -> DataFrame:
    """Partition filter beside ``pick_in_year``: the year's months, and pickup texts that no time could be read from."""
    if "pick_month" not in legs.columns:
        return legs
    months = (F.lit(f"{year}-{m}-01").cast("date") for m in ("01", "12"))
    return legs.where(F.col("pick_month").isNull() | F.col("pick_month").between(*months))
