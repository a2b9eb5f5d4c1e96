"""Text-time parsing, durations, periods and lateness."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise import schema as S
from lanewise.functions.predicates import Day, as_date, crossdock_leg, is_present


# ---- parsing: unparsable text becomes NULL, also under ANSI ------------------
def parse_timestamp(text: Column) -> Column:
    """Month/day/year and time, with or without leading zeros.

    Rewritten to ISO order and cast, which needs no session time zone. Text of
    any other form is dropped before the cast, or ISO text would pass.
    """
    iso = F.regexp_replace(text, S.TIMESTAMP_TEXT, "$3-$1-$2 $4")
    return F.nullif(iso, text).try_cast("timestamp_ntz")


def parse_date(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, S.DATE_TEXT, "$3-$1-$2"), text).try_cast("date")


def parse_iso_date(text: Column) -> Column:
    return F.try_to_date(text, S.ISO_DATE_TEXT)


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def effective_delivery() -> Column:
    """When a leg counts as delivered, over staged legs.

    Cross-dock handling goes by its window, other legs by the actual time, then
    the actual date, then the window. The first rule that applies decides even
    when its text does not parse.
    """
    return (
        F.when(crossdock_leg(), F.col("drop_from_ts"))
        .when(is_present("dropTimeArrived"), F.col("drop_arrived_ts"))
        .when(is_present("dropDateArrived"), F.col("drop_date").cast("timestamp_ntz"))
        .otherwise(F.col("drop_from_ts"))
    )


# ---- durations ---------------------------------------------------------------
def dwell_hours(side: str) -> Column:
    """Hours between arrival and departure from whole minutes, 2 decimals."""
    both = is_present(f"{side}TimeArrived") & is_present(f"{side}TimeDeparted")
    minutes = F.timestamp_diff("MINUTE", F.col(f"{side}_arrived_ts"), F.col(f"{side}_departed_ts"))
    return F.when(both, F.round(minutes.cast("decimal(20,0)") / F.lit(60).cast("decimal(3,0)"), 2))


def elapsed_days(start: Column, end: Column) -> Column:
    """Days as a fraction, 2 decimals as in a rounded table column."""
    seconds = F.timestamp_diff("SECOND", start, end).cast("double")
    return F.rint(seconds / 86400 * 100) / 100


def days_late(actual: Column, scheduled: Column) -> Column:
    """Whole calendar days, never negative, NULL when either is missing."""
    days = F.datediff(actual, scheduled)
    return F.when(days < 0, F.lit(0)).otherwise(days)


def morning_cutoff(ts: Column, hour: int = 9) -> Column:
    """``hour`` o'clock on the day of ``ts``."""
    return F.date_trunc("day", ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hour))


# ---- periods -------------------------------------------------------------------
def grain_for(first: Day, last: Day) -> str:
    """Day up to 14 days of span, week up to 90, month beyond."""
    span = (as_date(last) - as_date(first)).days
    return "day" if span <= 14 else "week" if span <= 90 else "month"


def period_number(start: Column, grain: str) -> Column:
    """Periods since a fixed one, from a period's first day: neighbours differ by 1."""
    if grain == "month":
        return F.year(start) * 12 + F.month(start)
    days = F.unix_date(start.cast("date"))
    if grain == "week":
        return F.floor((days + 3) / 7).cast("int")  # day 0 was a Thursday
    if grain == "day":
        return days
    raise ValueError(f"unknown grain {grain}")


def period_start(ts: Column, grain: str) -> Column:
    return F.date_trunc(grain, ts).cast("date")


def period_label(period: Column) -> Column:
    return F.date_format(period, "MMM dd, yyyy")


def week_start(ts: Column) -> Column:
    """Monday of the ISO week; safe across years, unlike a bare week number."""
    return period_start(ts, "week")


def quarter_label(text: Column, year: int) -> Column:
    """Quarter from the text month; anything not zero-padded is Unknown."""
    def months_of(quarter: int) -> Column:
        patterns = [f"{3 * quarter + m:02d}/%/{year}%" for m in (1, 2, 3)]
        return reduce(or_, (text.like(p) for p in patterns))

    known = (F.when(months_of(q), f"Q{q + 1}") for q in range(4))
    return F.coalesce(*known, F.lit("Unknown"))


def quarter_number(label: Column) -> Column:
    """1 to 4; NULL for anything else."""
    return F.when(label.rlike("^Q[1-4]$"), F.substring(label, 2, 1).cast("int"))


# ---- lateness --------------------------------------------------------------------
def in_time(side: str, inclusive: bool) -> Column:
    """Arrived by the end of the window; unknown when either time is unusable."""
    arrived, window_end = F.col(f"{side}_arrived_ts"), F.col(f"{side}_to_ts")
    return arrived <= window_end if inclusive else arrived < window_end


def lateness(
    side: str,
    rule: str = "window_end",
    *,
    hour: int = 9,
    hours_after_start: float = 0,
    grace_minutes: int = 0,
) -> Column:
    """True when late under the chosen rule, unknown when times are missing.

    ``window_end``   at or after the end of the window
    ``hour``         after ``hour`` o'clock on the scheduled day
    ``after_start``  more than ``hours_after_start`` past the window start
    ``grace``        more than ``grace_minutes`` past the window end
    """
    arrived = F.col(f"{side}_arrived_ts")
    start, end = F.col(f"{side}_from_ts"), F.col(f"{side}_to_ts")

    def plus_seconds(ts: Column, seconds: int) -> Column:
        return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))

    if rule == "window_end":
        return ~in_time(side, inclusive=False)
    if rule == "hour":
        return arrived > morning_cutoff(start, hour)
    if rule == "after_start":
        return arrived > plus_seconds(start, round(hours_after_start * 3600))
    if rule == "grace":
        return arrived > plus_seconds(end, grace_minutes * 60)
    raise ValueError(f"unknown lateness rule {rule!r}")
