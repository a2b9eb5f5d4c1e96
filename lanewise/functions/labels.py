"""On-time statuses, delay codes and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise import schema as S
from lanewise.functions.predicates import is_present
from lanewise.functions.times import in_time, morning_cutoff

ON_TIME, LATE = "On Time", "Late"
NO_DATA = {"pick": "No Pickup Data", "drop": "No Delivery Data"}


def blank_to(code: Column, fallback: Column) -> Column:
    """First of: the code if not blank, the fallback."""
    return F.coalesce(F.nullif(code, F.lit("")), fallback)


def code_or_none(code: Column) -> Column:
    return blank_to(code, F.lit(S.NO_CODE))


def code_if_late(code: Column, late: Column) -> Column:
    """A late shipment without a reason is put down to the carrier."""
    blank = code.isNull() | (code == "")
    return F.when(late & blank, S.CARRIER_FAILURE).otherwise(code)


def window_status(side: str, inclusive: bool = True) -> Column:
    """No data / On Time / Late against the end of the window.

    An arrival that is there but cannot be compared counts as late.
    """
    return (
        F.when(~is_present(f"{side}TimeArrived"), NO_DATA[side])
        .when(in_time(side, inclusive), ON_TIME)
        .otherwise(LATE)
    )


def morning_status(side: str, hour: int = 9) -> Column:
    """Late only when known to arrive after the morning cut-off."""
    late = F.col(f"{side}_arrived_ts") > morning_cutoff(F.col(f"{side}_from_ts"), hour)
    return F.when(late, LATE).otherwise(ON_TIME)


def rate_band(rate: Column) -> Column:
    return F.when(rate >= 95, "good").when(rate >= 85, "fair").otherwise("poor")
