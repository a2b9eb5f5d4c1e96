"""Aggregates and ratios. Money stays decimal; division never raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.functions.predicates import crossdock_leg

REVENUE, COST = "revenueAllocationNumber", "costAllocationNumber"


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def sum0(value: Column) -> Column:
    """NULL counts as zero."""
    return F.sum(F.coalesce(value, F.lit(0)))


def sum_if(value: Column, condition: Column) -> Column:
    return F.sum(F.when(condition, F.coalesce(value, F.lit(0))).otherwise(0))


def sum_pos(value: Column) -> Column:
    return sum_if(value, value > 0)


def crossdock_sum(value: Column) -> Column:
    return sum_if(value, crossdock_leg())


def profit(raw: bool = False) -> Column:
    """Revenue minus cost; ``raw`` lets a NULL side make the result NULL."""
    revenue, cost = F.col(REVENUE), F.col(COST)
    if raw:
        return revenue - cost
    return F.coalesce(revenue, F.lit(0)) - F.coalesce(cost, F.lit(0))


# ---- ratios -------------------------------------------------------------------------
# Reports round in three ways, and ties show the difference: SQL ROUND works on
# decimals, a printed ``.1f`` on the exact binary value, a rounded table column
# on ten times the value.
def percent(numerator: Column, denominator: Column, places: int = 1) -> Column:
    """Decimal percentage as SQL ROUND has it, NULL without a denominator."""
    scaled = F.try_divide(
        numerator.cast("decimal(22,4)") * F.lit(100).cast("decimal(3,0)"),
        denominator.cast("decimal(22,4)"),
    )
    return F.round(scaled, places)


def _double_percent(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double")) * 100


def printed_tenths(value: Column) -> Column:
    """A double as ``.1f`` prints it: nearest tenth of the exact binary value.

    With j the tenths below, 20·value - (2j + 1) tells the side of the midpoint.
    Added up as 16·value - (2j + 1) + 4·value no step of it is rounded.
    """
    size = F.abs(value)
    below = F.floor(size * 10).cast("double")
    side = (size * 16 - (below * 2 + 1)) + size * 4
    up = (side > 0) | ((side == 0) & (below % 2 == 1))
    return F.signum(value) * F.when(up, below + 1).otherwise(below) / 10


def printed_percent(numerator: Column, denominator: Column) -> Column:
    """One decimal as printed, NULL without a denominator."""
    return printed_tenths(_double_percent(numerator, denominator))


def table_percent(numerator: Column, denominator: Column) -> Column:
    """One decimal as in a rounded table column, 0 without a denominator."""
    return F.coalesce(F.rint(_double_percent(numerator, denominator) * 10) / 10, F.lit(0.0))


def ratio_or_zero(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """Double ratio for statistics; 0 unless the denominator is positive."""
    quotient = numerator.cast("double") / F.when(denominator > 0, denominator.cast("double"))
    return F.coalesce(quotient * F.lit(float(scale)) if scale != 1.0 else quotient, F.lit(0.0))


def weighted_average(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))
