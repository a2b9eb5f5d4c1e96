"""Sanity checks: flags and counts, never filters on the data itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise import schema as S
from lanewise.functions.money import COST, REVENUE, count_if, percent
from lanewise.functions.predicates import is_present
from lanewise.operators.joins import reconcile_orders
from lanewise.operators.orders import order_row_counts

# fixed values: expected ranges
MARGIN_LIMIT, MARGIN_TYPICAL = 100, 50
REVENUE_RANGE = (50, 10_000)
ROW_LIMITS = {S.LTL: 20, S.FTL: 10}
RATE_LIMIT = 50
CRITICAL_COLUMNS = ("pickTimeArrived", "dropTimeArrived", REVENUE)


def check_margin(df: DataFrame, revenue: str, profit: str) -> DataFrame:
    """Margin per row with flags for outside ±100 % and ±50 %."""
    margin = percent(F.col(profit), F.col(revenue))
    outside = lambda limit: F.coalesce(F.abs(F.col("margin_pct")) > limit, F.lit(False))
    return df.withColumn("margin_pct", margin).withColumns(
        {"margin_extreme": outside(MARGIN_LIMIT), "margin_unusual": outside(MARGIN_TYPICAL)}
    )


def check_revenue(df: DataFrame, revenue: str = REVENUE) -> DataFrame:
    low, high = REVENUE_RANGE
    unusual = ~F.col(revenue).between(low, high)
    return df.withColumn("revenue_unusual", F.coalesce(unusual, F.lit(False)))


def zero_cost_share(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    zero = count_if(F.coalesce(F.col(COST), F.lit(0)) == 0)
    return (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("rows"), zero.alias("zero_cost_rows"))
        .withColumn("zero_cost_pct", percent(F.col("zero_cost_rows"), F.col("rows")))
    )


def crowded_orders(legs: DataFrame, limits: dict[str, int] = ROW_LIMITS) -> DataFrame:
    """Orders with more rows than their type usually has."""
    counts = order_row_counts(legs.where(is_present("orderCode")), by_type=True)
    too_many = [
        (F.col("shipmentType") == kind) & (F.col("total_rows") > limit) for kind, limit in limits.items()
    ]
    condition = too_many[0]
    for other in too_many[1:]:
        condition = condition | other
    return counts.where(condition)


def low_rates(summary: DataFrame, limit: int = RATE_LIMIT) -> DataFrame:
    """Clients of the on-time summary below ``limit`` per cent, where measured."""
    low = lambda kind: (F.col(f"{kind}_total") > 0) & (F.col(f"{kind}_rate") < limit)
    return summary.withColumns({"otp_low": low("otp"), "otd_low": low("otd")}).where("otp_low or otd_low")


def completeness(df: DataFrame, columns: Sequence[str] = CRITICAL_COLUMNS, by: Sequence[str] = ()) -> DataFrame:
    """Rows and missing values per column."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *(count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns),
    )


def time_coverage(legs: DataFrame) -> DataFrame:
    """How many rows of each role have actual times."""
    has_pick, has_drop = is_present("pickTimeArrived"), is_present("dropTimeArrived")
    counts = legs.groupBy("mainShipment").agg(
        F.count(F.lit(1)).alias("total"),
        count_if(has_pick).alias("has_pick_time"),
        count_if(has_drop).alias("has_drop_time"),
    )
    return counts.withColumns(
        {
            "pick_pct": percent(F.col("has_pick_time"), F.col("total")),
            "drop_pct": percent(F.col("has_drop_time"), F.col("total")),
        }
    )


def with_mismatch(compared: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Reconciled orders with a flag where money differs by more than ``tolerance`` or is missing."""
    limit = F.lit(str(tolerance)).cast("decimal(10,4)")
    off = (F.abs("revenue_diff") > limit) | (F.abs("cost_diff") > limit)
    return compared.withColumn("mismatch", F.coalesce(off, F.lit(True)))


def cross_validate(orders: DataFrame, legs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Orders whose money and legs disagree by more than ``tolerance``."""
    return with_mismatch(reconcile_orders(orders, legs), tolerance)
