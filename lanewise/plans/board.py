"""LTL profit and loss by market and quarter, and its linear trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.money import COST, REVENUE, ratio_or_zero, sum0, sum_pos
from lanewise.functions.places import leg_market
from lanewise.functions.predicates import (
    is_complete,
    is_ltl,
    is_main,
    pick_in_year,
    prune_year,
    touches_one_crossdock,
)
from lanewise.functions.times import quarter_label, quarter_number
from lanewise.operators.orders import COMPAT
from lanewise.operators.stats import r_squared, slope

MIN_R2 = 0.5
MIN_QUARTERS = 3


def _market_header(year: int) -> Column:
    """Header rows that start or end at a cross-dock in the year."""
    return is_main() & pick_in_year(year) & touches_one_crossdock()


def ltl_market_quarter_revenue(legs: DataFrame, year: int, patterns: str = "all") -> DataFrame:
    """Shipments, positive revenue and pieces of header rows per market and quarter."""
    return (
        prune_year(legs, year)
        .where(is_ltl() & is_complete() & _market_header(year))
        .withColumns(
            {"market": leg_market(patterns), "quarter": quarter_label(F.col("pickWindowFrom"), year)}
        )
        .where(F.col("market").isNotNull())
        .groupBy("market", "quarter")
        .agg(
            F.count_distinct("warpId").alias("shipments"),
            sum_pos(F.col(REVENUE)).alias("revenue"),
            sum0(F.col("pieces")).alias("pieces"),
        )
    )


def ltl_market_quarter_cost(
    legs: DataFrame, year: int, patterns: str = "all", compat: str = "corrected"
) -> DataFrame:
    """Cost of whole orders, booked to the market and quarter of their header.

    One pass instead of a self-join: legs are reduced per order, market and
    quarter (none for non-header rows), and the order's cost is the total over
    those few rows. ``compat='reference'`` counts it once per header row.
    """
    if compat not in COMPAT:
        raise ValueError(f"compat must be one of {COMPAT}")
    header = F.coalesce(_market_header(year), F.lit(False))
    cells = (
        legs.where(is_ltl() & is_complete() & F.col("orderCode").isNotNull())
        .groupBy(
            "orderCode",
            F.when(header, leg_market(patterns)).alias("market"),
            F.when(header, quarter_label(F.col("pickWindowFrom"), year)).alias("quarter"),
        )
        .agg(F.sum(COST).alias("cell_cost"), F.count(F.lit(1)).alias("rows"))
        .withColumn("order_cost", F.sum("cell_cost").over(Window.partitionBy("orderCode")))
    )
    times = F.col("rows") if compat == "reference" else F.lit(1)
    return (
        cells.where(F.col("market").isNotNull())
        .groupBy("market", "quarter")
        .agg(F.sum(F.col("order_cost") * times).alias("cost"))
    )


def ltl_market_quarter(legs: DataFrame, year: int, patterns: str = "all", compat: str = "corrected") -> DataFrame:
    """Revenue side with the cost beside it; no cost counts as 0."""
    revenue = ltl_market_quarter_revenue(legs, year, patterns)
    cost = ltl_market_quarter_cost(legs, year, patterns, compat)
    return revenue.join(cost, ["market", "quarter"], "left").withColumn("cost", F.coalesce("cost", F.lit(0)))


def _with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumn("profit", F.col("revenue") - F.col("cost")).withColumn(
        "cost_per_piece", ratio_or_zero(F.col("cost"), F.col("pieces"))
    )


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("shipments", "revenue", "cost", "pieces")]


def market_summary(pnl: DataFrame) -> DataFrame:
    """One row per market, highest revenue first."""
    margin = ratio_or_zero(F.col("profit"), F.col("revenue"), 100)
    return (
        _with_ratios(pnl.groupBy("market").agg(*_sums()))
        .withColumn("margin_pct", margin)
        .orderBy(F.desc("revenue"), "market")
    )


def top_markets(summary: DataFrame, n: int = 10) -> DataFrame:
    return summary.orderBy(F.desc("revenue"), "market").limit(n)


def market_kpis(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count(F.lit(1)).alias("markets"),
        F.sum("revenue").alias("total_revenue"),
        F.sum("profit").alias("total_profit"),
    )


def market_quarterly(pnl: DataFrame, market: str) -> DataFrame:
    """One market by quarter in calendar order, an unknown quarter last."""
    number = quarter_number(F.col("label"))
    return (
        _with_ratios(
            pnl.where(F.col("market") == market).groupBy(F.col("quarter").alias("label")).agg(*_sums())
        )
        .withColumn("number", number)
        .orderBy(F.asc_nulls_last("number"))
        .select(
            F.when(F.col("number").isNotNull(), F.col("label")).alias("quarter"),
            *("shipments", "revenue", "cost", "pieces", "profit", "cost_per_piece"),
        )
    )


def market_trends(pnl: DataFrame) -> DataFrame:
    """Slope and fit of profit and cost per piece over the known quarters."""
    quarters = _with_ratios(pnl).withColumn("x", quarter_number(F.col("quarter")).cast("double"))
    x, y_profit, y_cpp = F.col("x"), F.col("profit").cast("double"), F.col("cost_per_piece")
    return (
        quarters.where(F.col("x").isNotNull())
        .groupBy("market")
        .agg(
            F.count(F.lit(1)).alias("quarters"),
            F.sum("revenue").alias("total_revenue"),
            F.sum("profit").alias("total_profit"),
            F.avg(y_cpp).alias("avg_cost_per_piece"),
            slope(y_profit, x).alias("profit_slope"),
            r_squared(y_profit, x).alias("profit_r2"),
            slope(y_cpp, x).alias("cpp_slope"),
            r_squared(y_cpp, x).alias("cpp_r2"),
        )
        .where(F.col("quarters") >= MIN_QUARTERS)
    )


def _consistent(trends: DataFrame, kind: str, direction: Column, min_r2: float, n: int) -> DataFrame:
    score = F.abs(F.col(f"{kind}_slope")) * F.col(f"{kind}_r2")
    return (
        trends.where(direction & (F.col(f"{kind}_r2") >= min_r2))
        .withColumn("consistency_score", score)
        .orderBy(F.desc("consistency_score"), "market")
        .limit(n)
    )


def profit_growers(trends: DataFrame, min_r2: float = MIN_R2, n: int = 10) -> DataFrame:
    return _consistent(trends, "profit", F.col("profit_slope") > 0, min_r2, n)


def cost_reducers(trends: DataFrame, min_r2: float = MIN_R2, n: int = 10) -> DataFrame:
    return _consistent(trends, "cpp", F.col("cpp_slope") < 0, min_r2, n)


def trend_quadrants(trends: DataFrame, min_r2: float = MIN_R2) -> DataFrame:
    """Direction and consistency of each market, for both trends."""

    def quadrant(kind: str) -> Column:
        up = F.when(F.col(f"{kind}_slope") > 0, "up").otherwise("down")
        steady = F.when(F.col(f"{kind}_r2") >= min_r2, "steady").otherwise("unsteady")
        return F.concat_ws(" ", up, steady)

    return trends.select(
        "market",
        "total_revenue",
        "total_profit",
        "avg_cost_per_piece",
        *("profit_slope", "profit_r2", "cpp_slope", "cpp_r2"),
        quadrant("profit").alias("profit_quadrant"),
        quadrant("cpp").alias("cpp_quadrant"),
    )
