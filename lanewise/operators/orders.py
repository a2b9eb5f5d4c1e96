"""Order-shape rules: which rows of an order count, and what they add up to.

All per-order sums are partial aggregates, so an order with very many rows is
reduced before the shuffle. Where a rule needs a total over the whole order, it
is taken over rows already grouped by a small domain (lane, market, type), never
over the raw legs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise import schema as S
from lanewise.functions.money import COST, REVENUE, count_if, percent, sum0
from lanewise.functions.places import leg_market
from lanewise.functions.predicates import (
    crossdock_leg,
    has_order,
    is_complete,
    is_done,
    is_ftl,
    is_leg,
    is_ltl,
    is_main,
    is_other,
    is_parcel,
    is_present,
    is_xdock_to_xdock,
    touches_one_crossdock,
)
from lanewise.operators.dedup import first_per_stop
from lanewise.operators.skew import attach

COMPAT = ("corrected", "reference")


def _check_compat(compat: str) -> None:
    if compat not in COMPAT:
        raise ValueError(f"compat must be one of {COMPAT}")


# ---- order shape --------------------------------------------------------------
def order_row_counts(legs: DataFrame, by_type: bool = False) -> DataFrame:
    """Rows, header rows and leg rows per order (and type)."""
    keys = ["orderCode", "shipmentType"] if by_type else ["orderCode"]
    return legs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_rows"),
        count_if(is_main()).alias("yes_count"),
        count_if(is_leg()).alias("no_count"),
    )


def classify_order(legs: DataFrame) -> DataFrame:
    """Direct, multi-leg, multidrop or multistop, per order and truckload type."""
    counts = (
        legs.where(has_order() & (is_ltl() | is_ftl()))
        .groupBy("orderCode", "shipmentType")
        .agg(
            F.count(F.lit(1)).alias("total_rows"),
            count_if(is_main()).alias("yes_count"),
            count_if(is_leg()).alias("no_count"),
            F.count_distinct("loadId").alias("loads"),
        )
    )
    yes, no, loads = F.col("yes_count"), F.col("no_count"), F.col("loads")
    ltl_shape = F.when(F.col("total_rows") == 1, "LTL direct").otherwise("LTL multi-leg")
    ftl_shape = (
        F.when(no > 0, "FTL multistop")
        .when((yes > 1) & (loads <= 1), "FTL multidrop")
        .when(yes > 1, "FTL several loads")
        .otherwise("FTL direct")
    )
    return counts.withColumn("shape", F.when(is_ltl(), ltl_shape).otherwise(ftl_shape))


# ---- financial row selection -------------------------------------------------------
def _chosen_without_counts(shipment_type: str) -> Column:
    """Rows that count whatever else the order holds."""
    ltl_leg = is_ltl() & is_leg()
    return {
        S.FTL: is_ftl(),
        S.LTL: ltl_leg,
        S.PARCEL: is_parcel() & is_main(),
        S.ALL_TYPES: is_ftl() | ltl_leg | (is_other() & is_main()),
    }[shipment_type]


def select_financial_rows(
    legs: DataFrame,
    shipment_type: str = S.ALL_TYPES,
    compat: str = "corrected",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The rows of each order that carry its money, once each.

    FTL: every row. LTL: the only row of an order, or its leg rows. Anything
    else: header rows. Row counts are those of the frame given, so filter first.

    Leg rows always count, so only the other LTL rows need to know whether they
    stand alone. Those are found by one aggregation over LTL rows; the rest of
    the table is not shuffled at all.

    ``compat='reference'`` repeats rows of orders that mix types, once per
    matching type group of the order.
    """
    _check_compat(compat)
    names = list(columns or legs.columns)
    if shipment_type in (S.FTL, S.PARCEL):
        return legs.where(_chosen_without_counts(shipment_type)).select(*names)
    if shipment_type == S.ALL_TYPES and compat == "reference":
        return _rows_with_repeats(legs, names)

    with_order = legs.where(F.col("orderCode").isNotNull())
    chosen = with_order.where(_chosen_without_counts(shipment_type)).select(*names)
    alone = (
        with_order.where(is_ltl())
        .groupBy("orderCode")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(F.when(is_leg(), F.lit(None)).otherwise(F.struct(*names))).alias("row"),
        )
        .where((F.col("rows") == 1) & F.col("row").isNotNull())
        .select("row.*")
    )
    return chosen.unionByName(alone)


def _type_groups(legs: DataFrame) -> DataFrame:
    """Per order: number of type groups, and how many hold one row or more."""
    return (
        order_row_counts(legs.where(F.col("orderCode").isNotNull()), by_type=True)
        .groupBy("orderCode")
        .agg(
            F.count(F.lit(1)).alias("groups"),
            count_if(F.col("total_rows") == 1).alias("single"),
            count_if(F.col("total_rows") > 1).alias("several"),
        )
    )


def _times_out(single: Column, several: Column, groups: Column) -> Column:
    """How often a row comes out when type groups are matched by order alone."""
    ltl_times = single + F.when(is_leg(), several).otherwise(0)
    return (
        F.when(is_ftl(), groups)
        .when(is_ltl(), ltl_times)
        .when(is_other() & is_main(), groups)
        .otherwise(0)
    )


def _rows_with_repeats(legs: DataFrame, names: list[str]) -> DataFrame:
    times = _times_out(F.col("single"), F.col("several"), F.col("groups"))
    matched = attach(legs.where(F.col("orderCode").isNotNull()), _type_groups(legs), "orderCode", "inner")
    return (
        matched.withColumn("_times", times.cast("int"))
        .where("_times > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        .select(*names)
    )


def financial_totals(
    legs: DataFrame,
    by: Sequence[str],
    shipment_type: str = S.ALL_TYPES,
    compat: str = "corrected",
    counted: Column | None = None,
) -> DataFrame:
    """Orders and money of the selected rows per ``by`` group (lane or market).

    Same rules as ``select_financial_rows`` without building the rows: legs are
    first reduced to one row per order, type and group, then the order's row
    total is added up over those few rows. ``counted`` restricts what is summed
    but not what makes an order single-row.
    """
    _check_compat(compat)
    counted = F.lit(True) if counted is None else counted
    by = list(by)
    revenue, cost = F.coalesce(REVENUE, F.lit(0)), F.coalesce(COST, F.lit(0))
    measures = {
        "rows": F.lit(1).cast("bigint"),
        "revenue": revenue,
        "cost": cost,
        "xd_cost": F.when(crossdock_leg(), cost).otherwise(0),
        "xd_revenue": F.when(crossdock_leg(), revenue).otherwise(0),
    }

    if shipment_type in (S.FTL, S.PARCEL):
        rows = legs.where(_chosen_without_counts(shipment_type) & counted)
        sums = [F.sum(value).alias(name) for name, value in measures.items() if name != "rows"]
        return rows.groupBy(*by).agg(F.count_distinct("orderCode").alias("order_count"), *sums)

    rows = legs.where(F.col("orderCode").isNotNull())
    if shipment_type == S.LTL:
        rows = rows.where(is_ltl())
    # Each row is either chosen outright, or an LTL row that counts only when it
    # stands alone, or neither.
    chosen = _chosen_without_counts(shipment_type)
    if_alone = is_ltl() & ~F.coalesce(is_leg(), F.lit(False))
    cells = rows.groupBy("orderCode", "shipmentType", *by).agg(
        F.count(F.lit(1)).alias("present"),
        *(F.sum(F.when(counted & chosen, value).otherwise(0)).alias(m) for m, value in measures.items()),
        *(F.sum(F.when(counted & if_alone, value).otherwise(0)).alias(f"{m}_alone") for m, value in measures.items()),
    )
    # One shuffle by order serves the windows and the regrouping per order.
    same_type = Window.partitionBy("orderCode", "shipmentType")
    cells = cells.repartition("orderCode").withColumn("type_rows", F.sum("present").over(same_type))
    if compat == "reference" and shipment_type == S.ALL_TYPES:
        # A row meets every type group of its order, a lone one every single-row group.
        order = Window.partitionBy("orderCode")
        opens_group = F.row_number().over(same_type.orderBy(*by)) == 1
        cells = cells.withColumn("opens", opens_group).withColumns(
            {
                "times": F.count_if("opens").over(order),
                "times_alone": F.count_if(F.col("opens") & (F.col("type_rows") == 1)).over(order),
            }
        )
    else:
        cells = cells.withColumns({"times": F.lit(1), "times_alone": F.when(F.col("type_rows") == 1, 1).otherwise(0)})
    selected = {m: F.col(m) * F.col("times") + F.col(f"{m}_alone") * F.col("times_alone") for m in measures}
    per_order = cells.groupBy("orderCode", *by).agg(*(F.sum(value).alias(m) for m, value in selected.items()))
    return (
        per_order.where("rows > 0")
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            *(F.sum(m).alias(m) for m in measures if m != "rows"),
        )
    )


# ---- perspectives and counts -----------------------------------------------------
def perspective(legs: DataFrame, view: str, side: str = "pick", columns: Sequence[str] | None = None) -> DataFrame:
    """Customers see finished header rows; carriers every finished stop, once."""
    names = list(columns or legs.columns)
    if view == "customer":
        return legs.where(is_main() & is_complete()).select(*names)
    if view == "carrier":
        return first_per_stop(legs.where(is_done(side) & F.col(f"{side}TimeArrived").isNotNull()), side, names)
    raise ValueError("view must be 'customer' or 'carrier'")


def carrier_shipment_count(legs: DataFrame, carrier: str | None = None) -> DataFrame:
    """Shipments per carrier and type.

    LTL: leg rows, or the only row of the carrier's order. FTL: stops counted
    once. Only finished rows count (complete, or picked up); orders are judged
    by the carrier's own ones. Carriers without a shipment are left out.
    """
    mine = (legs if carrier is None else legs.where(F.col("carrierName") == carrier)).where(is_done("pick"))
    ltl = (
        mine.where(is_ltl() & F.col("orderCode").isNotNull())
        .groupBy("carrierName", "orderCode", "shipmentType")
        .agg(F.count(F.lit(1)).alias("rows"), count_if(is_leg()).alias("leg_rows"))
        .groupBy("carrierName", "shipmentType")
        .agg(F.sum(F.when(F.col("rows") == 1, 1).otherwise(F.col("leg_rows"))).alias("shipments"))
        .where("shipments > 0")
    )
    ftl = (
        mine.where(is_ftl())
        .select("loadId", "carrierName", "shipmentType", "pickLocationName", F.to_date("pick_arrived_ts").alias("day"))
        .distinct()
        .groupBy("carrierName", "shipmentType")
        .agg(F.count(F.lit(1)).alias("shipments"))
    )
    return ltl.unionByName(ftl)


# ---- money per order --------------------------------------------------------------
def _earning_leg() -> Column:
    """Not handling inside one numbered dock; unknown places count as transport."""
    return ~F.coalesce(is_xdock_to_xdock(), F.lit(False))


def ltl_order_revenue(legs: DataFrame) -> DataFrame:
    """Header revenue when there is any, else the sum over transport legs."""
    money = (
        legs.where(has_order() & is_ltl())
        .groupBy("orderCode")
        .agg(
            F.sum(F.when(is_main(), F.coalesce(REVENUE, F.lit(0))).otherwise(0)).alias("header_revenue"),
            F.sum(
                F.when(is_leg() & _earning_leg(), F.coalesce(REVENUE, F.lit(0))).otherwise(0)
            ).alias("leg_revenue"),
        )
    )
    chosen = F.when(F.col("header_revenue") > 0, F.col("header_revenue")).otherwise(F.col("leg_revenue"))
    return money.withColumn("revenue", chosen)


def ltl_order_pieces(legs: DataFrame) -> DataFrame:
    """Header pieces when there are any, else those of earning transport legs."""
    earning = (F.col(REVENUE) > 0) & _earning_leg()
    pieces = (
        legs.where(has_order() & is_ltl())
        .groupBy("orderCode")
        .agg(
            F.sum(F.when(is_main(), F.coalesce("pieces", F.lit(0))).otherwise(0)).alias("header_pieces"),
            F.sum(F.when(earning, F.coalesce("pieces", F.lit(0))).otherwise(0)).alias("leg_pieces"),
        )
    )
    chosen = F.when(F.col("header_pieces") > 0, F.col("header_pieces")).otherwise(F.col("leg_pieces"))
    return pieces.withColumn("pieces", chosen)


def order_cost(legs: DataFrame) -> DataFrame:
    """Cost is never repeated between rows, so it adds up over all of them."""
    return legs.where(has_order()).groupBy("orderCode").agg(sum0(F.col(COST)).alias("cost"))


def ftl_order_pnl(legs: DataFrame, market_only: bool = False) -> DataFrame:
    """Money over all rows of a truckload order, pieces over its header rows."""
    touches = F.max(F.coalesce(is_main() & touches_one_crossdock(), F.lit(False)))
    orders = (
        legs.where(has_order() & is_ftl())
        .groupBy("orderCode")
        .agg(
            sum0(F.col(REVENUE)).alias("revenue"),
            sum0(F.col(COST)).alias("cost"),
            F.sum(F.when(is_main(), F.coalesce("pieces", F.lit(0))).otherwise(0)).alias("pieces"),
            touches.alias("touches_market"),
        )
        .withColumn("profit", F.col("revenue") - F.col("cost"))
    )
    return orders.where("touches_market") if market_only else orders


def ftl_market_split(legs: DataFrame, patterns: str = "all") -> DataFrame:
    """Truckload orders divided over the markets their header legs touch."""
    touching = legs.where(has_order() & is_ftl() & is_main() & touches_one_crossdock())
    return (
        touching.withColumn("market", leg_market(patterns))
        .where(F.col("market").isNotNull())
        .groupBy("orderCode", "market")
        .agg(
            F.count(F.lit(1)).alias("legs"),
            F.sum(F.coalesce("pieces", F.lit(0))).alias("pieces"),
            sum0(F.col(REVENUE)).alias("revenue"),
            sum0(F.col(COST)).alias("cost"),
        )
    )


def orders_pnl(orders: DataFrame) -> DataFrame:
    """Order-level money straight from the order table, the safe source."""
    return orders.select("code", "customerName", "shipmentType", "status", "revenue", "cost").withColumn(
        "profit", F.col("revenue") - F.col("cost")
    )


# ---- audits --------------------------------------------------------------------------
def revenue_pattern(legs: DataFrame) -> DataFrame:
    """How LTL orders split revenue between header and legs, with shares."""
    header, leg = F.col("header_revenue"), F.col("leg_revenue")
    pattern = (
        F.when((header == 0) & (leg == 0), "no revenue")
        .when(header == leg, "header repeats legs")
        .when(header == 0, "header zero")
        .when(leg == 0, "legs zero")
        .otherwise("different")
    )
    counts = (
        ltl_order_revenue(legs).groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("orders"))
    )
    # At most five rows, so one window over all of them is fine.
    everything = F.sum("orders").over(Window.partitionBy())
    return counts.withColumn("share_pct", percent(F.col("orders"), everything))


def dedup_overlap(legs: DataFrame) -> DataFrame:
    """Of orders with header and leg rows: does a leg share the header's place?

    Places are reduced per order first; a missing place matches nothing.
    """

    def matches(side: str) -> DataFrame:
        place = f"{side}LocationName"
        return (
            legs.where(has_order())
            .groupBy("orderCode", place)
            .agg(F.max(F.coalesce(is_main(), F.lit(False))).alias("h"), F.max(F.coalesce(is_leg(), F.lit(False))).alias("l"))
            .groupBy("orderCode")
            .agg(
                F.max("h").alias("has_header"),
                F.max("l").alias("has_leg"),
                F.max(F.col("h") & F.col("l") & is_present(place)).alias("match"),
            )
            .where("has_header and has_leg")
            .agg(F.count(F.lit(1)).alias("orders"), count_if(F.col("match")).alias("matching"))
            .select(F.lit(side).alias("side"), "orders", "matching")
        )

    both = matches("pick").unionByName(matches("drop"))
    return both.withColumn("match_pct", percent(F.col("matching"), F.col("orders")))
