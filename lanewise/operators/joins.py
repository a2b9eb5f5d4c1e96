"""Joins between legs, loads, orders and name dimensions.

Leg-to-leg and leg-to-load joins go through ``attach``, which spreads hot keys;
semi-joins send a filter of the wanted keys ahead.
Name dimensions are left to Spark: it broadcasts them only below its own size
limit, and splits skewed partitions of the sort-merge join beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions.money import COST, REVENUE, sum0
from lanewise.functions.places import leg_number
from lanewise.functions.predicates import is_main
from lanewise.operators.ahead import semi_join_ahead
from lanewise.operators.skew import attach
from lanewise.sources.staging import explode_route_shipments


def with_route(legs: DataFrame, routes: DataFrame) -> DataFrame:
    """Every leg with its load; several load rows of one id repeat the leg."""
    loads = routes.select(F.col("routeId").alias("loadId"), "palletCount", "transitCost")
    return attach(legs, loads, "loadId", "left")


def legs_of(legs: DataFrame, orders: DataFrame) -> DataFrame:
    """All legs, of any client and status, of the given orders; the others leave at the scan."""
    return semi_join_ahead(legs, orders, "orderCode")


def keep_listed(legs: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is in a list too long for ``isin``."""
    return semi_join_ahead(legs, listed, key)


def with_order_counts(legs: DataFrame, counts: DataFrame) -> DataFrame:
    """Legs with the row counts of their order; legs without an order vanish."""
    return attach(legs, counts, "orderCode", "inner")


def orders_with_lane(orders: DataFrame, legs: DataFrame) -> DataFrame:
    """Header legs with the money of their order; several headers repeat it."""
    money = orders.select(
        F.col("code").alias("orderCode"),
        "customerName",
        F.col("shipmentType").alias("orderType"),
        F.col("status").alias("orderStatus"),
        F.col("revenue").alias("orderRevenue"),
        F.col("cost").alias("orderCost"),
    )
    return attach(legs.where(is_main()), money, "orderCode", "inner")


def orders_with_leg(orders: DataFrame, legs: DataFrame) -> DataFrame:
    """Orders with the leg whose number they name: ``warpId`` 123 is the leg S-123. Leg ids and numbers are unique."""
    named = orders.where(F.col("warpId").isNotNull()).select("code", F.col("warpId").alias("leg_number"))
    numbered = legs.withColumn("leg_number", leg_number(F.col("warpId"))).where(F.col("leg_number").isNotNull())
    return numbered.join(named, "leg_number")


def reconcile_orders(orders: DataFrame, legs: DataFrame, few: bool = False) -> DataFrame:
    """Order money beside the sum of the order's legs. Both sides are per order.

    ``few`` says that the legs are known to be of few orders, whose sums may be broadcast.
    """
    sums = legs.groupBy("orderCode").agg(
        sum0(F.col(REVENUE)).alias("legs_revenue"), sum0(F.col(COST)).alias("legs_cost")
    )
    if few:
        sums = F.broadcast(sums)
    return (
        orders.select(
            "code", F.col("revenue").alias("orders_revenue"), F.col("cost").alias("orders_cost")
        )
        .join(sums, F.col("code") == F.col("orderCode"))
        .drop("orderCode")
        .withColumns(
            {
                "revenue_diff": F.col("legs_revenue") - F.col("orders_revenue"),
                "cost_diff": F.col("legs_cost") - F.col("orders_cost"),
            }
        )
    )


def with_carrier(legs: DataFrame, carriers: DataFrame) -> DataFrame:
    """Carrier attributes by name; ids of the two tables are unrelated."""
    return _with_named(legs, carriers, "carrierName", "carrier")


def with_client(legs: DataFrame, clients: DataFrame) -> DataFrame:
    return _with_named(legs, clients, "clientName", "client")


def _with_named(legs: DataFrame, names: DataFrame, key: str, prefix: str) -> DataFrame:
    renamed = names.select(
        *(F.col(c).alias(key if c == "name" else f"{prefix}_{c}") for c in names.columns)
    )
    return legs.join(renamed, key, "left")


def with_parent(shipments: DataFrame) -> DataFrame:
    """Shipments with the shipment their ``parent`` names."""
    parents = shipments.select(F.col("warpId").alias("parent"), F.col("parent").alias("grandparent"))
    return attach(
        shipments, parents.withColumn("parent_found", F.lit(True)), "parent", "left", spread="warpId"
    ).withColumn("parent_found", F.coalesce("parent_found", F.lit(False)))


def route_membership(routes: DataFrame, legs: DataFrame, columns: list[str]) -> DataFrame:
    """Leg codes listed on a load, with the leg behind each. Leg ids are unique."""
    listed = explode_route_shipments(routes).withColumnRenamed("leg_code", "warpId")
    return listed.join(legs.select("warpId", *columns), "warpId", "inner")
