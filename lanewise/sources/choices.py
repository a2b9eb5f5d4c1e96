"""Distinct value lists that feed report filters. All values, unless a caller asks for the first ``limit``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions.places import lane_label
from lanewise.functions.predicates import client_is, has_lane, is_present


def _in_order(values: DataFrame, name: str, limit: int | None) -> DataFrame:
    ordered = values.distinct().orderBy(name)
    return ordered if limit is None else ordered.limit(limit)


def distinct_clients(legs: DataFrame) -> DataFrame:
    """All client names in order; a blank name is one of them, NULL is not."""
    return _in_order(legs.where(F.col("clientName").isNotNull()).select("clientName"), "clientName", None)


def distinct_customers(legs: DataFrame, limit: int | None = None) -> DataFrame:
    return _in_order(legs.where(is_present("clientName")).select("clientName"), "clientName", limit)


def distinct_lanes(legs: DataFrame, customer: str | None = None, limit: int | None = None) -> DataFrame:
    rows = legs.where(has_lane())
    if customer is not None:
        rows = rows.where(client_is(customer))
    return _in_order(rows.select(lane_label().alias("lane")), "lane", limit)
