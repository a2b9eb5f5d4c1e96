"""Markets, lanes, equipment and identifier shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise import schema as S
from lanewise.functions.predicates import crossdock_leg


def market_of(place: Column, patterns: str = "all") -> Column:
    """Market code of a cross-dock name, NULL for any other place.

    ``patterns='wtch'`` knows the numbered docks only.
    """
    coded = S.CODED_DOCKS if patterns == "all" else S.CODED_DOCKS[:1]
    named = S.NAMED_DOCKS if patterns == "all" else ()
    return F.coalesce(
        *(F.when(place.like(p), F.substring(place, 6, 3)) for p in coded),
        *(F.when(place.like(p), code) for p, code in named),
    )


def leg_market(patterns: str = "all") -> Column:
    """Market of the pickup place, else of the delivery place."""
    return F.coalesce(
        market_of(F.col("pickLocationName"), patterns), market_of(F.col("dropLocationName"), patterns)
    )


LANE_LEVELS = ("market", "city", "address")


def lane_ends(level: str = "market") -> tuple[Column, Column]:
    """Where a leg starts and ends, by market, city or street address."""
    if level not in LANE_LEVELS:
        raise ValueError(f"level must be one of {LANE_LEVELS}")
    return {
        "market": (F.col("startMarket"), F.col("endMarket")),
        "city": (
            F.concat("pickCity", F.lit(", "), "pickState"),
            F.concat("dropCity", F.lit(", "), "dropState"),
        ),
        "address": (F.col("pickAddress"), F.col("dropAddress")),
    }[level]


def lane_label(level: str = "market") -> Column:
    """``a → b``; NULL when either side is."""
    start, end = lane_ends(level)
    return F.concat(start, F.lit(" → "), end)


def window_label(side: str) -> Column:
    return F.concat(F.col(f"{side}WindowFrom"), F.lit(" - "), F.col(f"{side}WindowTo"))


def crossdock_label() -> Column:
    return F.when(crossdock_leg(), "Yes").otherwise("No")


# ---- equipment ----------------------------------------------------------------
def equipment_temperature(equipment: Column) -> Column:
    return F.when(equipment.contains("Reefer"), "reefer").when(equipment.isNotNull(), "dry")


def equipment_size(equipment: Column) -> Column:
    return (
        F.when(equipment.startswith("53-ft"), "53-ft")
        .when(equipment.startswith("26-ft"), "26-ft")
        .when(equipment.contains("Van"), "van")
        .when(equipment.contains("Straight"), "straight")
        .when(equipment.isNotNull(), "other")
    )


def equipment_has(equipment: Column, add_on: str) -> Column:
    """Add-ons are written ``/w Lift Gate``, ``/w Team``, ``/w Pallet Jack``, ``/w Drop``."""
    return equipment.contains(f"/w {add_on}")


# ---- identifiers ----------------------------------------------------------------
# fixed values: identifier shapes
ID_SHAPES = {
    "order": r"^[PO]-\d+-\d{4}$",
    "leg": r"^S-\d+$",
    "load": r"^\d+-\d{4}$",
    "ulid": r"^[0-9A-HJKMNP-TV-Z]{26}$",
}


def has_id_shape(value: Column, kind: str) -> Column:
    return value.rlike(ID_SHAPES[kind])


def leg_number(code: Column) -> Column:
    """Number behind a leg code such as ``S-123``; NULL for other shapes."""
    return F.regexp_extract(code, r"^S-(\d+)$", 1).try_cast("bigint")
