"""First row per stop, and reasons inherited within an order.

"First" is the smallest (time, leg id) pair of a group, taken as an aggregate:
each map task keeps one row per group, so a group of any size stays cheap, and
ties always resolve the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.predicates import has_order, is_present, not_crossdock_leg
from lanewise.session import written


def stop_columns(side: str) -> list[Column]:
    """A stop: load, carrier, place and day of arrival."""
    return [
        F.col("loadId"),
        F.col("carrierName"),
        F.col(f"{side}LocationName"),
        F.to_date(f"{side}_arrived_ts").alias("_day"),
    ]


def _earliest(side: str, names: Sequence[str]) -> Column:
    return F.min(F.struct(F.col(f"{side}_arrived_ts").alias("_at"), F.col("warpId").alias("_id"), *names))


def first_per_stop(legs: DataFrame, side: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per stop. Name the ``columns`` needed: the rest is not shuffled."""
    names = list(columns or legs.columns)
    picked = legs.groupBy(*stop_columns(side)).agg(_earliest(side, names).alias("_first"))
    return picked.select(*(F.col("_first").getField(n).alias(n) for n in names))


def dedup_pickups(legs: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return first_per_stop(legs, "pick", columns)


def dedup_deliveries(legs: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return first_per_stop(legs, "drop", columns)


def stop_key(side: str) -> Column:
    """The stop as one text; NULL as soon as one part is missing."""
    day = F.date_format(F.to_date(f"{side}_arrived_ts"), "yyyy-MM-dd")
    bar = F.lit("|")
    return F.concat("loadId", bar, "carrierName", bar, f"{side}LocationName", bar, day)


def _kept_rows(legs: DataFrame, side: str) -> DataFrame:
    """Id, time and hash of the key of the first row per stop."""
    first = legs.groupBy(stop_key(side).alias("_key")).agg(_earliest(side, []).alias("_first"))
    return first.select(F.col("_first._id").alias("_id"), F.col("_first._at").alias("_at"), F.xxhash64("_key").alias("_key"))


def _flagged(legs: DataFrame, kept: dict[str, DataFrame]) -> DataFrame:
    # Legs move once, by their id, for both joins; those without one match nothing and are spread.
    spread = F.concat(F.lit("\0"), F.xxhash64(*map(stop_key, FLAGS), *(f"{side}_arrived_ts" for side in FLAGS)).cast("string"))
    for side, flag in FLAGS.items():
        same_row = (
            (F.col("warpId") == F.col("_id"))
            & (F.xxhash64(stop_key(side)) == F.col("_key"))
            & F.col(f"{side}_arrived_ts").eqNullSafe(F.col("_at"))
        )
        by_id = F.coalesce("warpId", spread) == F.col("_id")
        legs = legs.join(kept[side], by_id & F.coalesce(same_row, F.lit(False)), "left")
        legs = legs.withColumn(flag, F.col("_id").isNotNull()).drop("_key", "_at", "_id")
    return legs


#: Flag of the first row of a stop, by side.
FLAGS = {"pick": "keep_for_pickup", "drop": "keep_for_delivery"}
_PARTS = 4  # of the ids, joined one after the other


def flag_dedup(legs: DataFrame, work: str | None = None) -> DataFrame:
    """Mark the first row per stop on every row; rows without a key share one.

    The kept rows are aggregated and joined back by leg id, which is as good as
    unique, so the join is even however the stops are distributed. A hash of the
    key and the time are compared as well, in case an id does occur twice.

    With ``work``, a new folder, legs are derived once and every step is written
    there, the join in parts of the ids, so that only the shuffle files of one step
    at a time lie on disk.
    """
    if work is None:
        return _flagged(legs, {side: _kept_rows(legs, side) for side in FLAGS})
    legs = written(legs, f"{work}/legs")
    kept = {side: written(_kept_rows(legs, side), f"{work}/kept_{side}") for side in FLAGS}

    def part(rows: DataFrame, key: str, i: int) -> DataFrame:
        return rows.where(F.pmod(F.xxhash64(key), F.lit(_PARTS)) == i)

    done = []
    for i in range(_PARTS):
        some = _flagged(part(legs, "warpId", i), {side: part(rows, "_id", i) for side, rows in kept.items()})
        done.append(f"{work}/flagged/{i}")
        flagged = written(some, done[-1])
    return legs.sparkSession.read.schema(flagged.schema).parquet(*done)


# ---- inherited delay codes ----------------------------------------------------------
def _first_code(name: str, at: str, earliest: bool) -> Column:
    row = F.when(is_present(name), F.struct(F.col(at), F.col("warpId"), F.col(name)))
    return (F.min if earliest else F.max)(row).getField(name)


def inherited_codes(legs: DataFrame) -> DataFrame:
    """Per order: code of the earliest pickup and of the latest delivery.

    Transport legs with a code only; a missing window sorts before all others.
    Both codes come from one pass and one shuffle.
    """
    with_code = is_present("pickupDelayCode") | is_present("deliveryDelayCode")
    return (
        legs.where(has_order() & not_crossdock_leg() & with_code)
        .groupBy("orderCode")
        .agg(
            _first_code("pickupDelayCode", "pick_from_ts", True).alias("first_pick_code"),
            _first_code("deliveryDelayCode", "drop_from_ts", False).alias("last_drop_code"),
        )
    )


def earliest_pickup_code(legs: DataFrame) -> DataFrame:
    return inherited_codes(legs).where(F.col("first_pick_code").isNotNull()).select("orderCode", "first_pick_code")


def latest_dropoff_code(legs: DataFrame) -> DataFrame:
    return inherited_codes(legs).where(F.col("last_drop_code").isNotNull()).select("orderCode", "last_drop_code")
