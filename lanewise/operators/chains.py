"""Chains of parents followed to their roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.session import drop_folder, written


def root_legs(shipments: DataFrame, work: str) -> DataFrame:
    """warpId, root, depth and in_cycle of every shipment, by pointer jumping.

    ``root`` is the last shipment on the way over ``parent`` that the table
    holds, ``depth`` the number of steps to it; a shipment without a parent, or
    whose parent is not in the table, is its own root at depth 0. Shipments that
    run into a cycle have neither and are flagged. An id on several rows is one
    shipment, whose smallest parent counts; rows without an id are left out.

    Each round lets every open shipment jump as far again as it has come, so
    chains of n take log2(n) rounds of one join, and one more shows the cycles. A
    round writes the shipments that were open to ``work``, a new folder, and drops
    what it had of them before: ``work`` holds each shipment once between the
    rounds, twice while one is written.
    """
    spark = shipments.sparkSession
    ids = written(shipments.where(F.col("warpId").isNotNull()).groupBy("warpId").agg(F.min("parent").alias("parent")), f"{work}/ids")
    there = ids.select(F.col("warpId").alias("parent"), F.lit(True).alias("there"))
    up = F.when(F.col("there"), F.col("parent"))
    found = ids.where("parent is not null").join(there, "parent", "left")
    start = found.select("warpId", up.alias("up")).unionByName(ids.where("parent is null").select("warpId", F.col("parent").alias("up")))
    # The root of an open shipment is where it has come to, that of one that has ended stays.
    start = start.select(
        "warpId",
        F.coalesce("up", "warpId").alias("root"),
        F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        F.when(F.col("up").isNull(), 1).otherwise(0).alias("ended"),
    )
    names, folder = start.columns, f"{work}/state"

    def state() -> DataFrame:
        return spark.read.schema(start.schema).option("basePath", folder).parquet(f"{folder}/turn=*").select(*names)

    written(start, f"{folder}/turn=0", "ended")
    drop_folder(spark, f"{work}/ids")
    turn, left, before = 0, state().where("ended = 0").count(), None
    while left and left != before:
        jump = state().select(F.col("warpId").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("ended").alias("_ended"))
        moved = state().where("ended = 0").drop("ended").join(jump, "root").select(
            "warpId", F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_ended").alias("ended")
        )
        written(moved, f"{folder}/turn={turn + 1}", "ended")
        drop_folder(spark, f"{folder}/turn={turn}/ended=0")
        turn += 1
        left, before = state().where("ended = 0").count(), left
    # A way that ends has a shipment that ends in the next round: if a round ends none, all that is open goes round.
    ended = F.col("ended") == 1
    return state().select("warpId", F.when(ended, F.col("root")).alias("root"), F.when(ended, F.col("depth")).alias("depth"), (~ended).alias("in_cycle"))
