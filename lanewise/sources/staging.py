"""Typed staging of the leg table and small reshaping of text columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise import schema as S
from lanewise.functions.times import effective_delivery, parse_date, parse_timestamp, period_start
from lanewise.session import shuffles_dropped, use_utc

#: Small enough that a file of usual size has several row groups to skip.
ROW_GROUP_BYTES = 16 << 20


def normalize_legs(legs: DataFrame) -> DataFrame:
    """Add the typed columns every operator works on; keep the text.

    All are plain projections: a report that does not read one never parses it.
    """
    typed = legs.withColumns({name: parse_timestamp(F.col(text)) for name, text in S.TYPED_TIMES.items()})
    typed = typed.withColumn("drop_date", parse_date(F.col("dropDateArrived")))
    typed = typed.withColumn("delivered_ts", effective_delivery())
    typed = typed.withColumns({day: F.to_date(ts) for day, ts in S.DAYS.items()})
    deliveries = (F.col("delivered_ts"), F.col("drop_from_ts"))
    return typed.withColumns(
        {
            "pick_month": period_start(F.col("pick_from_ts"), "month"),
            "first_drop_month": period_start(F.least(*deliveries), "month"),
            "last_drop_month": period_start(F.greatest(*deliveries), "month"),
        }
    )


def _cell(bits: int = 6) -> Column:
    """Place on a Z-shaped curve over delivery day and client: rows close on it share days and clients.

    The client counts by a hash, so its rows come together whatever its name; the
    dictionaries of the files tell which clients a row group holds.
    """
    high = F.lit((1 << bits) - 1)
    day = F.least(F.greatest(F.date_diff("delivered_day", "first_drop_month"), F.lit(0)), high)
    client = F.pmod(F.hash("clientName"), high + 1)

    def bit(value: Column, i: int, to: int) -> Column:
        return F.shiftleft(F.shiftright(value, i).bitwiseAND(F.lit(1)), to)

    return reduce(Column.bitwiseOR, [b for i in range(bits) for b in (bit(day, i, 2 * i + 1), bit(client, i, 2 * i))])


def write_staged(
    typed: DataFrame, path: str, mode: str = "overwrite", row_group_bytes: int = ROW_GROUP_BYTES, dynamic: bool = False
) -> None:
    """Write typed legs in the staged layout; ``dynamic`` leaves partitions without a row in ``typed`` as they are."""
    with shuffles_dropped(typed.sparkSession):
        (
            typed.hint("rebalance", *S.MONTHS)
            .sortWithinPartitions(*S.MONTHS, _cell())
            .write.mode(mode)
            .option("parquet.block.size", row_group_bytes)
            .option("compression", "zstd")
            .option("partitionOverwriteMode", "dynamic" if dynamic else "static")
            .partitionBy(*S.MONTHS)
            .parquet(path)
        )


def stage_legs(
    legs: DataFrame, path: str, mode: str = "overwrite", row_group_bytes: int = ROW_GROUP_BYTES, parts: int = 1
) -> None:
    """Write the typed table once, laid out for the reports.

    Partitioned by pickup and delivery months, so that a window of either date
    skips files; nearly all legs of a month have both delivery times in one or
    two months. Inside a file rows follow a curve over delivery day and client,
    so that the statistics and dictionaries of its row groups skip the rest. The
    rebalance hint gathers each partition into few files and lets Spark split one
    that holds a large share of the rows instead of writing it from one task.

    In ``parts`` of the pickup months, one after the other, only a part's rows lie
    in shuffle files at a time; ``legs`` are read once for each. A run that breaks
    off leaves the parts before it, which staging again replaces.
    """
    typed = normalize_legs(legs)
    for i in range(parts):
        some = typed.where(F.pmod(F.xxhash64("pick_month"), F.lit(parts)) == i) if parts > 1 else typed
        write_staged(some, path, mode if i == 0 else "append", row_group_bytes)


def load_staged_legs(spark: SparkSession, path: str, extra: Sequence[str] = ()) -> DataFrame:
    use_utc(spark)
    return spark.read.schema(S.with_text(S.STAGED_LEGS, extra)).parquet(path)


def coerce_numeric(df: DataFrame, columns: Sequence[str], kind: str = "double", fill: float | None = 0) -> DataFrame:
    """Text to number; what does not parse becomes NULL and then ``fill``."""
    typed = {}
    for name in columns:
        number = F.col(name).try_cast(kind)
        typed[name] = number if fill is None else F.coalesce(number, F.lit(fill).cast(kind))
    return df.withColumns(typed)


def explode_route_shipments(routes: DataFrame, column: str = "shipmentCodes", kind: str = "string") -> DataFrame:
    """One row per leg code of a load; a load without codes keeps one row with NULL."""
    codes = F.from_json(F.col(column), f"array<{kind}>")
    return routes.select("routeId", F.explode_outer(codes).alias("leg_code"))
