"""Partials by day that add up to any longer period: distinct orders, quantiles.

A partial table is written once (a day's rows never change it again) and every
report reads a few rows of it instead of all legs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.times import period_start
from lanewise.operators.stats import QUANTILES, quantile_name

#: Size of a sketch; a rank it gives is off by at most ``SKETCH_ERROR`` of the rows, at any grain (99 % of the time).
SKETCH_K, SKETCH_ERROR = 400, 0.01


# ---- distinct orders -----------------------------------------------------------------
def order_number(code: Column) -> Column:
    """A number of its own for each code of a known shape (``P-123``, ``P-00012-2501``), else NULL."""
    plain = F.regexp_extract(code, r"^P-(0|[1-9][0-9]{0,11})\z", 1)
    dated = F.concat(F.regexp_extract(code, r"^P-([0-9]{5})-([0-9]{4})\z", 1), F.regexp_extract(code, r"^P-([0-9]{5})-([0-9]{4})\z", 2))
    return F.when(plain != "", plain.cast("bigint")).when(dated != "", F.lit(1 << 40) + dated.cast("bigint"))


def order_partials(legs: DataFrame, by: Sequence[str], day: str) -> DataFrame:
    """Which orders each group has on each day: bits of order numbers, 32,768 to a row.

    A code of another shape keeps a row of its own, so counts stay exact. Rows
    without an order are left out; days may be NULL.
    """
    rows = legs.where(F.col("orderCode").isNotNull()).select(*by, F.col(day).cast("date").alias("day"), "orderCode")
    number = order_number(F.col("orderCode"))
    rows = rows.select(
        *by,
        "day",
        F.bitmap_bucket_number(number).alias("bucket"),
        F.bitmap_bit_position(number).alias("position"),
        F.when(number.isNull(), F.col("orderCode")).alias("code"),
    )
    return rows.groupBy(*by, "day", "bucket", "code").agg(F.bitmap_construct_agg("position").alias("orders"))


def distinct_orders(partials: DataFrame, by: Sequence[str] = (), grain: str | None = None) -> DataFrame:
    """Orders of each group and period (``grain`` day, week, month, quarter or year; None: all days), each counted once.

    ``by`` may be fewer columns than the partials have: an order of two markets counts once over both.
    """
    period = [] if grain is None else [period_start(F.col("day"), grain).alias("period")]
    names = [*by, *(["period"] if grain else [])]
    merged = partials.select(*by, *period, "bucket", "code", "orders").groupBy(*names, "bucket", "code").agg(
        F.bitmap_or_agg("orders").alias("orders")
    )
    once = F.when(F.col("code").isNotNull(), 1).otherwise(F.bitmap_count("orders"))
    return merged.groupBy(*names).agg(F.coalesce(F.sum(once), F.lit(0)).alias("order_count"))


# ---- quantiles -----------------------------------------------------------------------
def quantile_partials(df: DataFrame, metric: Column, by: Sequence[str], day: str) -> DataFrame:
    """A KLL sketch of the metric for each group and day; rows without a value are left out."""
    rows = df.select(*by, F.col(day).cast("date").alias("day"), metric.cast("double").alias("value")).where("value is not null")
    return rows.groupBy(*by, "day").agg(F.kll_sketch_agg_double("value", F.lit(SKETCH_K)).alias("sketch"))


def sketched_quantiles(
    partials: DataFrame, by: Sequence[str] = (), grain: str | None = None, probabilities: Sequence[float] = QUANTILES
) -> DataFrame:
    """Number of values, least, greatest (all exact) and quantiles of each group and period from merged sketches."""
    period = [] if grain is None else [period_start(F.col("day"), grain).alias("period")]
    names = [*by, *(["period"] if grain else [])]
    merged = partials.select(*by, *period, "sketch").groupBy(*names).agg(F.kll_merge_agg_double("sketch").alias("sketch"))

    def quantile(p: float) -> Column:
        return F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))

    number = F.kll_sketch_get_n_double("sketch")
    return merged.where(number > 0).select(  # without a row there is an empty sketch, which has no quantile
        *names,
        number.alias("n"),
        quantile(0.0).alias("least"),
        quantile(1.0).alias("greatest"),
        *(quantile(p).alias(quantile_name(p)) for p in probabilities),
    )
