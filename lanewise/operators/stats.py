"""Statistics of a metric: regression, quantiles, correlation, rolling change.

Money is cast to double here and nowhere else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.money import weighted_average
from lanewise.functions.times import period_number, period_start

# fixed values: the percentiles of the statistics pack
QUANTILES = (0.1, 0.5, 0.9)


def slope(y: Column, x: Column) -> Column:
    return F.regr_slope(y, x)


def r_squared(y: Column, x: Column) -> Column:
    """0, not 1 or NULL, when either side is constant."""
    covariance = F.covar_pop(y, x)
    return F.coalesce(F.try_divide(covariance * covariance, F.var_pop(x) * F.var_pop(y)), F.lit(0.0))


def correlation(y: Column, x: Column) -> Column:
    """NULL when either side is constant. Rows missing one side are left out."""
    both = y.isNotNull() & x.isNotNull()
    y, x = F.when(both, y.cast("double")), F.when(both, x.cast("double"))
    return F.try_divide(F.covar_pop(y, x), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def metric_corr(df: DataFrame, first: Column, second: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(correlation(first, second).alias("correlation"))


def exact_quantiles(
    df: DataFrame,
    metric: Column,
    by: Sequence[str] = (),
    probabilities: Sequence[float] = QUANTILES,
    width: float = 1.0,
) -> DataFrame:
    """Interpolated quantiles per group without gathering a group in one task.

    Equal values are first reduced to counts, which fall into buckets ``width``
    wide. Running totals over a group's buckets show which buckets hold the
    wanted ranks, and only those are looked into. The result is exact for any
    width; the width only decides how much work is left for the last step.
    """
    values = df.select(F.struct(*by, F.lit(0).alias("_")).alias("group"), metric.cast("double").alias("value"))
    counts = (
        values.where(F.col("value").isNotNull())
        .groupBy("group", F.floor(F.col("value") / width).alias("bucket"), "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    group = Window.partitionBy("group")
    before = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        counts.groupBy("group", "bucket")
        .agg(F.sum("n").alias("n"))
        .withColumns(
            {
                "start": F.coalesce(F.sum("n").over(before), F.lit(0)),
                "total": F.sum("n").over(group),
            }
        )
    )

    def position(p: float) -> Column:
        return (F.col("total") - 1) * F.lit(float(p))

    ranks = F.array(
        *(F.struct(F.lit(i).alias("p"), F.lit(0).alias("side"), F.floor(position(p)).alias("rank"))
          for i, p in enumerate(probabilities)),
        *(F.struct(F.lit(i).alias("p"), F.lit(1).alias("side"), F.ceil(position(p)).alias("rank"))
          for i, p in enumerate(probabilities)),
    )

    def within(first: Column, size: Column):
        return lambda want: (want["rank"] >= first) & (want["rank"] < first + size)

    needed = buckets.withColumn("ranks", F.filter(ranks, within(F.col("start"), F.col("n")))).where(
        F.size("ranks") > 0
    )
    inside = Window.partitionBy("group", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        counts.join(needed.drop("n"), ["group", "bucket"])
        .withColumn("first", F.col("start") + F.sum("n").over(inside) - F.col("n"))
        .withColumn("hit", F.explode(F.filter("ranks", within(F.col("first"), F.col("n")))))
    )

    def edge(i: int, side: int) -> Column:
        return F.max(F.when((F.col("hit.p") == i) & (F.col("hit.side") == side), F.col("value")))

    edges = hits.groupBy("group").agg(
        F.max("total").alias("total"),
        *(edge(i, side).alias(f"edge_{i}_{side}") for i in range(len(probabilities)) for side in (0, 1)),
    )

    def quantile(i: int, p: float) -> Column:
        low, high = F.col(f"edge_{i}_0"), F.col(f"edge_{i}_1")
        return (low + (high - low) * (position(p) - F.floor(position(p)))).alias(quantile_name(p))

    return edges.select(
        *(F.col("group").getField(b).alias(b) for b in by), *(quantile(i, p) for i, p in enumerate(probabilities))
    )


def quantile_name(p: float) -> str:
    return f"p{round(p * 100):02d}"


def metric_stats(
    df: DataFrame,
    metric: Column,
    by: Sequence[str] = (),
    weight: Column | None = None,
    approximate: bool = False,
    width: float = 1.0,
    quantiles: bool = True,
) -> DataFrame:
    """Count, mean, spread and quantiles of a metric, per group.

    ``approximate`` replaces the exact quantiles by one-pass sketches;
    ``quantiles=False`` leaves them out and takes one aggregation.
    """
    value = metric.cast("double")
    weighted = []
    if weight is not None:
        weighted = [weighted_average(value, weight.cast("double")).alias("weighted_mean")]
    sketches = [
        F.percentile_approx(value, float(p), 10000).alias(quantile_name(p)) for p in QUANTILES if approximate and quantiles
    ]
    moments = df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.var_samp(value).alias("variance"),
        *weighted,
        *sketches,
    )
    if approximate or not quantiles:
        return moments
    # Both frames have one row per group; laid on top of each other and reduced,
    # groups with a NULL name meet too, and no join is needed for a single group.
    stacked = moments.unionByName(exact_quantiles(df, metric, by, width=width), allowMissingColumns=True)
    measured = [c for c in stacked.columns if c not in by]
    return stacked.groupBy(*by).agg(*(F.max(c).alias(c) for c in measured))


def rolling_avg(df: DataFrame, metric: str, n: int, period: str, entity: Sequence[str], grain: str) -> DataFrame:
    """Mean over the last ``n`` calendar periods of each entity (one row per period).

    A period without a row is not replaced by an older one; the mean is over the rows there are.
    """
    window = Window.partitionBy(*entity).orderBy(period_number(F.col(period), grain)).rangeBetween(-(n - 1), 0)
    return df.withColumn(f"{metric}_avg_{n}", F.avg(F.col(metric).cast("double")).over(window))


def period_change(df: DataFrame, metric: str, period: str, entity: Sequence[str], grain: str) -> DataFrame:
    """Difference to the entity's previous calendar period, absolute and in per cent; NULL if that has no row."""
    before = Window.partitionBy(*entity).orderBy(period_number(F.col(period), grain)).rangeBetween(-1, -1)
    previous = F.max(metric).over(before)
    changed = df.withColumn(f"{metric}_before", previous)
    delta = F.col(metric) - F.col(f"{metric}_before")
    share = F.try_divide(delta.cast("double") * 100, F.abs(F.col(f"{metric}_before").cast("double")))
    return changed.withColumn(f"{metric}_change", delta).withColumn(f"{metric}_change_pct", share)


def by_period(df: DataFrame, ts: str, grain: str, entity: Sequence[str], **metrics: Column) -> DataFrame:
    """Aggregate to one row per entity and period, the input of the two above."""
    rows = df.where(F.col(ts).isNotNull())
    return rows.groupBy(*entity, period_start(F.col(ts), grain).alias("period")).agg(
        *(value.alias(name) for name, value in metrics.items())
    )


def value_counts(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """Frequency table, most frequent first."""
    return (
        df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc(name))
    )


def distribution(df: DataFrame, *names: str) -> DataFrame:
    return df.groupBy(*names).agg(F.count(F.lit(1)).alias("count"))
