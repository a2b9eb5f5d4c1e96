"""Joins on keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key above this share of the rows is hot; there are at most 1/share of them,
# so the list of hot keys has a fixed size whatever the data.
HOT_SHARE = 1 / 500
_TRACKED = 2048
_GROUPS = 64


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """One row with the array of keys above ``share`` of the rows.

    Frequent-items sketches find them in one pass, combined map-side. They are
    merged in groups of tasks first, so no single task reads a sketch from every
    map task. The list only decides how rows are spread: its error cannot
    change a result.
    """
    most = int(1 / share) + 1
    sketches = df.groupBy((F.spark_partition_id() % _GROUPS).alias("tasks")).agg(
        F.expr(f"approx_top_k(`{key}`, {most}, {_TRACKED})").alias("top"), F.count(F.lit(1)).alias("rows")
    )
    candidates = sketches.agg(F.flatten(F.collect_list("top")).alias("top"), F.sum("rows").alias("rows"))
    counts = (
        candidates.select("rows", F.explode("top").alias("entry"))
        .groupBy("rows", F.col("entry.item").alias("item"))
        .agg(F.sum("entry.count").alias("count"))
    )
    return counts.where(F.col("count") > F.col("rows") * share).agg(F.collect_list("item").alias("keys"))


def attach(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    spread: str = "warpId",
    share: float = HOT_SHARE,
) -> DataFrame:
    """Join ``left`` rows to ``right`` on ``key`` without one task per hot key.

    Left rows of a hot key are spread over salts by their own id, and the right
    rows of those few keys are repeated once per salt. Rows without a key match
    nothing and are spread as well. Salts come from the row, not from a random
    number, so a task that is run again makes the same choice. Finding the hot
    keys reads ``left`` once more, but only its key and filter columns.
    """
    spark = left.sparkSession
    salts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8), 1024)
    hot = hot_keys(left, key, share)

    def is_hot() -> Column:
        return F.array_contains(hot.scalar(), F.col(key))

    spread_out = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    salted_left = left.withColumn(
        "_salt", F.when(F.col(key).isNull() | is_hot(), spread_out).otherwise(F.lit(0))
    )
    copies = F.when(is_hot(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_right = right.where(F.col(key).isNotNull()).withColumn("_salt", F.explode(copies))
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")
