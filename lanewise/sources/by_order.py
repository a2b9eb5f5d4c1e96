"""Legs laid out by order, so that work on whole orders needs no shuffle.

Legs are written in buckets of their order code; the order table can be written
in as many buckets of its own code. An aggregate per order, a join of legs to
their order's figures and a comparison of both tables then read bucket by bucket.

Orders that alone hold a large share of the rows would fill a bucket, and rows
without a code would all lie in one. Both are kept in a table beside, without
buckets; its orders are few (at most one over the share), whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.operators.joins import reconcile_orders
from lanewise.operators.orders import order_row_counts
from lanewise.operators.quality import with_mismatch
from lanewise.operators.skew import HOT_SHARE, hot_keys
from lanewise.session import shuffles_dropped

ORDER = "orderCode"


@dataclass(frozen=True)
class OrderLegs:
    """Legs in buckets of their order, and the legs of the few hot orders or of none."""

    legs: DataFrame
    hot: DataFrame

    def per_order(self, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``work`` on both parts. It must treat each order by itself, as no order is in both."""
        return work(self.legs).unionByName(work(self.hot))

    def with_order_counts(self, columns: list[str]) -> DataFrame:
        """Legs with the row counts of their order; legs without an order vanish."""
        few = F.broadcast(order_row_counts(self.hot))  # at most one row a hot order
        return (
            self.legs.select(ORDER, *columns)
            .join(order_row_counts(self.legs), ORDER)
            .unionByName(self.hot.select(ORDER, *columns).join(few, ORDER))
        )

    def cross_validate(self, orders: DataFrame, tolerance: float = 0.01) -> DataFrame:
        """Order money beside the sum of the order's legs, flagged where they disagree.

        ``orders`` in as many buckets of its code meets the legs without a shuffle.
        """
        compared = reconcile_orders(orders, self.legs).unionByName(reconcile_orders(orders, self.hot, few=True))
        return with_mismatch(compared, tolerance)


def _in_buckets(df: DataFrame, key: str, path: str, table: str, buckets: int) -> None:
    """One file a bucket, sorted by key."""
    with shuffles_dropped(df.sparkSession):
        (
            df.repartition(buckets, key)
            .write.mode("overwrite")
            .format("parquet")
            .option("path", path)
            .bucketBy(buckets, key)
            .sortBy(key)
            .saveAsTable(table)
        )


def _open_buckets(spark: SparkSession, key: str, path: str, table: str, buckets: int, schema: T.StructType) -> DataFrame:
    """Name the files of ``path`` as a bucketed table where this catalog does not have it yet."""
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key})"
            f" INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(table)


def stage_by_order(legs: DataFrame, path: str, table: str, buckets: int, share: float = HOT_SHARE) -> OrderLegs:
    """Write typed legs below ``path``, those in buckets under the catalog name ``table``.

    Choose ``buckets`` so that one fits a task, about 100 MB of the columns read. The hot
    orders are listed once and the list is written before it parts the rows: both
    parts go by the same list, so no row is lost or doubled.
    """
    spark = legs.sparkSession
    hot_keys(legs.where(F.col(ORDER).isNotNull()), ORDER, share).write.mode("overwrite").parquet(f"{path}/keys")
    listed = spark.read.parquet(f"{path}/keys")
    apart = F.col(ORDER).isNull() | F.array_contains(listed.scalar(), F.col(ORDER))
    legs.where(apart).write.mode("overwrite").parquet(f"{path}/hot")
    _in_buckets(legs.where(~apart), ORDER, f"{path}/legs", table, buckets)
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/layout")
    return open_by_order(spark, path, table)


def open_by_order(spark: SparkSession, path: str, table: str) -> OrderLegs:
    """Legs that ``stage_by_order`` wrote, in this or another application."""
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    hot = spark.read.parquet(f"{path}/hot")
    return OrderLegs(_open_buckets(spark, ORDER, f"{path}/legs", table, buckets, hot.schema), hot)


def stage_orders_by_code(orders: DataFrame, path: str, table: str, buckets: int) -> DataFrame:
    """Write the order table in buckets of its code; codes are few rows each, so none is hot."""
    _in_buckets(orders, "code", path, table, buckets)
    return orders.sparkSession.table(table)
